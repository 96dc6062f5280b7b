"""Predicates and functions of the query language as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Val, before, cast_to, common, const, equal, js_number, number, text


def _chain(test: Callable[[Val, Val], Column]):
    return lambda *vs: reduce(lambda a, b: a & b, [test(x, y) for x, y in zip(vs, vs[1:])], F.lit(True))


def _number_test(test):
    return lambda v: F.coalesce(test(number(v)), F.lit(False))


def _pattern(v: Val) -> str:
    if not isinstance(v.const, str):
        raise TypeError("a pattern is a constant string")
    return v.const


def _is(*kinds: str):
    def test(v: Val) -> Column:
        if v.kind == "any":
            from .values import TAGS

            return v.col["vt"].isin([TAGS[k] for k in kinds])
        return v.col.isNotNull() if v.kind in kinds else F.lit(False)

    return test


PREDICATES: dict[str, Callable[..., Column]] = {
    "=": _chain(equal),
    "!=": lambda a, b: ~equal(a, b),
    "<": _chain(before),
    "<=": _chain(lambda a, b: before(a, b, False)),
    ">": _chain(lambda a, b: before(b, a)),
    ">=": _chain(lambda a, b: before(b, a, False)),
    "even?": _number_test(lambda c: c % 2 == 0),
    "odd?": _number_test(lambda c: c % 2 != 0),
    "zero?": _number_test(lambda c: c == 0),
    "pos?": _number_test(lambda c: c > 0),
    "neg?": _number_test(lambda c: c < 0),
    "nil?": lambda v: v.col.isNull(),
    "some?": lambda v: v.col.isNotNull(),
    "true?": lambda v: v.col.eqNullSafe(F.lit(True)) if v.kind == "boolean" else F.lit(False),
    "false?": lambda v: v.col.eqNullSafe(F.lit(False)) if v.kind == "boolean" else F.lit(False),
    "string?": _is("string"),
    "number?": _is("long", "double", "ref"),
    "boolean?": _is("boolean"),
    "starts-with?": lambda s, p: text(s).startswith(text(p)),
    "ends-with?": lambda s, p: text(s).endswith(text(p)),
    "includes?": lambda s, p: text(s).contains(text(p)),
    "blank?": lambda s: s.col.isNull() | text(s).rlike(r"^\s*$"),
    "re-matches?": lambda p, s: text(s).rlike(rf"^(?:{_pattern(p)})\z"),
    "re-find?": lambda p, s: text(s).rlike(_pattern(p)),
}
_ALIASES = {"==": "=", "not=": "!=", "re-matches": "re-matches?", "re-find": "re-find?"}


def _kind(*vs: Val) -> str:
    return "double" if any(v.kind in ("double", "any") for v in vs) else "long"


def _arith(op, unary=None):
    def run(*vs: Val) -> Val:
        cols = [number(v) for v in vs]
        return Val(reduce(op, cols) if len(cols) > 1 or unary is None else unary(cols[0]), _kind(*vs))

    return run


def _ratio(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, inf).when(a < 0, -inf).when(a == 0, F.lit(float("nan")))


def _divide(*vs: Val) -> Val:
    cols = [number(v) for v in vs]
    return Val(reduce(_ratio, cols) if len(cols) > 1 else _ratio(F.lit(1.0), cols[0]), "double")


def _quot(a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    ratio = _ratio(x, y)
    whole = F.when(ratio >= 0, F.floor(ratio)).otherwise(F.ceil(ratio))
    return Val(whole.cast("bigint") if _kind(a, b) == "long" else whole.cast("double"), _kind(a, b))


def _rest(a: Val, b: Val) -> Val:
    return Val(F.when(number(b) != 0, F.try_mod(number(a), number(b))), _kind(a, b))


def _mod(a: Val, b: Val) -> Val:
    y = number(b)
    return Val(F.when(y != 0, F.try_mod(F.try_mod(number(a), y) + y, y)), _kind(a, b))


def _extreme(take, least: bool):
    def run(*vs: Val) -> Val:
        if len({v.cls for v in vs}) == 1 and vs[0].cls != "any":
            return Val(take(*[v.col for v in vs]) if len(vs) > 1 else vs[0].col, _kind(*vs) if vs[0].cls == "number" else vs[0].kind)
        # classes differ: the order of classes decides, known without looking
        from .values import _RANK

        best = (min if least else max)(vs, key=lambda v: _RANK.get(v.cls, 5))
        return best

    return run


def _substring(s: Val, a: Val, b: Val | None = None) -> Val:
    whole = text(s)
    n = F.length(whole)
    clamp = lambda c: F.least(F.greatest(c.cast("int"), F.lit(0)), n)
    x, y = clamp(number(a)), clamp(number(b)) if b is not None else n
    return Val(F.substring(whole, F.least(x, y) + 1, F.abs(y - x)), "string")


def _size(v: Val) -> Val:
    """Items of a list; code units of a text (a character beyond the basic plane counts twice)."""
    if v.kind in ("string", "uuid"):
        return Val((F.octet_length(F.encode(v.col, "UTF-16BE")) / 2).cast("bigint"), "long")
    if v.kind.startswith("tuple"):
        return Val(F.lit(len(v.inner)).cast("bigint"), "long")
    return Val((F.size(v.col) if v.several else F.lit(0)).cast("bigint"), "long")


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def _re_result(whole: bool):
    def run(p: Val, s: Val) -> Val:
        pattern = _pattern(p)
        shown = rf"^(?:{pattern})\z" if whole else pattern
        n = _groups(pattern)
        found = text(s).rlike(shown)
        if not n:
            return Val(F.when(found, F.regexp_extract(text(s), shown, 0)), "string")
        return Val(F.when(found, F.array(*[F.regexp_extract(text(s), shown, k) for k in range(n + 1)])), "list:string")

    return run


def _vector(*vs: Val) -> Val:
    kind = common(v.kind for v in vs)
    return Val(F.array(*[cast_to(v, kind) for v in vs]), f"list:{kind}")


def _split(s: Val, p: Val) -> Val:
    """The parts between matches, and between two parts what the pattern's groups caught there."""
    pattern, whole = _pattern(p), text(s)
    if not pattern:
        return Val(F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0)), "list:string")
    parts, n = F.split(whole, pattern, -1), _groups(pattern)
    if not n:
        return Val(parts, "list:string")
    caught = [F.regexp_extract_all(whole, F.lit(pattern), F.lit(k + 1)) for k in range(n)]
    return Val(F.flatten(F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.array(x, *[F.get(c, i) for c in caught])).otherwise(F.array(x)))), "list:string")


def _join(*vs: Val) -> Val:
    sep, xs = (vs[0], vs[1]) if len(vs) == 2 else (Val(F.lit(""), "string", ""), vs[0])
    return Val(F.array_join(xs.col.cast("array<string>"), sep.const if isinstance(sep.const, str) else ""), "string")


def _trim(v: Val) -> Val:
    return Val(F.regexp_replace(text(v), r"^\s+|\s+$", ""), "string")


FUNCTIONS: dict[str, Callable[..., Val]] = {
    "+": _arith(lambda a, b: a + b),
    "-": _arith(lambda a, b: a - b, lambda a: -a),
    "*": _arith(lambda a, b: a * b),
    "/": _divide,
    "quot": _quot,
    "rem": _rest,
    "mod": _mod,
    "inc": lambda v: Val(number(v) + 1, _kind(v)),
    "dec": lambda v: Val(number(v) - 1, _kind(v)),
    "abs": lambda v: Val(F.abs(number(v)), _kind(v)),
    "min": _extreme(F.least, True),
    "max": _extreme(F.greatest, False),
    "str": lambda *vs: Val(F.concat(*[text(v) for v in vs]) if vs else F.lit(""), "string"),
    "subs": _substring,
    "lower-case": lambda v: Val(F.lower(text(v)), "string"),
    "upper-case": lambda v: Val(F.upper(text(v)), "string"),
    "trim": _trim,
    "count": _size,
    "identity": lambda v: v,
    "ground": lambda v: v,
    "untuple": lambda v: v,
    "vector": _vector,
    "tuple": lambda *vs: Val(F.struct(*[v.col.alias(f"_{k}") for k, v in enumerate(vs)]), "tuple:" + ",".join(v.kind for v in vs)),
    "re-find": _re_result(False),
    "re-matches": _re_result(True),
    "re-seq": lambda p, s: Val(F.regexp_extract_all(text(s), F.lit(_pattern(p)), F.lit(0)), "list:string"),
    "split": _split,
    "join": _join,
    "rand": lambda: Val(F.rand(), "double"),
    "rand-int": lambda n: Val(F.floor(F.rand() * number(n)).cast("bigint"), "long"),
    "now": lambda: Val((F.unix_millis(F.current_timestamp())).cast("bigint"), "instant"),
}


def bare(name: str) -> str:
    """A name without its string-library prefix."""
    return name.removeprefix("clojure.string/")


def predicate(name: str):
    name = bare(name)
    return PREDICATES.get(_ALIASES.get(name, name))


def function(name: str):
    return FUNCTIONS.get(bare(name))


__all__ = ["FUNCTIONS", "PREDICATES", "bare", "const", "function", "js_number", "predicate"]

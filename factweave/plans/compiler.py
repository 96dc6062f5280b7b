"""Queries to DataFrames.

A relation is a DataFrame whose columns are variables, with the kind of each. Clauses are joined in an order in
which every clause shares a variable with those before it where possible; predicates and functions go in as soon
as their variables are bound, so Catalyst sees them next to the scans. Rewrites that Catalyst can't see:
single-valued attributes of one entity are read in one scan (`View.star`), the optional idiom (a path, or not
that path and null) is a left join, rules without recursion are inlined, and recursive ones run to a fixpoint on
new rows only, each round written to the shared folder. A relation knows variables that identify its rows (an entity
identifies its single values, and a join on them keeps the other side's; a table's key stands for its entity), so results that
hold them are sets already and aren't made distinct, which would be a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import AGGREGATES, DRAW
from ..functions.builtins import bare, function, predicate
from ..functions.values import SPARK_TYPES, UNION, Val, before, cast_to, common, const, equal, kind_of, plain, slots, sort_key
from ..sources.scratch import counted, written
from ..sources.views import TX0, VALUE, View, coerced
from .query import BLANK, Aggregate, Binding, BudgetError, Call, Lookup, Not, Or, Pattern, PullFind, Query, QueryError, RuleCall, Var, parse_query, vars_of

MAX_ROUNDS = 1000
#: Rounds after which the rows of a recursive rule are written as one.
FOLD = 12
#: Cells (rows times columns) that a product, or a recursive rule, may have unless the caller says otherwise.
BUDGET = 1_572_864


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    kinds: Mapping[str, str]
    consts: Mapping[str, Any] = field(default_factory=dict)
    nullable: frozenset = frozenset()
    key: frozenset | None = None  # variables that no two rows share all of; None: rows may repeat
    single: bool = False  # a literal of one row, which multiplies nothing
    names: Mapping[str, str] = field(default_factory=dict)  # variables whose value tells another's, an entity's

    def val(self, name: str) -> Val:
        return Val(self.df[f"`{name}`"], self.kinds[name], self.consts.get(name))

    def has(self, v: Var) -> bool:
        return v.name in self.kinds

    def only(self, names: Sequence[str], distinct: bool = True) -> Relation:
        df = self.df.select(*[self.df[f"`{n}`"] for n in names])
        kept = self.key if self.key is not None and self.key <= set(names) else None
        told = {e: n for n, e in self.names.items() if n in names}
        if kept is None and self.key is not None and self.key <= {*names, *told}:
            kept = frozenset(n if n in names else told[n] for n in self.key)
        if distinct and kept is None:
            df, kept = df.distinct(), frozenset(names)
        return Relation(df, {n: self.kinds[n] for n in names}, {n: c for n, c in self.consts.items() if n in names}, self.nullable & set(names), kept, names={n: e for n, e in self.names.items() if n in names and e in names})


@dataclass
class Context:
    sources: dict[str, View]
    rules: dict[str, list] = field(default_factory=dict)
    functions: dict[str, Any] = field(default_factory=dict)
    budget: int | None = None
    steps: list[dict] = field(default_factory=list)
    solved: dict[str, Relation] = field(default_factory=dict)  # recursive rules while and after they are solved

    @property
    def view(self) -> View:
        return self.sources["$"]

    @property
    def spark(self):
        return next(iter(self.sources.values())).spark


# joins


def join(ctx: Context, a: Relation | None, b: Relation, how: str = "inner") -> Relation:
    """Natural join (inner or left) by value equality; of nulls too where a side may hold them."""
    if a is None:
        return b
    shared = [n for n in b.kinds if n in a.kinds]
    right = b.df.toDF(*[f"__r_{n}" for n in b.df.columns])
    conds = []
    for n in shared:
        x, y = a.val(n), Val(right[f"`__r_{n}`"], b.kinds[n])
        if x.cls == y.cls and x.kind != "any" and n not in a.nullable and n not in b.nullable:
            conds.append(x.col == y.col)
        else:
            conds.append(equal(x, y))
    product = not shared and b.kinds and a.consts.keys() != a.kinds.keys() and not (a.single or b.single)
    if product and ctx.budget is not None:
        cells = a.df.count() * right.count() * (len(a.kinds) + len(b.kinds))
        if cells > ctx.budget:
            raise BudgetError(f"a product of {cells} cells is over the budget of {ctx.budget}")
    elif product and how == "inner":
        # its work is its pairs, not its bytes (files of a few MB would be a task or two): a square of tasks
        side = math.ceil(max(int(ctx.spark.conf.get("spark.sql.shuffle.partitions")), ctx.spark.sparkContext.defaultParallelism) ** 0.5)
        a = replace(a, df=a.df.repartition(side))
        right = right.repartition(side).hint("shuffle_replicate_nl")
    joined = a.df.join(right, reduce(lambda p, q: p & q, conds), how) if conds else (a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how))
    new = [n for n in b.kinds if n not in a.kinds]
    df = joined.select(*[a.df[f"`{n}`"] for n in a.kinds], *[right[f"`__r_{n}`"].alias(n) for n in new])
    ctx.steps.append({"strategy": f"{how}-join" if shared else "product", "on": shared, "adds": new})
    key = None
    if a.key is not None and b.key is not None:
        key = a.key if b.key <= set(shared) else b.key if how == "inner" and a.key <= set(shared) else a.key | b.key
    # where a left join finds nothing, an empty value tells no entity that was there before
    names = {**{n: e for n, e in b.names.items() if (n in new and e in new if how == "left" else all(a.kinds.get(x, b.kinds[x]) == b.kinds[x] for x in (n, e)))}, **a.names}
    return Relation(df, {**a.kinds, **{n: b.kinds[n] for n in new}}, {**b.consts, **a.consts}, a.nullable | b.nullable | (frozenset(new) if how == "left" else frozenset()), key, names=names)


def anti(ctx: Context, a: Relation, b: Relation, on: Sequence[str]) -> Relation:
    right = b.df.toDF(*[f"__r_{n}" for n in b.df.columns])
    conds = [a.val(n).col == right[f"`__r_{n}`"] if a.val(n).cls == Val(None, b.kinds[n]).cls and a.kinds[n] != "any" and n not in a.nullable | b.nullable else equal(a.val(n), Val(right[f"`__r_{n}`"], b.kinds[n])) for n in on]
    ctx.steps.append({"strategy": "anti-join", "on": list(on)})
    return replace(a, df=a.df.join(right, reduce(lambda p, q: p & q, conds) if conds else F.lit(True), "left_anti"))


# patterns


def _entity_const(view: View, x, attr=None):
    """An id for a constant in an entity place or a reference's value."""
    return view.entid(x)


def pattern(ctx: Context, p: Pattern, bound: Relation | None) -> Relation:
    view = _source(ctx, p.src)
    known = bound.consts if bound else {}
    fixed = lambda x: known.get(x.name, x) if isinstance(x, Var) and x != BLANK else x
    a = fixed(p.a)
    if isinstance(a, Lookup):
        a = view.entid(a)
    want_tx = p.tx != BLANK or p.op != BLANK
    cols: list[tuple[Any, Column, str]] = []
    key = None
    if isinstance(a, Var):
        df = view.everything()
        cols = [(p.e, df["e"], "ref"), (p.a, df["a"], "ref"), (p.v, F.struct(*[df[c] for c in VALUE]), "any"), (p.tx, df["t"] + F.lit(TX0), "ref"), (p.op, df["op"], "boolean")]
    else:
        attr = view.schema.attr(a)
        df = view.relation(attr, want_tx)
        if not view.past:
            # an entity has a single value once; it has each of many values once
            parts = [p.e] if not attr.many or p.v == BLANK or not isinstance(fixed(p.v), Var) else [p.e, p.v]
            key = frozenset(x.name for x in parts if isinstance(x, Var)) if BLANK not in parts else None
        cols = [(p.e, df["e"], "ref"), (p.v, df["v"], attr.kind)]
        if want_tx:
            cols += [(p.tx, df["t"] + F.lit(TX0), "ref"), (p.op, df["op"], "boolean")]
        if isinstance(p.a, Var) and p.a != BLANK:
            cols.append((p.a, F.lit(attr.id).cast("bigint"), "ref"))
    out: dict[str, tuple[Column, str]] = {}
    for x, col, kind in cols:
        y = fixed(x)
        if not isinstance(y, Var):
            df = df.where(_matches(view, y, col, kind))
        if isinstance(x, Var) and x != BLANK:
            if x.name in out:
                df = df.where(equal(Val(out[x.name][0], out[x.name][1]), Val(col, kind)))
            else:
                out[x.name] = col, kind
    shown = df.select(*[c.alias(n) for n, (c, _) in out.items()]) if out else df.select(F.lit(1).alias("__one")).limit(1)
    if not out or p.v == BLANK and (key is None or attr.many):
        shown, key = shown.distinct(), frozenset(out)
    named = not isinstance(a, Var) and isinstance(p.e, Var) and isinstance(p.v, Var) and BLANK not in (p.e, p.v) and p.e != p.v and view.identifies(attr)
    return Relation(shown, {n: k for n, (_, k) in out.items()}, key=key, names={p.v.name: p.e.name} if named else {})


def _matches(view: View, x, col: Column, kind: str) -> Column:
    if kind == "ref":
        eid = view.entid(x) if isinstance(x, (str, Lookup, int)) and not isinstance(x, bool) else None
        return col == F.lit(eid) if eid is not None else F.lit(False)
    if isinstance(x, Lookup):
        raise QueryError("a lookup reference stands for an entity")
    if kind == "any":
        if isinstance(x, str) and x.startswith(":") and view.entid(x) is not None:
            return col["v_long"] == F.lit(view.entid(x))
        return equal(Val(col, kind), const(x))
    if kind == "instant" and isinstance(x, str):
        x = coerced(kind, x)
        return col == F.lit(x)
    c = const(x)
    return col == F.lit(coerced(kind, x)).cast(SPARK_TYPES[kind]) if c.cls == Val(col, kind).cls and (kind != "long" or float(plain(x)).is_integer()) else F.lit(False)


def _source(ctx: Context, name: str) -> View:
    if name not in ctx.sources:
        raise QueryError(f"no source {name}")
    return ctx.sources[name]


def stars(ctx: Context, clauses: Sequence) -> list:
    """Clauses with the single-valued patterns of one entity variable taken together as tuples of patterns."""
    groups: dict[tuple, list[Pattern]] = {}
    rest = []
    for c in clauses:
        if isinstance(c, Pattern) and isinstance(c.e, Var) and c.e != BLANK and isinstance(c.a, str) and c.tx == BLANK and c.op == BLANK and not _source(ctx, c.src).past:
            attr = _source(ctx, c.src).schema.attr(c.a)
            own = groups.setdefault((c.src, c.e, attr.namespace), [])
            if not attr.many and attr.ident not in [x.a for x in own]:
                own.append(replace(c, a=attr.ident))
                continue
        rest.append(c)
    for own in groups.values():
        rest += [tuple(own)] if len(own) > 1 else own
    return rest


def star(ctx: Context, own: tuple[Pattern, ...], bound: Relation | None) -> Relation:
    view = _source(ctx, own[0].src)
    attrs = [view.schema.attr(p.a) for p in own]
    df = view.star(attrs)
    if df is None:
        return reduce(lambda r, p: join(ctx, r, pattern(ctx, p, bound)), own, None)
    known = bound.consts if bound else {}
    e = own[0].e
    if e.name in known:
        df = df.where(_matches(view, known[e.name], df["e"], "ref"))
    out = {e.name: (df["e"], "ref")}
    names = {}
    for p, attr in zip(own, attrs):
        col = df[f"`{attr.ident}`"]
        x = known.get(p.v.name, p.v) if isinstance(p.v, Var) and p.v != BLANK else p.v
        df = df.where(_matches(view, x, col, attr.kind) if not isinstance(x, Var) else col.isNotNull())
        if isinstance(p.v, Var) and p.v != BLANK:
            if p.v.name in out:
                df = df.where(equal(Val(*out[p.v.name]), Val(col, attr.kind)))
            else:
                out[p.v.name] = col, attr.kind
                if view.identifies(attr):
                    names[p.v.name] = e.name
    ctx.steps.append({"strategy": "star", "on": [e.name], "attributes": [a.ident for a in attrs]})
    return Relation(df.select(*[c.alias(n) for n, (c, _) in out.items()]), {n: k for n, (_, k) in out.items()}, key=frozenset([e.name]), names=names)


# clauses


def solve(ctx: Context, rel: Relation | None, clauses: Sequence) -> Relation | None:
    todo = stars(ctx, list(clauses))
    while todo:
        k = _next(ctx, rel, todo)
        rel = apply(ctx, rel, todo.pop(k))
    return rel


def _vars(c) -> set[Var]:
    return set().union(*map(vars_of, c)) if isinstance(c, tuple) else vars_of(c)


def _needs(c, later: Sequence) -> set[Var]:
    """Variables that must be bound before a clause runs."""
    if isinstance(c, Call):
        own = {x for x in c.args if isinstance(x, Var) and x != BLANK}
        return own
    if isinstance(c, Not):
        around = set().union(*map(_vars, later)) if later else set()
        return vars_of(c) & around
    if isinstance(c, Or):
        return set(c.required)
    return set()


def _positive(c) -> bool:
    return isinstance(c, (Pattern, tuple, RuleCall, Or)) or isinstance(c, Call) and c.binding is not None


def _given(ctx: Context, c) -> set[str]:
    """Variables that a clause binds through patterns, whatever is bound before it."""
    if isinstance(c, (Pattern, tuple)):
        return {v.name for v in _vars(c)}
    if isinstance(c, Or) and c.branches:
        own = set.intersection(*[set().union(*[_given(ctx, x) for x in b]) for b in c.branches])
        return (own & {v.name for v in c.join} if c.join is not None else own) - {v.name for v in c.required}
    if isinstance(c, RuleCall) and c.name in ctx.rules:
        if c.name in ctx.solved or c.name in _reach(ctx.rules, c.name):
            return {v.name for v in vars_of(c)}
        bodies = [(head, set().union(*[_given(ctx, x) for x in body])) for head, body in ctx.rules[c.name]]
        return {a.name for k, a in enumerate(c.args) if isinstance(a, Var) and all(k < len(head) and head[k].name in own for head, own in bodies)}
    return set()


def _waits(ctx: Context, c: Call, bound: set[str], todo: Sequence) -> bool:
    """Whether ground values are better compared, once other clauses have bound their variables, than multiplied."""
    own = {v.name for v in c.binding.vars if v != BLANK}
    if bare(c.fn) != "ground" or c.binding.kind not in ("coll", "rel") or isinstance(c.args[0], Var) or len(c.args[0]) < 2 or not bound or own & bound:
        return False
    reached, links = set(bound), []
    for x in todo:
        if not isinstance(x, Call) and _positive(x):
            names, given = {v.name for v in _vars(x)}, _given(ctx, x)
            if names <= given:
                links.append(given)
            elif names & own:
                return False  # needs the values
    while near := [g for g in links if g & reached and not g <= reached]:
        reached = reached.union(*near)
    return bool(own & reached)


def _next(ctx: Context, rel: Relation | None, todo: Sequence) -> int:
    bound = set(rel.kinds) if rel else set()
    best, score = None, None
    for k, c in enumerate(todo):
        others = [x for j, x in enumerate(todo) if j != k and _positive(x)]
        need = {v.name for v in _needs(c, others)}
        if isinstance(c, Call) and predicate(c.fn) and c.binding is None or isinstance(c, Not) or isinstance(c, Call):
            if not need <= bound:
                continue
            # behind the clauses that bind its variables
            rank = 4 if isinstance(c, Call) and c.binding is not None and _waits(ctx, c, bound, todo) else 0
        else:
            if not need <= bound:
                continue
            names = {v.name for v in _vars(c)}
            fixed = sum(not isinstance(x, Var) for p in (c if isinstance(c, tuple) else [c]) if isinstance(p, Pattern) for x in (p.e, p.v))
            rank = (1 if rel is None or names & bound else 5) + (1 if isinstance(c, Or) else 0) + (2 if isinstance(c, RuleCall) else 0) - 0.1 * fixed
        if score is None or rank < score:
            best, score = k, rank
    if best is None:
        c = todo[0]
        lack = sorted({str(v) for v in _needs(c, [])} - {"?" + n for n in bound})
        raise QueryError(f"insufficient bindings: {', '.join(lack) or c}")
    return best


def apply(ctx: Context, rel: Relation | None, c) -> Relation:
    if isinstance(c, tuple):
        return join(ctx, rel, star(ctx, c, rel))
    if isinstance(c, Pattern):
        return join(ctx, rel, pattern(ctx, c, rel))
    if isinstance(c, Call):
        return call(ctx, rel, c)
    if isinstance(c, Not):
        return negate(ctx, rel, c)
    if isinstance(c, Or):
        return either(ctx, rel, c)
    return rule(ctx, rel, c)


def _unit(ctx: Context, rel: Relation | None) -> Relation:
    return rel if rel is not None else Relation(ctx.spark.range(1).select(F.lit(1).alias("__one")), {}, key=frozenset())


def _arg(rel: Relation, x) -> Val:
    if isinstance(x, Var):
        if not rel.has(x):
            raise QueryError(f"insufficient bindings: {x}")
        return rel.val(x.name)
    return const(x)


def call(ctx: Context, rel: Relation | None, c: Call) -> Relation:
    name = bare(c.fn)
    if name in ("get-else", "missing?"):
        return _attribute_call(ctx, _unit(ctx, rel), name, c)
    if c.binding is None:
        rel = _unit(ctx, rel)
        test = predicate(name)
        if test is not None:
            return replace(rel, df=rel.df.where(test(*[_arg(rel, x) for x in c.args])))
        if name in ctx.functions:
            return replace(rel, df=rel.df.where(_user(ctx, rel, name, [_arg(rel, x) for x in c.args]).col))
        raise QueryError(f"unknown predicate {c.fn}")
    if name == "ground" and not isinstance(c.args[0], Var):
        return join(ctx, rel, bind_rows(ctx, c.binding, c.args[0]))
    rel = _unit(ctx, rel)
    if name in ctx.functions:
        value = _user(ctx, rel, name, [_arg(rel, x) for x in c.args])
    elif function(name) is not None:
        value = function(name)(*[_arg(rel, x) for x in c.args])
    else:
        raise QueryError(f"unknown function {c.fn}")
    return _bind_column(ctx, rel, c.binding, value)


def _user(ctx: Context, rel: Relation, name: str, args: list[Val]) -> Val:
    """A user function: (callable, kind) of Python values, sent in Arrow batches, or a callable that takes and gives
    columns."""
    fn = ctx.functions[name]
    if isinstance(fn, tuple):
        f, kind = fn
        returns = SPARK_TYPES.get(kind, kind)
        return Val(F.udf(f, returns, useArrow=True)(*[a.col for a in args]), kind if kind in SPARK_TYPES else _kind_of_type(T.DataType.fromDDL(returns)))
    col = fn(*[a.col for a in args])
    return Val(col, _kind_of_type(rel.df.select(col.alias("__x")).schema["__x"].dataType))


def _kind_of_type(kind: T.DataType) -> str:
    """The kind of a column that a user's function or a generator gives."""
    if isinstance(kind, T.ArrayType):
        return f"list:{_kind_of_type(kind.elementType)}"
    if isinstance(kind, T.StructType):
        return "any" if "vt" in kind.names else "tuple:" + ",".join(_kind_of_type(f.dataType) for f in kind.fields)
    if isinstance(kind, T.IntegralType):
        return "long"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "double"
    return {"boolean": "boolean", "binary": "bytes"}.get(kind.simpleString(), "string")


def _bind_column(ctx: Context, rel: Relation, binding: Binding, value: Val) -> Relation:
    names = [v.name for v in binding.vars]
    kept = [rel.df[f"`{n}`"] for n in rel.kinds]
    if binding.kind == "scalar":
        if binding.vars[0] == BLANK:
            return replace(rel, df=rel.df.where(value.col.isNotNull()))
        if rel.has(binding.vars[0]):
            return replace(rel, df=rel.df.where(equal(rel.val(names[0]), value)))
        df = rel.df.select(*kept, value.col.alias(names[0])).where(F.col(f"`{names[0]}`").isNotNull())
        return Relation(df, {**rel.kinds, names[0]: value.kind}, rel.consts, rel.nullable, rel.key)
    if not value.several:
        raise QueryError(f"a {value.kind} isn't a collection to take apart")
    if binding.kind == "coll":
        items = value
        if value.kind.startswith("tuple"):
            kind = common(value.inner)
            items = Val(F.array(*[cast_to(Val(value.col[f"_{k}"], own), kind) for k, own in enumerate(value.inner)]), f"list:{kind}")
        df = rel.df.select(*kept, F.explode(items.col).alias("__x"))
        inner = items.kind.partition(":")[2] or "string"  # of a list of lists: the inner list
        new = Relation(df, {**rel.kinds, "__x": inner}, rel.consts, rel.nullable)
        return _settle(new, [("__x", binding.vars[0])], nullable=True)
    if binding.kind == "rel":
        df = rel.df.select(*kept, F.explode(value.col).alias("__x"))
        cells = [(F.get(F.col("__x"), F.lit(k)), v) for k, v in enumerate(binding.vars)]
    else:
        df = rel.df.select(*kept, value.col.alias("__x"))
        tuple_ = value.kind.startswith("tuple")
        if tuple_ and len(binding.vars) > len(value.inner):
            raise QueryError(f"a tuple of {len(value.inner)} places can't bind {len(binding.vars)} variables")
        cells = [(F.col("__x")[f"_{k}"] if tuple_ else F.get(F.col("__x"), F.lit(k)), v) for k, v in enumerate(binding.vars)]
    df = df.select(*[F.col(f"`{n}`") for n in rel.kinds], *[c.alias(f"__x{k}") for k, (c, _) in enumerate(cells)])
    kinds = {}
    for k in range(len(cells)):
        known = value.inner[k] if value.kind.startswith("tuple") else value.inner[0] if binding.kind == "tuple" else ""
        kinds[f"__x{k}"] = known if known in SPARK_TYPES or known == "any" else _kind_of_type(df.schema[f"__x{k}"].dataType)
    return _settle(Relation(df, {**rel.kinds, **kinds}, rel.consts, rel.nullable, rel.key if binding.kind == "tuple" else None), [(f"__x{k}", v) for k, (_, v) in enumerate(cells)])


def _settle(rel: Relation, moves: list[tuple[str, Var]], nullable: bool = False) -> Relation:
    """Give temporary columns their variables' names; where bound already, compare instead."""
    df, kinds, null = rel.df, dict(rel.kinds), set(rel.nullable)
    for temp, v in moves:
        if v == BLANK:
            df = df.drop(temp)
        elif v.name in kinds:
            df = df.where(equal(Val(df[f"`{v.name}`"], kinds[v.name]), Val(df[f"`{temp}`"], kinds[temp]))).drop(temp)
        else:
            df = df.withColumnRenamed(temp, v.name)
            kinds[v.name] = kinds[temp]
            if nullable:
                null.add(v.name)
        kinds.pop(temp)
    return Relation(df, kinds, rel.consts, frozenset(null), rel.key)


def bind_rows(ctx: Context, binding: Binding, value) -> Relation:
    """A relation of constants: an input or a ground literal."""
    rows = {"scalar": lambda: [(value,)], "tuple": lambda: [tuple(value)], "coll": lambda: [(x,) for x in value], "rel": lambda: [tuple(r) for r in value]}[binding.kind]()
    if any(len(r) != len(binding.vars) for r in rows):
        raise QueryError("a row of the input doesn't fit its binding")
    places = [(k, v) for k, v in enumerate(binding.vars) if v != BLANK]
    kinds, null = {}, set()
    for k, v in places:
        kinds[v.name] = common(kind_of(r[k]) for r in rows)
        if any(r[k] is None for r in rows):
            null.add(v.name)
    schema = ", ".join(f"`{v.name}` {UNION if kinds[v.name] == 'any' else SPARK_TYPES.get(kinds[v.name], 'string')}" for _, v in places)
    cells = [tuple(None if r[k] is None else slots(r[k]) if kinds[v.name] == "any" else coerced(kinds[v.name], r[k]) for k, v in places) for r in rows]
    df = ctx.spark.createDataFrame(list(dict.fromkeys(cells)), schema) if places else ctx.spark.range(1 if rows else 0).select(F.lit(1).alias("__one"))
    single = {v.name: rows[0][k] for k, v in places if len(rows) == 1 and rows[0][k] is not None}
    return Relation(df, kinds, single, frozenset(null), frozenset(kinds), len(set(cells)) < 2)


def _attribute_call(ctx: Context, rel: Relation, name: str, c: Call) -> Relation:
    args = list(c.args)
    src = args.pop(0) if isinstance(args[0], str) and args[0].startswith("$") else "$"
    view = _source(ctx, src)
    attr = view.schema.attr(args[1].attr if isinstance(args[1], Lookup) else args[1])
    e = _arg(rel, args[0]) if isinstance(args[0], Var) else const(view.entid(args[0]))
    facts = view.relation(attr).select(F.col("e").alias("__e"), F.col("v").alias("__v"))
    if name == "missing?":
        return replace(rel, df=rel.df.join(facts, e.col == facts["__e"], "left_anti"))
    default = const(args[2])
    df = rel.df.join(facts, e.col == facts["__e"], "left")
    value = Val(facts["__v"], attr.kind)
    kind = common((attr.kind, default.kind))
    out = F.coalesce(cast_to(value, kind), cast_to(default, kind))
    base = Relation(df.select(*[rel.df[f"`{n}`"] for n in rel.kinds], out.alias("__x")), {**rel.kinds, "__x": kind}, rel.consts, rel.nullable, None if attr.many or view.past else rel.key)
    return _settle(base, [("__x", c.binding.vars[0])]) if c.binding else base


def _inner(ctx: Context, rel: Relation | None, clauses: Sequence, shared: Sequence[str]) -> Relation:
    """Clauses on their own, or, where they need variables from outside, on those variables' values."""
    own = set().union(*[{v.name for v in _vars(c)} for c in clauses if _positive(c)]) if clauses else set()
    need = set().union(*[{v.name for v in _vars(c)} for c in clauses if not _positive(c) or isinstance(c, Call)]) if clauses else set()
    positives = any(_positive(c) and not isinstance(c, Call) for c in clauses)
    start = None
    if rel is not None and (need - own or not positives or any(isinstance(c, (Call, Not)) for c in clauses)):
        names = [n for n in rel.kinds if n in shared or n in need]
        start = rel.only(names) if names else None
    out = solve(ctx, start, clauses)
    return out if out is not None else _unit(ctx, None)


def negate(ctx: Context, rel: Relation | None, c: Not) -> Relation:
    rel = _unit(ctx, rel)
    if not c.clauses:
        return replace(rel, df=rel.df.where(F.lit(False)))
    shared = [v.name for v in (c.join if c.join is not None else sorted(vars_of(c), key=str)) if rel.has(v)]
    if c.join is not None and any(not rel.has(v) for v in c.join):
        raise QueryError("insufficient bindings for not-join")
    inner = _inner(ctx, rel, c.clauses, shared)
    return anti(ctx, rel, inner, [n for n in shared if n in inner.kinds])


def _optional(c: Or) -> tuple | None:
    """The path and the variable of the optional idiom, if this is one."""
    if len(c.branches) != 2:
        return None
    path, other = c.branches
    nots = [x for x in other if isinstance(x, Not)]
    ground = [x for x in other if isinstance(x, Call) and x.fn == "ground" and x.binding and x.binding.kind == "coll" and list(x.args[0] or ()) == [None]]
    if len(other) != 2 or len(nots) != 1 or len(ground) != 1:
        return None
    v = ground[0].binding.vars[0]
    strip = lambda cs: [replace(p, v=BLANK) if isinstance(p, Pattern) and p.v == v else p for p in cs]
    return (path, v) if strip(path) == strip(nots[0].clauses) or list(path) == list(nots[0].clauses) else None


def either(ctx: Context, rel: Relation | None, c: Or) -> Relation:
    if not c.branches:
        rel = _unit(ctx, rel)
        return replace(rel, df=rel.df.where(F.lit(False)))
    names = {v.name for v in c.join} if c.join is not None else {v.name for b in c.branches for x in b for v in vars_of(x)}
    if c.join is None and len({frozenset(v for x in b for v in vars_of(x)) for b in c.branches}) > 1:
        raise QueryError("the branches of or use different variables")
    found = _optional(c)
    if found and rel is not None:
        path, v = found
        inner = solve(ctx, None, path)
        keep = [n for n in inner.kinds if n in names]
        return join(ctx, rel, inner.only(keep), "left")
    parts = []
    for b in c.branches:
        inner = _inner(ctx, rel, b, [n for n in names if rel is not None and n in rel.kinds])
        lack = [n for n in names if n not in inner.kinds]
        if lack:
            outer = [n for n in lack if rel is not None and n in rel.kinds]
            if len(outer) < len(lack):
                raise QueryError(f"a branch of or doesn't bind {', '.join('?' + n for n in lack)}")
            inner = join(ctx, rel.only(outer), inner)
        parts.append(inner.only(sorted(names), distinct=False))
    return join(ctx, rel, union(parts))


def union(parts: Sequence[Relation]) -> Relation:
    kinds: dict[str, str] = {}
    for n in parts[0].kinds:
        kinds[n] = common(p.kinds[n] for p in parts)
    frames = [p.df.select(*[cast_to(Val(F.col(f"`{n}`"), p.kinds[n]), k).alias(n) for n, k in kinds.items()]) for p in parts]
    return Relation(reduce(DataFrame.unionByName, frames).distinct(), kinds, {}, frozenset().union(*[p.nullable for p in parts]), frozenset(kinds))


# rules


def _calls(clauses) -> set[str]:
    out: set[str] = set()
    for c in clauses:
        if isinstance(c, RuleCall):
            out.add(c.name)
        elif isinstance(c, Not):
            out |= _calls(c.clauses)
        elif isinstance(c, Or):
            for b in c.branches:
                out |= _calls(b)
    return out


def _reach(rules: Mapping, name: str) -> set[str]:
    seen: set[str] = set()
    todo = [name]
    while todo:
        for n in {x for _, body in rules[todo.pop()] for x in _calls(body)} - seen:
            seen.add(n)
            todo.append(n)
    return seen


def _negated(clauses) -> set[str]:
    out: set[str] = set()
    for c in clauses:
        if isinstance(c, Not):
            out |= _calls(c.clauses)
        elif isinstance(c, Or):
            for b in c.branches:
                out |= _negated(b)
    return out


def rule(ctx: Context, rel: Relation | None, c: RuleCall) -> Relation:
    if c.name not in ctx.rules:
        raise QueryError(f"unknown rule {c.name}")
    if len(ctx.rules[c.name][0][0]) != len(c.args):
        raise QueryError(f"rule {c.name} takes {len(ctx.rules[c.name][0][0])} arguments")
    if c.name not in ctx.solved and c.name in _reach(ctx.rules, c.name):
        fixpoint(ctx, c.name)
    if c.name in ctx.solved:
        base = ctx.solved[c.name]
        heads = [f"__{k}" for k in range(len(c.args))]
    else:
        parts = []
        for head, body in ctx.rules[c.name]:
            own = {v.name for v in head}
            needs_outer = any(isinstance(x, (Call, Not)) for x in body)
            outer = None
            if rel is not None and needs_outer:
                # give the body the values of the arguments that are bound outside
                moved = [(a.name, h.name) for a, h in zip(c.args, head) if isinstance(a, Var) and rel.has(a)]
                if moved and len({a for a, _ in moved}) == len(moved):
                    base_ = rel.only([a for a, _ in moved])
                    outer = Relation(base_.df.toDF(*[h for _, h in moved]), {h: base_.kinds[a] for a, h in moved}, {h: base_.consts[a] for a, h in moved if a in base_.consts}, frozenset(h for a, h in moved if a in base_.nullable))
            solved = solve(ctx, outer, body)
            if solved is None or not own <= set(solved.kinds):
                raise QueryError(f"rule {c.name} doesn't bind its head")
            solved = solved.only([v.name for v in head], distinct=False)
            parts.append(Relation(solved.df.toDF(*[f"__{k}" for k in range(len(head))]), {f"__{k}": solved.kinds[v.name] for k, v in enumerate(head)}, {}, frozenset(f"__{k}" for k, v in enumerate(head) if v.name in solved.nullable)))
        base, heads = union(parts), [f"__{k}" for k in range(len(c.args))]
    df, kinds = base.df, dict(base.kinds)
    moves = []
    for h, a in zip(heads, c.args):
        if isinstance(a, Var):
            moves.append((h, a))
        else:
            if kinds[h] == "ref":
                df = df.where(_matches(ctx.view, a, df[h], "ref"))
            else:
                df = df.where(equal(Val(df[h], kinds[h]), const(a)))
            df = df.drop(h)
            kinds.pop(h)
    out = _settle(Relation(df, kinds, {}, base.nullable), moves)
    if any(a == BLANK for a in c.args):
        out = replace(out, df=out.df.distinct() if out.kinds else out.df.limit(1))
    out = replace(out, key=frozenset(out.kinds))  # base is a union, made distinct, or a solved rule: a set
    return join(ctx, rel, out)


def fixpoint(ctx: Context, name: str) -> None:
    """Solve a recursive rule and those that it recurs with. Each round's new rows are what the bodies give on the
    last round's new rows (a body with several recursive calls runs once for each of them), less all known rows."""
    group = {n for n in _reach(ctx.rules, name) if name in _reach(ctx.rules, n)} | {name}
    for n in group:
        for _, body in ctx.rules[n]:
            if _negated(body) & group:
                raise QueryError(f"rule {n} recurs through a negation")

    def given(n: str, head, body) -> Relation | None:
        solved = solve(ctx, None, body)
        if solved is None or not {v.name for v in head} <= set(solved.kinds):
            raise QueryError(f"rule {n} doesn't bind its head")
        solved = solved.only([v.name for v in head], distinct=False)
        return Relation(solved.df.toDF(*[f"__{k}" for k in range(len(head))]), {f"__{k}": solved.kinds[v.name] for k, v in enumerate(head)})

    total: dict[str, Relation] = {}
    held: dict[str, int] = {}  # rows of total
    bases = {n: [(h, b) for h, b in ctx.rules[n] if not _calls(b) & group] for n in group}
    waiting = set(group)
    while waiting:  # a rule without a base takes its kinds from the rules that it calls
        ready = [n for n in waiting if bases[n] or any(_calls(b) & group <= set(total) for _, b in ctx.rules[n])]
        if not ready:
            raise QueryError(f"rule {name} has no branch without recursion")
        for n in ready:
            if bases[n]:
                total[n] = union([given(n, h, b) for h, b in bases[n]])
            else:
                ctx.solved.update(total)
                h, b = next((h, b) for h, b in ctx.rules[n] if _calls(b) & group <= set(total))
                found = union([given(n, h, b)])
                total[n] = replace(found, df=found.df.where(F.lit(False)))
            rows, held[n] = counted(total[n].df, "rule")
            total[n] = replace(total[n], df=rows)
            waiting.discard(n)
    delta = dict(total)
    for turn in range(1, MAX_ROUNDS):
        fresh: dict[str, Relation] = {}
        sizes: dict[str, int] = {}
        for n in group:
            parts = []
            for head, body in ctx.rules[n]:
                for k, call_ in enumerate(body):
                    if isinstance(call_, RuleCall) and call_.name in group:
                        ctx.solved.update(total)
                        alias = f"__new_{call_.name}"
                        ctx.solved[alias], ctx.rules[alias] = delta[call_.name], ctx.rules[call_.name]
                        parts.append(given(n, head, [*body[:k], RuleCall(alias, call_.args), *body[k + 1 :]]))
                if _calls(body) & group and not any(isinstance(x, RuleCall) and x.name in group for x in body):
                    ctx.solved.update(total)  # recursion inside or: all rows again
                    parts.append(given(n, head, body))
            if parts:
                found = union(parts)
                keys = list(total[n].kinds)
                new = found.df.select(*[F.col(k).cast(total[n].df.schema[k].dataType).alias(k) for k in keys]).join(total[n].df, keys, "left_anti")
                rows, sizes[n] = counted(new, "round")
                fresh[n] = replace(total[n], df=rows)
        if not any(sizes.values()):
            break
        for n, s in sizes.items():
            held[n] += s
        if ctx.budget is not None and sum(held[n] * len(r.kinds) for n, r in total.items()) > ctx.budget:
            raise BudgetError(f"rule {name} is over the budget of {ctx.budget} cells")
        for n in group:
            delta[n] = fresh.get(n, replace(total[n], df=total[n].df.where(F.lit(False))))
            if sizes.get(n):
                total[n] = replace(total[n], df=total[n].df.unionByName(delta[n].df))
                if turn % FOLD == 0:  # else the plan grows with the rounds
                    total[n] = replace(total[n], df=written(total[n].df, "rule"))
    else:
        raise QueryError(f"rule {name} doesn't settle in {MAX_ROUNDS} rounds")
    for n in group:
        ctx.rules.pop(f"__new_{n}", None)
        ctx.solved.pop(f"__new_{n}", None)
    ctx.solved.update(total)
    ctx.steps.append({"strategy": "fixpoint", "rules": sorted(group)})


# results


@dataclass
class Result:
    """A compiled query: `df` has its rows, `value()` the shape that :find asks for."""

    df: DataFrame
    shape: str
    names: list[str]
    kinds: dict[str, str]
    steps: list[dict]
    keyed: bool = False

    def explain(self) -> dict:
        """The compiler's steps, in order, and Spark's plan."""
        return {"steps": self.steps, "plan": self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))}

    def rows(self) -> list:
        out = []
        for r in self.df.collect():
            cells = [_shown(r[n], self.kinds.get(n)) for n in self.names]
            out.append(dict(zip(self.names, cells)) if self.keyed else cells)
        return out

    def value(self):
        if self.shape == "rel":
            return self.rows()
        if self.shape == "coll":
            return [r[0] for r in self.rows()]
        first = self.df.limit(1).collect()
        if not first:
            return None
        cells = [_shown(first[0][n], self.kinds.get(n)) for n in self.names]
        return cells if self.shape == "tuple" else cells[0]


def _shown(x, kind: str | None):
    if kind == "tree":
        from ..operators.pull import tree

        return tree(x)
    if hasattr(x, "asDict"):
        return next((x[f] for f in VALUE[1:] if x[f] is not None), None) if "vt" in x else x.asDict(recursive=True)
    return [_shown(y, kind) for y in x] if isinstance(x, list) else x


def _column_name(f) -> str:
    if isinstance(f, Var):
        return f.name
    if isinstance(f, PullFind):
        return f.alias or f.var.name
    return f.alias or f"{f.fn}_{f.var.name}"


def run_query(sources: View | Mapping[str, View], source, *inputs, functions: Mapping[str, Any] | None = None, budget: int | None = BUDGET) -> Result:
    """Compile a query against one database or several named ones; inputs follow :in, databases left out. budget:
    cells that a product or a recursive rule may have (None: any number)."""
    q = parse_query(source)
    db = dict(sources) if isinstance(sources, Mapping) else {"$": sources}
    ctx = Context(db, dict(q.rules), dict(functions or {}), budget)
    rel: Relation | None = None
    values = list(inputs)
    pull_patterns: dict[str, Any] = {}
    for x in q.inputs:
        if isinstance(x, str):
            if x.startswith("$") and values and isinstance(values[0], View):
                db[x] = values.pop(0)
                ctx.sources[x] = db[x]
            continue
        if not values:
            raise QueryError("an input is missing")
        value = values.pop(0)
        if x.kind == "scalar" and isinstance(value, (list, dict)):
            pull_patterns[x.vars[0].name] = value
            continue
        rel = join(ctx, rel, bind_rows(ctx, x, value))
    if values:
        raise QueryError("more inputs than :in names")
    rel = _unit(ctx, solve(ctx, rel, q.where))
    return finish(ctx, q, rel, pull_patterns)


def finish(ctx: Context, q: Query, rel: Relation, pull_patterns: Mapping[str, Any]) -> Result:
    """aggregate, having, order, after, offset, limit, pull."""
    elements = q.find
    for f in elements:
        v = f if isinstance(f, Var) else f.var
        if not rel.has(v):
            raise QueryError(f"unbound variable {v} in :find")
    for v in q.with_:
        if not rel.has(v):
            raise QueryError(f"unbound variable {v} in :with")
    names = [_column_name(f) for f in elements]
    if len(set(names)) != len(names):
        names = [n if names.index(n) == k else f"{n}_{k}" for k, n in enumerate(names)]
    aggregates = any(isinstance(f, Aggregate) for f in elements)
    base = list(dict.fromkeys([(f if isinstance(f, Var) else f.var).name for f in elements] + [v.name for v in q.with_]))
    cells: dict[str, Val]
    if aggregates:
        tuples = rel.only(base)
        if any(isinstance(f, Aggregate) and f.fn == "rand" for f in elements):
            tuples = replace(tuples, df=tuples.df.withColumn(DRAW, F.rand()))
        groups = [(n, f) for n, f in zip(names, elements) if not isinstance(f, Aggregate)]
        aggs, kinds = [], {}
        for n, f in zip(names, elements):
            if isinstance(f, Aggregate):
                col, kinds[n] = AGGREGATES[f.fn](f.args, tuples.val(f.var.name))
                aggs.append(col.alias(n))
            else:
                kinds[n] = tuples.kinds[(f if isinstance(f, Var) else f.var).name]
        df = tuples.df.groupBy(*[tuples.df[f"`{(f if isinstance(f, Var) else f.var).name}`"].alias(n) for n, f in groups]).agg(*aggs)
        known = {**{n: n for n in names}, **{f.var.name: n for n, f in zip(names, elements) if isinstance(f, Aggregate)}, **{(f if isinstance(f, Var) else f.var).name: n for n, f in groups}}
        cells = {v: Val(F.col(f"`{n}`"), kinds[n]) for v, n in known.items()}
        for c in q.having:
            df = df.where(_having(cells, c))
        orders = []
        for o in q.order:
            if o.key not in cells:
                raise QueryError(f":order ?{o.key} is neither a group key nor aggregated")
            orders.append((cells[o.key], o))
    else:
        for o in q.order:
            if o.key not in rel.kinds:
                raise QueryError(f"unbound variable ?{o.key} in :order")
        extra = [o.key for o in q.order if o.key not in base]
        tuples = rel.only(base + list(dict.fromkeys(extra)))
        found = [f if isinstance(f, Var) else f.var for f in elements]
        df = tuples.df
        if q.with_ or extra:
            # one row a tuple of find and with; the order key of a tuple with several is the smallest
            keep = base + extra
            df = df.groupBy(*[df[f"`{n}`"] for n in base]).agg(*[F.min(df[f"`{n}`"]).alias(n) for n in dict.fromkeys(extra)]) if extra else df
            df = df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(keep)])
        temp = [f"__f{k}" for k in range(len(found))]
        df = df.select(*[F.col(f"`{v.name}`").alias(t) for t, v in zip(temp, found)], *[F.col(f"`{o.key}`").alias(f"__o{k}") for k, o in enumerate(q.order)])
        kinds = {n: tuples.kinds[v.name] for n, v in zip(names, found)}
        orders = [(Val(F.col(f"__o{k}"), tuples.kinds[o.key]), o) for k, o in enumerate(q.order)]
    if q.after is not None:
        df = df.where(_beyond(orders, q.after))
    keys = []
    for v, o in orders:
        c = F.when(v.col.isNotNull(), sort_key(v)) if v.kind == "any" else v.col
        keys.append((c.desc_nulls_first() if o.empty_first else c.desc_nulls_last()) if o.descending else (c.asc_nulls_first() if o.empty_first else c.asc_nulls_last()))
    if keys:
        df = df.orderBy(*keys)
    if q.offset:
        df = df.offset(q.offset)
    limit = q.limit if q.shape in ("rel", "coll") else min(1, q.limit) if q.limit is not None else 1 if q.shape in ("tuple", "scalar") else None
    if limit is not None:
        df = df.limit(limit)
    if not aggregates:
        df = df.select(*[F.col(t).alias(n) for t, n in zip(temp, names)])
    for n, f in zip(names, elements):
        if isinstance(f, PullFind):
            from ..operators.pull import attach

            pattern_ = f.pattern
            if isinstance(pattern_, str) and pattern_.startswith("?"):
                pattern_ = pull_patterns[pattern_[1:]]
            if keys:
                df = df.withColumn("__row", F.struct(F.monotonically_increasing_id().alias("i")))
            df = attach(ctx.view, df, n, pattern_)
            kinds[n] = "tree"
            if keys:
                df = df.orderBy("__row").drop("__row")
    if q.keys:
        df, names, kinds = df.toDF(*q.keys), list(q.keys), {k: kinds[n] for k, n in zip(q.keys, names)}
    return Result(df, q.shape, names, kinds, ctx.steps, bool(q.keys))


def _having(cells: Mapping[str, Val], c) -> Column:
    if isinstance(c, Not):
        return ~reduce(lambda a, b: a & b, [_having(cells, x) for x in c.clauses])
    if isinstance(c, Or):
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [_having(cells, x) for x in b]) for b in c.branches])
    test = predicate(c.fn)
    if test is None:
        raise QueryError(f"unknown predicate {c.fn}")

    def arg(x) -> Val:
        if isinstance(x, Var):
            if x.name not in cells:
                raise QueryError(f"{x} in :having isn't a cell of :find")
            return cells[x.name]
        return const(x)

    return F.coalesce(test(*[arg(x) for x in c.args]), F.lit(False))


def _beyond(orders: Sequence[tuple[Val, Any]], after: Sequence) -> Column:
    """Rows strictly behind a cursor in the order's sense."""
    out, tie = F.lit(False), F.lit(True)
    for (v, o), x in zip(orders, after):
        c = const(x)
        empty = v.col.isNull()
        if x is None:
            later = ~empty if o.empty_first else F.lit(False)
        else:
            inside = before(v, c) if o.descending else before(c, v)
            later = F.when(empty, F.lit(not o.empty_first)).otherwise(inside)
        out = out | (tie & later)
        tie = tie & equal(v, c)
    return out

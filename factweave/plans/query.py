"""The query model: clauses and sections, and the parser from EDN text, maps, or vectors of sections."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from .. import edn
from ..edn import Const


class QueryError(ValueError):
    """A query that cannot be compiled."""


class BudgetError(RuntimeError):
    """A query that would hold more cells than its budget."""


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return "?" + self.name


BLANK = Var("_")


@dataclass(frozen=True)
class Lookup:
    attr: str
    value: Any


@dataclass(frozen=True)
class Pattern:
    src: str
    e: Any
    a: Any
    v: Any = BLANK
    tx: Any = BLANK
    op: Any = BLANK


@dataclass(frozen=True)
class Binding:
    kind: str  # scalar, tuple, coll, rel
    vars: tuple[Var, ...]


@dataclass(frozen=True)
class Call:
    """A predicate (no binding) or a function clause."""

    fn: str
    args: tuple
    binding: Binding | None = None


@dataclass(frozen=True)
class Not:
    clauses: tuple
    join: tuple[Var, ...] | None = None


@dataclass(frozen=True)
class Or:
    branches: tuple[tuple, ...]
    join: tuple[Var, ...] | None = None
    required: tuple[Var, ...] = ()


@dataclass(frozen=True)
class RuleCall:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    fn: str
    args: tuple  # constants, then the variable
    alias: str | None = None

    @property
    def var(self) -> Var:
        return self.args[-1]


@dataclass(frozen=True)
class PullFind:
    var: Var
    pattern: Any
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    key: str  # a variable's or an aggregate's name
    descending: bool = False
    empty_first: bool = False


@dataclass
class Query:
    find: list
    shape: str = "rel"  # rel, coll, tuple, scalar
    where: list = field(default_factory=list)
    inputs: list = field(default_factory=list)
    with_: list[Var] = field(default_factory=list)
    keys: list[str] | None = None
    rules: dict[str, list] = field(default_factory=dict)
    having: list = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    after: list | None = None
    limit: int | None = None
    offset: int | None = None


SECTIONS = ("find", "keys", "strs", "syms", "with", "in", "where", "rules", "having", "order", "after", "limit", "offset")
#: Words that begin a clause of their own.
_FORMS = ("not", "not-join", "or", "or-join", "and")


def is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?") and len(x) > 1


def term(x):
    """A clause argument: variable, blank, lookup ref, or constant."""
    if isinstance(x, Var):
        return x
    if x == "_":
        return BLANK
    if is_var(x):
        return Var(x[1:])
    if isinstance(x, Const):
        return x.value
    if isinstance(x, list) and len(x) == 2 and isinstance(x[0], str) and x[0].startswith(":"):
        return Lookup(x[0][1:], term(x[1]))
    return _unquoted(x)


def _unquoted(x):
    """A literal without the marks of its quoted strings."""
    if isinstance(x, Const):
        return x.value
    if isinstance(x, (list, tuple)):
        return [_unquoted(y) for y in x]
    return {_unquoted(y) for y in x} if isinstance(x, set) else x


def attr_name(x: str) -> str:
    return x[1:] if x.startswith(":") else x


def parse_query(source) -> Query:
    """Parse EDN text, a map of sections, a vector of sections, or pass a Query on."""
    if isinstance(source, Query):
        return source
    form = edn.read(source) if isinstance(source, str) else edn.from_json(source)
    if isinstance(form, list):
        sections: dict[str, list] = {}
        name = None
        for x in form:
            if isinstance(x, str) and x.startswith(":") and x[1:] in SECTIONS:
                name = x[1:]
                sections[name] = []
            elif name is None:
                raise QueryError("a query vector starts with a section keyword")
            else:
                sections[name].append(x)
        form = {k: (v[0] if k in ("limit", "offset") or k in ("rules", "after", "order") and len(v) == 1 and isinstance(v[0], list) and (not v[0] or isinstance(v[0][0], list) or k == "after") else v) for k, v in sections.items()}
    if not isinstance(form, Mapping):
        raise QueryError("a query is a map or a vector of sections")
    form = {(k[1:] if isinstance(k, str) and k.startswith(":") else k): v for k, v in form.items()}
    unknown = set(form) - set(SECTIONS)
    if unknown:
        raise QueryError(f"unknown section {sorted(unknown)}")
    if not form.get("find"):
        raise QueryError("a query needs :find")
    q = Query([])
    q.find, q.shape = _find(form["find"])
    for k in ("keys", "strs", "syms"):
        if form.get(k):
            q.keys = [str(x).lstrip(":") for x in form[k]]
            if q.shape != "rel" or len(q.keys) != len(q.find):
                raise QueryError(f":{k} needs one name for each element of a relation find")
    q.with_ = [term(x) for x in form.get("with") or ()]
    q.inputs = [_input(x) for x in form.get("in") or ()]
    q.rules = _rules(form.get("rules") or ())
    q.where = [parse_clause(c, q.rules) for c in form.get("where") or ()]
    q.having = [parse_clause(c, {}) for c in form.get("having") or ()]
    if q.having and not any(isinstance(f, Aggregate) for f in q.find):
        raise QueryError(":having needs an aggregate")
    for c in q.having:
        _only_predicates(c)
    q.order = [_order(o) for o in form.get("order") or ()]
    q.limit, q.offset = (_count(form.get(k), k) for k in ("limit", "offset"))
    if form.get("after") is not None:
        q.after = [term(x) for x in form["after"]]
        if len(q.after) != len(q.order) or any(isinstance(f, Aggregate) for f in q.find):
            raise QueryError(":after needs one value for each :order key, and no aggregates")
    return q


def _count(x, name: str) -> int | None:
    if x is not None and (isinstance(x, bool) or not isinstance(x, int) or x < 0):
        raise QueryError(f":{name} is a non-negative integer")
    return x


def _only_predicates(clause) -> None:
    if isinstance(clause, Not):
        for c in clause.clauses:
            _only_predicates(c)
    elif isinstance(clause, Or):
        for b in clause.branches:
            for c in b:
                _only_predicates(c)
    elif not (isinstance(clause, Call) and clause.binding is None):
        raise QueryError(":having takes predicates only")


def _find(form) -> tuple[list, str]:
    form = list(form) if isinstance(form, (list, tuple)) else [form]
    if len(form) == 2 and form[1] == ".":
        return [_element(form[0])], "scalar"
    if len(form) == 1 and isinstance(form[0], list) and form[0] and not isinstance(_try_element(form[0]), (Aggregate, PullFind)):
        inner = form[0]
        if len(inner) == 2 and inner[1] == "...":
            return [_element(inner[0])], "coll"
        return [_element(x) for x in inner], "tuple"
    if len(form) == 2 and form[1] == "...":
        return [_element(form[0])], "coll"
    return [_element(x) for x in form], "rel"


def _try_element(x):
    try:
        return _element(x)
    except QueryError:
        return None


def _element(x):
    if is_var(x):
        return Var(x[1:])
    if isinstance(x, list) and x and isinstance(x[0], str):
        head = x[0]
        if head == "as" and len(x) == 3:
            inner = _element(x[1])
            name = str(x[2]).lstrip("?:")
            if isinstance(inner, Aggregate):
                return Aggregate(inner.fn, inner.args, name)
            if isinstance(inner, PullFind):
                return PullFind(inner.var, inner.pattern, name)
            raise QueryError("as names an aggregate or a pull")
        if head == "pull" and len(x) == 3:
            return PullFind(term(x[1]), x[2])
        if not head.startswith(("?", ":", "$")) and len(x) >= 2 and is_var(x[-1]):
            from ..functions.aggregates import AGGREGATES

            if head not in AGGREGATES:
                raise QueryError(f"unknown aggregate {head}")
            return Aggregate(head, tuple(term(a) for a in x[1:]))
    raise QueryError(f"cannot find {x!r}")


def _binding(x) -> Binding:
    if is_var(x) or x == "_":
        return Binding("scalar", (term(x),))
    if isinstance(x, list) and x:
        if len(x) == 2 and x[1] == "...":
            return Binding("coll", (term(x[0]),))
        if len(x) == 1 and isinstance(x[0], list):
            return Binding("rel", tuple(term(v) for v in x[0]))
        return Binding("tuple", tuple(term(v) for v in x))
    raise QueryError(f"bad binding {x!r}")


def _input(x):
    if isinstance(x, str) and (x.startswith("$") or x == "%"):
        return x
    return _binding(x)


def _rules(form) -> dict[str, list]:
    out: dict[str, list] = {}
    heads = [(d[0][0], len(d[0]) - 1) for d in form]
    known = {n: [] for n, _ in heads}
    for d in form:
        (name, *args), *body = d
        args = tuple(term(a) for a in args)
        if not all(isinstance(a, Var) and a != BLANK for a in args) or len(set(args)) != len(args):
            raise QueryError(f"rule {name} needs distinct head variables")
        if not body:
            raise QueryError(f"rule {name} has no body")
        if any(len(a) != len(args) for a, _ in out.get(name, ())):
            raise QueryError(f"rule {name} is defined with different numbers of arguments")
        out.setdefault(name, []).append((args, body))
    arity = {n: len(v[0][0]) for n, v in out.items()}
    return {n: [(a, [parse_clause(c, known, arity) for c in b]) for a, b in v] for n, v in out.items()}


def parse_clause(c, rules: Mapping, arity: Mapping[str, int] | None = None):
    if isinstance(c, (Pattern, Call, Not, Or, RuleCall)):
        return c
    if not isinstance(c, list) or not c:
        raise QueryError(f"bad clause {c!r}")
    sub = lambda xs: tuple(parse_clause(x, rules, arity) for x in xs)
    head = c[0]
    if head in _FORMS:
        if head == "not":
            return Not(sub(c[1:]))
        if head == "not-join":
            return Not(sub(c[2:]), tuple(term(v) for v in c[1]))
        branch = lambda b: sub(b[1:]) if isinstance(b, list) and b and b[0] == "and" else sub([b])
        if head == "or":
            return Or(tuple(branch(b) for b in c[1:]))
        if head == "or-join":
            required = tuple(term(v) for v in c[1][0]) if c[1] and isinstance(c[1][0], list) else ()
            rest = c[1][1:] if required else c[1]
            return Or(tuple(branch(b) for b in c[2:]), required + tuple(term(v) for v in rest), required)
        raise QueryError("and stands inside or only")
    if len(c) == 1 and isinstance(head, list) and head and head[0] in _FORMS:
        return parse_clause(head, rules, arity)
    if isinstance(head, list) and head and isinstance(head[0], str) and not head[0].startswith(":"):
        if len(c) > 2:
            raise QueryError(f"bad clause {c!r}")
        return Call(head[0], tuple(x if isinstance(x, str) and x.startswith("$") else term(x) for x in head[1:]), _binding(c[1]) if len(c) == 2 else None)
    if isinstance(head, str) and not head.startswith(("?", ":", "$", "_")) and (head in rules or not isinstance(head, Const)):
        if head not in rules:
            raise QueryError(f"unknown rule {head}")
        defs = rules[head]
        want = (arity or {}).get(head, len(defs[0][0]) if defs else None)
        if want is not None and want != len(c) - 1:
            raise QueryError(f"rule {head} takes {want} arguments")
        return RuleCall(head, tuple(term(x) for x in c[1:]))
    src = "$"
    if isinstance(head, str) and head.startswith("$"):
        src, c = head, c[1:]
    if not 1 <= len(c) <= 5:
        raise QueryError(f"a pattern has one to five components: {c!r}")
    parts = [term(x) for x in c] + [BLANK] * (5 - len(c))
    if isinstance(parts[1], str):
        parts[1] = attr_name(parts[1])
    return Pattern(src, *parts)


def _order(o) -> Order:
    if is_var(o):
        return Order(o[1:])
    if isinstance(o, Mapping):
        get = lambda *names: next((o[n] for n in names if n in o), None)
        key, direction, empty = get("key", ":key", "var", ":var"), get("dir", ":dir", "direction"), get("empty", ":empty")
    elif isinstance(o, list) and o:
        key, direction, empty = (*o, None, None)[:3]
    else:
        key, direction, empty = o, None, None
    name = str(key).lstrip("?:")
    direction, empty = str(direction or "asc").lstrip(":"), str(empty or "last").lstrip(":")
    if direction not in ("asc", "desc") or empty not in ("first", "last"):
        raise QueryError(f"bad order {o!r}")
    return Order(name, direction == "desc", empty == "first")


def vars_of(clause, own: Mapping | None = None) -> set[Var]:
    """Variables that a clause shares with the clauses around it."""
    if isinstance(clause, Pattern):
        return {x for x in (clause.e, clause.a, clause.v, clause.tx, clause.op) if isinstance(x, Var) and x != BLANK}
    if isinstance(clause, Call):
        out = {x for x in clause.args if isinstance(x, Var) and x != BLANK}
        return out | ({v for v in clause.binding.vars if v != BLANK} if clause.binding else set())
    if isinstance(clause, RuleCall):
        return {x for x in clause.args if isinstance(x, Var) and x != BLANK}
    if clause.join is not None:
        return set(clause.join)
    inner = clause.clauses if isinstance(clause, Not) else [c for b in clause.branches for c in b]
    return set().union(*(vars_of(c) for c in inner)) if inner else set()

"""A fluent builder of queries: stages over a focus entity, lowered to the query model's maps.

    entities("person").where("age", ">", 28).follow("boss").select(name="name").order_by("name").limit(5)

A query is a value: stages give new ones. `open` puts a whole query's conditions into another and moves to its focus,
`refine` adds conditions to a query and keeps its row, `enrich` adds cells to its row; all three refuse a query that is
ordered or cut (`logic` takes order and cuts off). `rule` names a fragment, which may call itself. Cells may start from
any entity that was marked on the way, and be nested records. `shaped` asks for trees (see shapes).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from .edn import Const
from .plans.compiler import Result, run_query
from .plans.query import QueryError


class NotOne(LookupError):
    """one_or_fail met no row, or more than one."""


class ParamError(ValueError):
    """A parameter that is unknown, missing, or of another kind."""


#: What a parameter's value must be.
KINDS = {"long": int, "double": (int, float), "string": str, "boolean": bool, "eid": (int, list, tuple)}


@dataclass(frozen=True)
class Param:
    """A place for a value. kind: of KINDS; eid is an entity id or a lookup reference."""

    name: str
    optional: bool = False
    kind: str | None = None

    def checked(self, value):
        if self.kind and (not isinstance(value, KINDS[self.kind]) or isinstance(value, bool) != (self.kind == "boolean")):
            raise ParamError(f"{self.name} takes a {self.kind}, not {value!r}")
        return value


@dataclass(frozen=True)
class _Gate:
    """Clauses that count only if a parameter is given."""

    param: Param
    clauses: tuple


class NamedRule:
    """A fragment with a name: bodies move from an entity to another, or only restrict it. Several bodies are choices."""

    def __init__(self, name: str, ns: str, *bodies: Callable[[Builder], Builder]):
        self.name, self.ns, self.bodies = name, ns, bodies

    def moves(self) -> bool:
        b = self.bodies[0](Builder(self.ns, "?in"))
        return b.focus != "?in"

    def lowered(self, known: dict[str, list], params: dict) -> None:
        """Add this rule, and those that it calls, to a query's rules."""
        if self.name in known:
            return
        known[self.name] = own = []
        for body in self.bodies:
            b = body(Builder(self.ns, "?in"))
            own.append([[self.name, "?in", *([b.focus] if b.focus != "?in" else [])], *_bound(b.clauses, params)])
            for r in b.rules:
                r.lowered(known, params)
        if len({len(d[0]) for d in own}) != 1:
            raise QueryError(f"the bodies of rule {self.name} must all move, or none")


def rule(name: str, ns: str, *bodies: Callable[[Builder], Builder]) -> NamedRule:
    return NamedRule(name, ns, *bodies)


def _quoted(x):
    return {"const": x} if isinstance(x, str) else x


@dataclass(frozen=True)
class Builder:
    ns: str
    focus: str = "?e0"
    clauses: tuple = ()
    count: int = 1
    find: tuple = ()
    keys: tuple = ()
    aggregated: tuple = ()
    order: tuple = ()
    cap: int | None = None
    skip: int | None = None
    rules: tuple = ()
    marks: tuple = ()  # (name, variable, namespace)
    shape: Any = None

    def _attr(self, name: str) -> str:
        return name if name.startswith(":") else f":{name}" if "/" in name else f":{self.ns}/{name}"

    def _var(self, stem: str = "v") -> tuple[str, Builder]:
        return f"?{stem}{self.count}", replace(self, count=self.count + 1)

    def _add(self, *clauses) -> Builder:
        return replace(self, clauses=self.clauses + clauses)

    def has(self, attr: str) -> Builder:
        return self._add([self.focus, self._attr(attr), "_"])

    def missing(self, attr: str) -> Builder:
        return self._add(["not", [self.focus, self._attr(attr), "_"]])

    def is_(self, e) -> Builder:
        return self._add([["=", self.focus, e]])

    def where(self, attr: str, op: str, value: Any) -> Builder:
        """op: = != < <= > >= in, or the name of a predicate of two arguments."""
        v, b = self._var()
        if op == "=":
            return self._add([self.focus, self._attr(attr), _held(value)])
        if op == "in":
            if not isinstance(value, Param) and not list(value):
                return b._add(["or"])  # in nothing: never
            return b._add([["ground", Const(list(value)) if not isinstance(value, Param) else value], [v, "..."]], [self.focus, self._attr(attr), v])
        call = [op, _held(value), v] if op.startswith("re-") else [op, v, _held(value)]
        return b._add([self.focus, self._attr(attr), v], [call])

    def follow(self, attr: str, ns: str | None = None) -> Builder:
        """Move the focus along a reference."""
        v, b = self._var("e")
        return replace(b._add([self.focus, self._attr(attr), v]), focus=v, ns=ns or self.ns)

    def backlink(self, attr: str) -> Builder:
        """Move the focus to the entities that refer to it."""
        v, b = self._var("e")
        name = self._attr(attr)
        return replace(b._add([v, name, self.focus]), focus=v, ns=name[1:].split("/")[0])

    def _children(self, attr: str, inner: Callable[[Builder], Builder] | None) -> tuple[str, list, Builder]:
        v, b = self._var("e")
        name = self._attr(attr)
        child = Builder(name[1:].split("/")[0], v, (), b.count)
        child = inner(child) if inner else child
        return v, list(child.clauses), replace(b, count=child.count), name

    def some(self, attr: str, inner=None) -> Builder:
        """At least one entity refers here by attr and meets inner."""
        v, clauses, b, name = self._children(attr, inner)
        return b._add(["or-join", [self.focus], ["and", [v, name, self.focus], *clauses]])

    def none(self, attr: str, inner=None) -> Builder:
        v, clauses, b, name = self._children(attr, inner)
        return b._add(["not-join", [self.focus], [v, name, self.focus], *clauses])

    def every(self, attr: str, inner) -> Builder:
        v, clauses, b, name = self._children(attr, inner)
        return b._add(["not-join", [self.focus], [v, name, self.focus], ["not-join", [v], [v, name, "_"], *clauses]])

    def either(self, *branches: Callable[[Builder], Builder]) -> Builder:
        parts, n = [], self.count
        for f in branches:
            b = f(replace(self, clauses=(), count=n))
            parts.append(["and", *b.clauses])
            n = b.count
        return replace(self._add(["or-join", [self.focus], *parts]), count=n)

    def updated_since(self, t: int) -> Builder:
        tx, b = self._var("tx")
        return b._add([self.focus, f"?a{self.count}", "_", tx], [[">", tx, (1 << 42) + t]])

    def asserted_by(self, attr: str, tx_attr: str, who) -> Builder:
        tx, b = self._var("tx")
        return b._add([self.focus, self._attr(attr), "_", tx], [tx, tx_attr if tx_attr.startswith(":") else f":{tx_attr}", _held(who)])

    def when(self, gate, stage: Callable[[Builder], Builder]) -> Builder:
        """A stage that counts if the gate holds; a parameter holds if a run is given it, and its stage only restricts."""
        if not isinstance(gate, Param):
            return stage(self) if gate else self
        inner = stage(replace(self, clauses=()))
        if inner.focus != self.focus or inner.find != self.find:
            raise QueryError("a stage behind a parameter may only restrict")
        return replace(inner, clauses=(*self.clauses, _Gate(replace(gate, optional=True), inner.clauses)))

    def mark(self, name: str) -> Builder:
        """Name the focus, so that cells may start from it (`name.attribute`) wherever the focus is."""
        return replace(self, marks=(*self.marks, (name, self.focus, self.ns)))

    def call(self, named: NamedRule, ns: str | None = None) -> Builder:
        """Restrict the focus to where a rule holds, and move along it if it moves."""
        if not named.moves():
            return replace(self._add([named.name, self.focus]), rules=(*self.rules, named))
        v, b = self._var("e")
        return replace(b._add([named.name, self.focus, v]), focus=v, ns=ns or named.ns, rules=(*self.rules, named))

    @property
    def cut(self) -> bool:
        return bool(self.order) or self.cap is not None or self.skip is not None

    def logic(self) -> Builder:
        """This query without order, limit and offset."""
        return replace(self, order=(), cap=None, skip=None)

    def open(self, other: Builder, **params) -> Builder:
        """Put another query's conditions here, its variables renamed and its parameters given, and move to its focus."""
        if other.cut:
            raise QueryError("a query that is ordered or cut can't be opened; take its logic()")
        lacking = {p.name for p in _params(_settled(other.clauses, params, False)) if not p.optional} - set(params)
        if lacking:
            raise ParamError(f"missing {sorted(lacking)}")
        stem = f"?o{self.count}_"
        fresh = lambda x: stem + x[1:] if isinstance(x, str) and x.startswith("?") else [fresh(y) for y in x] if isinstance(x, (list, tuple)) else x
        inner = tuple(fresh(c) for c in _settled(other.clauses, params))
        return replace(self, clauses=self.clauses + inner, count=self.count + 1, focus=fresh(other.focus), ns=other.ns, rules=self.rules + other.rules, marks=self.marks + tuple((n, fresh(v), ns) for n, v, ns in other.marks))

    def refine(self, fragment: Callable[[Builder], Builder]) -> Builder:
        """This query with more conditions on its focus, and the same row."""
        if self.cut:
            raise QueryError("a query that is ordered or cut can't be refined; take its logic()")
        done = fragment(self)
        return replace(done, focus=self.focus, ns=self.ns, find=self.find, keys=self.keys, aggregated=self.aggregated)

    def enrich(self, *attrs: str, **named: str) -> Builder:
        """This query with more cells in its row."""
        if self.cut:
            raise QueryError("a query that is ordered or cut can't be enriched; take its logic()")
        return self.select(*attrs, **named)

    def rows(self, **cells) -> Builder:
        """Cells by key: paths from the focus or from a mark, or dicts of them for nested records."""
        flat: dict[str, str] = {}

        def walk(prefix: str, record: dict) -> None:
            for k, v in record.items():
                walk(f"{prefix}{k}.", v) if isinstance(v, dict) else flat.__setitem__(prefix + k, v)

        walk("", cells)
        return self.select(**flat)

    def shaped(self, shape) -> Builder:
        """Trees of the focus in place of cells; entities that lack a required field go."""
        return replace(self, shape=shape, clauses=self.clauses + tuple(shape.required(self.focus)))

    def stage(self, f: Callable[[Builder], Builder]) -> Builder:
        return f(self)

    def select(self, *attrs: str, **named: str) -> Builder:
        """Columns by attribute path (`boss.name`); none: the ids alone."""
        b = self
        for key, path in itertools.chain(((a.split(".")[-1], a) for a in attrs), named.items()):
            at, ns, hops = b.focus, b.ns, path.split(".")
            marked = next(((v, n) for name, v, n in b.marks if name == hops[0]), None)
            if marked and len(hops) > 1:
                (at, ns), hops = marked, hops[1:]
            if hops == ["id"]:
                b = replace(b, find=b.find + (at,), keys=b.keys + (key,))
                continue
            for h in hops:
                v, b = b._var("c")
                b = b._add([at, replace(b, ns=ns)._attr(h), v])
                at = v
            b = replace(b, find=b.find + (at,), keys=b.keys + (key,))
        return b

    def aggregate(self, key: str, fn: str, attr: str | None = None) -> Builder:
        """An aggregate over the focus entities (attr None: of the entities themselves)."""
        if attr is None:
            v, b = self.focus, self
        else:
            v, b = self._var("g")
            b = b._add([self.focus, b._attr(attr), v])
        return replace(b, aggregated=b.aggregated + ((key, fn, v),))

    def order_by(self, key: str, direction: str = "asc", empty: str = "last") -> Builder:
        return replace(self, order=self.order + ((key, direction, empty),))

    def limit(self, n: int) -> Builder:
        return replace(self, cap=n)

    def offset(self, n: int) -> Builder:
        return replace(self, skip=n)

    # lowering and running

    def lower(self, after=None, tie: bool = False, **params) -> dict:
        names = dict(zip(self.keys, self.find))
        find: list = list(self.find) or ([] if self.aggregated else [self.focus])
        keys = list(self.keys) or ([] if self.aggregated else ["id"])
        for key, fn, v in self.aggregated:
            find.append(["as", [fn, v], f"?{key}"])
            keys.append(key)
        clauses = [_bound(c, params) for c in _settled(self.clauses, params, False)]
        if self.shape is not None:
            if self.find or self.aggregated:
                raise QueryError("a shape stands for the whole row")
            find, keys = [["as", ["pull", self.focus, self.shape.pattern()], "?tree"]], ["tree"]
        if not any(c[0] == self.focus for c in clauses if isinstance(c[0], str)) and not clauses:
            raise QueryError("a query needs a stage: has, where or select")
        order = [[names.get(k, f"?{k}"), d, e] for k, d, e in self.order]
        if tie:
            order.append([self.focus, "asc", "last"])
            if self.focus not in find:
                find.append(self.focus)
                keys.append("__id")
        out: dict[str, Any] = {"find": find, "keys": keys, "where": clauses, "order": order}
        rules: dict[str, list] = {}
        for r in self.rules:
            r.lowered(rules, params)
        out["rules"] = [d for own in rules.values() for d in own]
        if self.aggregated:
            # entities stay in the tuples, so equal values of different entities all count
            out["with"] = [self.focus]
        if self.cap is not None:
            out["limit"] = self.cap
        if self.skip is not None:
            out["offset"] = self.skip
        if after is not None:
            out["after"] = [_quoted(x) for x in after]
        return {k: v for k, v in out.items() if v not in ([], None)}

    def compile(self, db, after=None, tie: bool = False, **params) -> Result:
        known = {p.name: p for p in sorted(_params(self.clauses), key=lambda p: p.kind is not None)}
        open_ = _params(_settled(self.clauses, params, False))
        unknown, lacking = set(params) - set(known), {p.name for p in open_ if not p.optional} - set(params)
        if unknown or lacking:
            raise ParamError(f"unknown {sorted(unknown)}, missing {sorted(lacking)}")
        for name, value in params.items():
            known[name].checked(value)
        return run_query(db, self.lower(after, tie, **params))

    def run(self, db, **params) -> list[dict]:
        rows = self.compile(db, **params).rows()
        if self.shape is not None:
            return [self.shape.finished(r["tree"]) for r in rows]
        return [_nested(r) for r in rows]

    def one(self, db, **params) -> dict | None:
        rows = self.limit(1).run(db, **params)
        return rows[0] if rows else None

    def one_or_fail(self, db, **params) -> dict:
        rows = self.limit(2).run(db, **params)
        if len(rows) != 1:
            raise NotOne(f"{len(rows)} rows")
        return rows[0]

    def page(self, db, size: int, cursor=None, **params) -> tuple[list[dict], list | None]:
        """A page behind a cursor, and the next cursor (None at the end)."""
        if self.skip is not None or self.aggregated:
            raise QueryError("pages exclude offset and aggregates")
        rows = replace(self, cap=size).compile(db, cursor, True, **params).rows()
        if len(rows) < size:
            return _without_id(rows), None
        last = rows[-1]
        lowered = self.lower(tie=True, **params)
        place = dict(zip(map(str, lowered["find"]), lowered["keys"]))
        return _without_id(rows), [last[place[k[0]]] for k in lowered["order"]]


def _nested(row: dict) -> dict:
    """Keys with dots as records in records."""
    out: dict = {}
    for k, v in row.items():
        at = out
        *path, last = k.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def _settled(clauses, params, given: bool = True) -> tuple:
    """Clauses with gates taken away: their clauses stay if their parameter is given. given: values go in, too."""
    out: list = []
    for c in clauses:
        if isinstance(c, _Gate):
            out += _settled(c.clauses, params, given) if c.param.name in params else ()
        else:
            out.append(_bound(c, params) if given else c)
    return tuple(out)


def _without_id(rows: list[dict]) -> list[dict]:
    return [{k: v for k, v in r.items() if k != "__id"} for r in rows]


def _held(value):
    return value if isinstance(value, Param) else Const(value) if isinstance(value, str) and not value.startswith(":") else value


def _params(form) -> list[Param]:
    if isinstance(form, Param):
        return [form]
    if isinstance(form, _Gate):
        return [form.param, *_params(form.clauses)]
    return [p for x in form for p in _params(x)] if isinstance(form, (list, tuple)) else []


def _bound(form, params):
    if isinstance(form, Param):
        if form.name not in params:
            return form
        x = params[form.name]
        return Const(x) if isinstance(x, str) else x
    return [_bound(x, params) for x in form] if isinstance(form, (list, tuple)) else form


def entities(ns: str) -> Builder:
    return Builder(ns)

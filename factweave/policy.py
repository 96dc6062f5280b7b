"""Who may see and write which facts.

A policy is a list of rules: allow or deny, for an operation (read, create, add, retract, retractEntity) on a
namespace or an attribute, when an expression holds for the entity and the principal. Reading needs an allowing
rule and no denying one, for the namespace or the attribute. A view is filtered at its scans, with sets of
entities that are computed once by joins; rules are judged by the current facts even for views of the past.

A transaction's facts are creates (of entities without facts so far), adds, retracts, or retractEntity (where nothing of
an entity stays); rules for creates are judged by what the transaction makes of the database. Presets are attributes that
a created entity of their namespace gets, and may not have otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.values import SLOTS
from .sources.views import BOOT_LIMIT, DATOMS, VALUE, Attribute, Facts, coerced
from .transactions import TxError, datom


@dataclass(frozen=True)
class Principal:
    id: int | None = None
    classes: frozenset = frozenset()
    fields: Mapping[str, Any] | None = None
    admin: bool = False


# expressions: ("const", bool) ("class", name) ("eq", attribute, value or ("principal", field)) ("ref", [attributes], value)
# ("and", ...) ("or", ...) ("not", x); a reference path has at most three steps


@dataclass(frozen=True)
class Rule:
    effect: str  # allow or deny
    op: str
    target: str  # a namespace, an attribute, or *
    when: tuple = ("const", True)

    def covers(self, attr: Attribute) -> bool:
        return self.target in ("*", attr.namespace, attr.ident)


def _value(x, who: Principal):
    if isinstance(x, tuple) and x and x[0] == "principal":
        return who.id if x[1] == "id" else (who.fields or {}).get(x[1])
    return x


def holds(expr: tuple, view: Facts, who: Principal) -> bool | DataFrame:
    """True or False for all entities, or the entities (e) for which the expression holds."""
    kind = expr[0]
    if kind == "const":
        return bool(expr[1])
    if kind == "class":
        return expr[1] in who.classes
    if kind in ("eq", "ref"):
        path = [expr[1]] if kind == "eq" else list(expr[1])
        if not 1 <= len(path) <= 3:
            raise ValueError("a reference path has one to three steps")
        value = _value(expr[2], who)
        if value is None:
            return False
        attrs = [view.schema.attr(a) for a in path]
        last = view.relation(attrs[-1])
        met = last.where(F.col("v") == F.lit(coerced(attrs[-1].kind, value))).select("e")
        for a in reversed(attrs[:-1]):
            met = view.relation(a).join(met.withColumnRenamed("e", "v"), "v", "left_semi").select("e")
        return met.distinct()
    parts = [holds(x, view, who) for x in expr[1:]]
    if kind == "not":
        (x,) = parts
        return not x if isinstance(x, bool) else view.everything().select("e").distinct().join(x, "e", "left_anti")
    frames = [p for p in parts if not isinstance(p, bool)]
    if kind == "and":
        return False if any(p is False for p in parts) else reduce(lambda a, b: a.join(b, "e", "left_semi"), frames) if frames else True
    if kind == "or":
        return True if any(p is True for p in parts) else reduce(DataFrame.unionByName, frames).distinct() if frames else False
    raise ValueError(f"unknown expression {kind}")


def _known(db: Facts, entities: set[int]) -> set[int]:
    """Those of some entities (a transaction's) that have facts."""
    if not entities:
        return set()
    return {r[0] for r in db.everything().where(F.col("e").isin(list(entities))).select("e").distinct().collect()}


class Policy:
    def __init__(self, rules: Sequence[Rule], presets: Mapping[str, Any] | None = None):
        self.rules, self.presets = list(rules), dict(presets or {})

    def completed(self, db: Facts, who: Principal, datoms: list[tuple]) -> list[tuple]:
        """A transaction's datoms with the presets of the entities that it creates; another value there is refused."""
        known = _known(db, {d[0] for d in datoms})
        made: dict[int, set[str]] = {}
        for d in datoms:
            if d[-1] and d[1] >= BOOT_LIMIT and d[0] not in known and d[1] in db.schema.by_id:
                made.setdefault(d[0], set()).add(db.schema.by_id[d[1]].namespace)
        out = list(datoms)
        for name, value in self.presets.items():
            attr, value = db.schema.attr(name), _value(value, who)
            if value is None:
                continue
            value = coerced(attr.kind, value)
            given = {d[0]: d[3 + VALUE[1:].index(SLOTS[attr.kind])] for d in datoms if d[1] == attr.id and d[-1]}
            for e, spaces in made.items():
                if e in given and given[e] != value:
                    raise TxError("forbidden", f"{attr.ident} is preset")
                if attr.namespace in spaces and e not in given:
                    out.append(datom(e, attr, value, datoms[0][-2], True))
        return out

    def _sides(self, view: Facts, who: Principal, op: str, attr: Attribute) -> tuple[list, list]:
        own = [r for r in self.rules if r.op == op and r.covers(attr)]
        return [holds(r.when, view, who) for r in own if r.effect == "allow"], [holds(r.when, view, who) for r in own if r.effect == "deny"]

    def readable(self, db: Facts, who: Principal) -> Facts:
        """The view as a principal may read it. Attributes that describe the schema are always visible."""
        if who.admin:
            return db
        current = Facts(db.spark, db.log, db.schema, snapshot=db.snapshot)
        groups: dict[tuple, list[Attribute]] = {}
        for a in db.schema.attributes.values():
            groups.setdefault(tuple(r for r in self.rules if r.op == "read" and r.covers(a)), []).append(a)

        def allowed(rows: DataFrame, view: Facts) -> DataFrame:
            parts = [rows.where(F.col("a") < BOOT_LIMIT)]
            for rules, attrs in groups.items():
                yes = [holds(r.when, current, who) for r in rules if r.effect == "allow"]
                no = [holds(r.when, current, who) for r in rules if r.effect == "deny"]
                ids = [a.id for a in attrs if a.id >= BOOT_LIMIT]
                if not ids or not yes or any(x is True for x in no) or all(x is False for x in yes):
                    continue
                part = rows.where(F.col("a").isin(ids))
                if not any(x is True for x in yes):
                    part = part.join(reduce(DataFrame.unionByName, [x for x in yes if not isinstance(x, bool)]).distinct(), "e", "left_semi")
                for x in no:
                    if not isinstance(x, bool):
                        part = part.join(x, "e", "left_anti")
                parts.append(part)
            return reduce(DataFrame.unionByName, parts)

        return db.filtered(allowed)

    def check(self, db: Facts, who: Principal, datoms: Sequence[tuple]) -> None:
        """Refuse a transaction's datoms that the principal may not write. An old value that an add replaces is part of
        the add."""
        if who.admin:
            return
        own = [(d[0], db.schema.by_id[d[1]], d[-1]) for d in datoms if d[1] >= BOOT_LIMIT and d[1] in db.schema.by_id]
        known = _known(db, {e for e, _, _ in own})
        gone = {e for e, _, added in own if not added}
        changed = gone or any(e not in known for e, _, _ in own)  # adds to what is there are judged by what is there
        after = db.overlaid(db.spark.createDataFrame(list(datoms), DATOMS)) if changed else db
        gone -= _known(after, gone)
        groups: dict[tuple, set[int]] = {}
        replaced = {(e, attr.id) for e, attr, added in own if added}
        for e, attr, added in own:
            if not added and (e, attr.id) in replaced and not attr.many:
                continue  # the old value of an add
            op = ("add" if e in known else "create") if added else "retractEntity" if e in gone else "retract"
            groups.setdefault((op, attr), set()).add(e)
        for (op, attr), entities in groups.items():  # a read for each rule of each kind of change, however many facts

            def met(x, entities=entities) -> set[int]:
                if isinstance(x, bool):
                    return entities if x else set()
                return {r[0] for r in x.where(F.col("e").isin(list(entities))).select("e").collect()}

            yes, no = self._sides(after if op == "create" else db, who, op, attr)
            if set().union(*map(met, yes)) != entities or set().union(*map(met, no)):
                raise TxError("forbidden", f"{op} of {attr.ident} isn't allowed")

"""Shapes of trees: which fields a row must have, may have, or reads as a default, nested along references.

    person = shape(name=field("person/name"), age=field("person/age").or_default(0),
                   boss=field("person/boss").select(name=field("person/name")).optional())

A field of one value that is neither optional nor defaulted is required: entities without it go, before any limit, as
conditions of the query. Fields of many values are never required, and are empty lists where an entity has none.
`everything()` takes all attributes, `again(n)` the shape itself, n levels deep.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from .edn import frozen, thawed
from .plans.query import QueryError

_NONE = object()
_fresh = itertools.count()


@dataclass(frozen=True)
class Again:
    levels: int


def again(levels: int) -> Again:
    if not 1 <= levels <= 16:
        raise QueryError("a shape repeats 1 to 16 levels deep")
    return Again(levels)


@dataclass(frozen=True)
class Field:
    """One field: an attribute (`ns/name`, or `ns/_name` against its direction) and how it is read."""

    attr: str
    many: bool = False
    may_lack: bool = False
    default: Any = _NONE
    sub: Any = None  # a Shape, Again, or "*"
    options: tuple = ()

    def optional(self) -> Field:
        return replace(self, may_lack=True)

    def or_default(self, value) -> Field:
        if value is None:
            raise QueryError("a default is a value; a field that may be absent is optional()")
        return replace(self, default=value)

    def select(self, sub=None, **fields: Field) -> Field:
        """The target's fields: a shape, again(n), everything(), or fields by key."""
        return replace(self, sub=sub if sub is not None else Shape(fields))

    def all(self) -> Field:
        """A field of many values."""
        return replace(self, many=True)

    def with_(self, **options) -> Field:
        """where, order, limit and offset of the targets."""
        return replace(self, options=(*self.options, *options.items()))

    @property
    def required(self) -> bool:
        return not (self.many or self.may_lack or self.default is not _NONE)


def field(attr: str) -> Field:
    ns, _, name = attr.lstrip(":").rpartition("/")
    return Field(f":{ns}/{name}", many=name.startswith("_"))


def everything() -> str:
    return "*"


def pick(ns: str, *names: str) -> dict[str, Field]:
    """Fields of one namespace under their own names."""
    return {n: field(f"{ns}/{n}") for n in names}


@dataclass(frozen=True)
class Shape:
    fields: dict[str, Field]

    def pattern(self) -> list:
        """The pull pattern."""
        out: list = []
        for key, f in self.fields.items():
            if f.attr == ":/id":
                out.append("db/id")
                continue
            options = [x for k, v in f.options for x in (f":{k}", v)]
            spec = frozen([f.attr, ":as", key, *options, *((":default", f.default) if f.default is not _NONE else ())])
            if f.sub is None:
                out.append(thawed(spec))
            else:
                out.append({spec: [f.sub] if f.sub == "*" else f.sub.levels if isinstance(f.sub, Again) else f.sub.pattern()})
        return out

    def required(self, e: str) -> Iterator[list]:
        """Conditions that an entity with all required fields meets."""
        for f in self.fields.values():
            if not f.required or f.attr == ":/id":
                continue
            ns, _, name = f.attr.rpartition("/")
            inner, v = [], "_"
            if isinstance(f.sub, Shape):
                v = f"?need{next(_fresh)}"
                inner = list(f.sub.required(v))
            if name.startswith("_"):
                v = v if v != "_" else f"?need{next(_fresh)}"
                yield [v, f"{ns}/{name[1:]}", e]
            else:
                yield [e, f.attr, v if inner else "_"]
            yield from inner

    def finished(self, tree) -> dict:
        """A row as collected: empty lists for fields of many values, and nothing for optional ones that lack."""
        out: dict = {}
        for key, f in self.fields.items():
            name = "db/id" if f.attr == ":/id" else key
            value = (tree or {}).get(name)
            if isinstance(f.sub, Shape) and value is not None:
                value = [f.sub.finished(v) for v in value] if isinstance(value, list) else f.sub.finished(value)
            elif isinstance(f.sub, Again) and value is not None:
                value = [self.finished(v) if set(v) - {"db/id"} else v for v in value] if isinstance(value, list) else self.finished(value) if set(value) - {"db/id"} else value
            if value is not None:
                out[key] = value
            elif f.many:
                out[key] = []
        return out


def identity() -> Field:
    """The entity's own id."""
    return Field(":/id", may_lack=True)


def shape(**fields: Field) -> Shape:
    return Shape(fields)

"""Typed columns of the query language: a Spark column with the kind of its values."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..edn import Instant, Uuid

#: Kinds and the column types that hold them; `any` is the tagged union of an attribute variable's value.
SPARK_TYPES = {"long": "bigint", "double": "double", "string": "string", "boolean": "boolean", "ref": "bigint", "uuid": "string", "instant": "bigint", "bytes": "binary"}
#: The tags of value kinds, which order kinds in indexes.
TAGS = {"long": 1, "double": 2, "string": 3, "boolean": 4, "ref": 5, "uuid": 6, "instant": 7, "bytes": 8}
KINDS = {v: k for k, v in TAGS.items()}
#: Storage column of each kind.
SLOTS = {"long": "v_long", "ref": "v_long", "instant": "v_long", "double": "v_double", "string": "v_str", "uuid": "v_str", "boolean": "v_bool", "bytes": "v_bytes"}
_SLOT_TYPES = {"v_long": "bigint", "v_double": "double", "v_str": "string", "v_bool": "boolean", "v_bytes": "binary"}
_SLOT_NAMES = tuple(_SLOT_TYPES)
#: The tagged union as a Spark type.
UNION = "struct<vt:tinyint," + ",".join(f"{n}:{t}" for n, t in _SLOT_TYPES.items()) + ">"
#: Classes of kinds whose values can be equal, in the order of mixed values.
_CLASS = {"long": "number", "double": "number", "ref": "number", "string": "string", "uuid": "string", "boolean": "boolean", "instant": "instant"}
_RANK = {"number": 1, "string": 2, "boolean": 3, "instant": 4}


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str  # a kind, any, null, list:<kind of its items> or tuple:<kinds of its places>
    const: Any = None

    @property
    def cls(self) -> str:
        return _CLASS.get(self.kind, "other" if self.kind not in ("any", "null") else self.kind)

    @property
    def several(self) -> bool:
        return self.kind.startswith(("list", "tuple"))

    @property
    def inner(self) -> list[str]:
        """Kinds of a tuple's places, or the one kind of a list's items."""
        return self.kind.partition(":")[2].split(",")


def kind_of(value) -> str:
    """The kind of a constant."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (Instant, dt.datetime)):
        return "instant"
    if isinstance(value, Uuid):
        return "uuid"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "long" if value.is_integer() and abs(value) < 2**53 else "double"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, (list, tuple, set)):
        return "list"
    raise TypeError(f"no kind for {type(value).__name__}")


def common(kinds) -> str:
    """The kind that holds values of all the given ones: any if they are of different classes."""
    found = set(kinds) - {"null"}
    if found <= {"long", "double", "ref"} and len(found) > 1:
        return "double" if "double" in found else "long"
    return found.pop() if len(found) == 1 else "any" if found else "null"


def slots(value) -> tuple:
    """A constant as the cells of the tagged union."""
    kind = kind_of(value)
    return TAGS[kind], *(plain(value) if s == SLOTS[kind] else None for s in _SLOT_NAMES)


def as_union(v: Val) -> Column:
    """A value as the tagged union; null stays null."""
    if v.kind == "any":
        return v.col
    if v.kind == "null":
        return F.lit(None).cast(UNION)
    cells = [F.lit(TAGS[v.kind]).cast("tinyint").alias("vt")]
    for slot in _SLOT_NAMES:
        cells.append((v.col if slot == SLOTS[v.kind] else F.lit(None)).cast(_SLOT_TYPES[slot]).alias(slot))
    return F.when(v.col.isNotNull(), F.struct(*cells))


def cast_to(v: Val, kind: str) -> Column:
    """A value as a column of a kind that `common` gave."""
    if kind == "any":
        return as_union(v)
    return v.col.cast(SPARK_TYPES[kind]) if kind in SPARK_TYPES else v.col


def plain(value):
    """A constant as Spark takes it."""
    if isinstance(value, dt.datetime):
        return int(Instant.of(value))
    if isinstance(value, (Instant,)):
        return int(value)
    if isinstance(value, Uuid):
        return str(value)
    if isinstance(value, float) and kind_of(value) == "long":
        return int(value)
    return value


def const(value) -> Val:
    kind = kind_of(value)
    if kind == "null":
        return Val(F.lit(None), "null")
    if kind == "list":
        items = sorted(value) if isinstance(value, set) else list(value)
        cells = [const(x) for x in items]
        inner = common(c.kind for c in cells)
        return Val(F.array(*[cast_to(c, inner) for c in cells]), f"list:{inner}", items)
    return Val(F.lit(plain(value)).cast(SPARK_TYPES[kind]), kind, value)


def number(v: Val) -> Column:
    """Numeric column of a value; instants count as milliseconds."""
    if v.kind == "any":
        return F.coalesce(v.col["v_double"], v.col["v_long"].cast("double"))
    if v.cls not in ("number", "instant"):
        raise TypeError(f"a number is needed, not {v.kind}")
    return v.col


def narrowed(v: Val, cls: str) -> Column:
    """The value of a tagged union as one class; null if it is of another."""
    tags = [TAGS[k] for k, c in _CLASS.items() if c == cls]
    slot = {"number": F.coalesce(v.col["v_double"], v.col["v_long"].cast("double")), "string": v.col["v_str"], "boolean": v.col["v_bool"], "instant": v.col["v_long"]}.get(cls)
    return F.when(v.col["vt"].isin(tags), slot) if slot is not None else v.col["v_bytes"]


def equal(a: Val, b: Val) -> Column:
    """Equality by value: kinds of different classes are unequal, null equals null."""
    if a.kind == "null" or b.kind == "null":
        return b.col.isNull() if a.kind == "null" else a.col.isNull()
    if a.kind == "any" or b.kind == "any":
        if a.const is not None or b.const is not None:
            x, y = (a, b) if a.kind == "any" else (b, a)
            return F.coalesce(narrowed(x, y.cls) == y.col, F.lit(False))
        return sort_key(a).eqNullSafe(sort_key(b))  # a key that joins can hash
    return a.col.eqNullSafe(b.col) if a.cls == b.cls else F.lit(False)


def before(a: Val, b: Val, strict: bool = True) -> Column:
    """a < b (or <=) in the total order: numbers, strings, booleans, instants, others, null."""
    if "any" in (a.kind, b.kind):
        ka, kb = sort_key(a), sort_key(b)
        return ka < kb if strict else ka <= kb
    ra, rb = (_RANK.get(v.cls, 6 if v.kind == "null" else 5) for v in (a, b))
    if ra != rb:
        known = F.lit(ra < rb)
        # a null of either side ranks behind all
        return F.when(a.col.isNull() & b.col.isNull(), F.lit(not strict)).when(a.col.isNull(), F.lit(False)).when(b.col.isNull(), F.lit(True)).otherwise(known)
    inner = a.col < b.col if strict else a.col <= b.col
    return F.when(a.col.isNull(), b.col.isNull() if not strict else F.lit(False)).when(b.col.isNull(), F.lit(True)).otherwise(inner)


def sort_key(v: Val) -> Column:
    """A struct that orders values of any kind."""
    empty = {"r": F.lit(6), "n": F.lit(None).cast("double"), "s": F.lit(None).cast("string"), "b": F.lit(None).cast("boolean"), "x": F.lit(None).cast("binary")}
    if v.kind == "any":
        rank = F.when(v.col["vt"].isin(1, 2, 5), 1).when(v.col["vt"].isin(3, 6), 2).when(v.col["vt"] == 4, 3).when(v.col["vt"] == 7, 4).when(v.col["vt"].isNotNull(), 5).otherwise(6)
        parts = {"r": rank, "n": F.coalesce(v.col["v_double"], v.col["v_long"].cast("double")), "s": v.col["v_str"], "b": v.col["v_bool"], "x": v.col["v_bytes"]}
    else:
        slot = {"number": "n", "instant": "n", "string": "s", "boolean": "b"}.get(v.cls, "x")
        parts = empty | ({"r": F.when(v.col.isNotNull(), _RANK.get(v.cls, 5)).otherwise(6), slot: v.col.cast("double") if slot == "n" else v.col} if v.kind != "null" else {})
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def js_number(col: Column, kind: str) -> Column:
    """A number as text: the shortest digits, plain from 1e-6 to below 1e21 and with an exponent (1e+21) elsewhere."""
    if kind != "double":
        return col.cast("string")
    size, java = F.abs(col), col.cast("string")
    exponent = F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), "E(?!-)", "e+")
    stripped = lambda scale: F.regexp_replace(col.try_cast(f"decimal(38,{scale})").cast("string"), r"0+$", "")
    out = F.when(F.isnan(col) | (size == float("inf")), java).when((size >= 1e21) | (size < 1e-6) & (col != 0), F.regexp_replace(exponent, "E", "e"))
    out = out.when((size < 2.0**62) & (col == F.floor(col)), col.try_cast("bigint").cast("string")).when(size >= 2.0**53, col.try_cast("decimal(38,0)").cast("string"))
    return out.when((size >= 1e-3) & (size < 1e7), java).when(size < 1, stripped(24)).otherwise(stripped(18))


def text(v: Val) -> Column:
    """A value as text; null is the empty text."""
    if v.kind == "null":
        return F.lit("")
    if v.kind == "instant":
        return F.coalesce(F.date_format(F.timestamp_millis(v.col), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    if v.kind == "any":
        return F.coalesce(v.col["v_str"], js_number(v.col["v_double"], "double"), v.col["v_long"].cast("string"), v.col["v_bool"].cast("string"), F.lit(""))
    return F.coalesce(js_number(v.col, v.kind) if v.cls == "number" else v.col.cast("string"), F.lit(""))

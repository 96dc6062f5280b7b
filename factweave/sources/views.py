"""Database views: facts as a DataFrame of datoms, or ordinary tables read as facts.

A view gives relations by attribute. `star` gives several single-valued attributes of one entity in one scan,
which spares the joins of an entity-attribute-value layout.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import SLOTS, SPARK_TYPES, TAGS, kind_of, plain
from ..plans.query import Lookup, QueryError

#: First entity id of transactions: that of transaction t is TX0 + t.
TX0 = 1 << 42
#: Attributes with smaller ids describe the schema and transactions.
BOOT_LIMIT = 1000

DATOMS = T.StructType([T.StructField(n, k) for n, k in (("e", T.LongType()), ("a", T.LongType()), ("vt", T.ByteType()), ("v_long", T.LongType()), ("v_double", T.DoubleType()), ("v_str", T.StringType()), ("v_bool", T.BooleanType()), ("v_bytes", T.BinaryType()), ("t", T.LongType()), ("op", T.BooleanType()))])
VALUE = ("vt", "v_long", "v_double", "v_str", "v_bool", "v_bytes")


@dataclass(frozen=True)
class Attribute:
    ident: str
    id: int
    kind: str
    many: bool = False
    unique: str | None = None  # identity or value
    index: bool = False
    component: bool = False
    target: str | None = None  # namespace that a reference points at, where known

    @property
    def namespace(self) -> str:
        return self.ident.split("/")[0]


@dataclass(frozen=True)
class Schema:
    attributes: Mapping[str, Attribute]
    idents: Mapping[str, int]  # entity idents, attributes included

    @functools.cached_property
    def by_id(self) -> dict[int, Attribute]:
        return {a.id: a for a in self.attributes.values()}

    def attr(self, name) -> Attribute:
        found = self.by_id.get(name) if isinstance(name, int) else self.attributes.get(str(name).lstrip(":"))
        if found is None:
            raise QueryError(f"unknown attribute {name}")
        return found

    def namespace(self, ns: str) -> list[Attribute]:
        return [a for a in self.attributes.values() if a.namespace == ns]


class View:
    """What the compiler needs of a database."""

    spark: SparkSession
    schema: Schema
    past = False  # shows retractions too

    def relation(self, attr: Attribute, tx: bool = False) -> DataFrame:
        """(e, v[, t, op]) of one attribute."""
        raise NotImplementedError

    def everything(self) -> DataFrame:
        """All facts, as DATOMS."""
        raise NotImplementedError

    def star(self, attrs: Sequence[Attribute]) -> DataFrame | None:
        """(e, one column for each attribute by ident, null where absent), or None if the layout can't."""
        return None

    def identifies(self, attr: Attribute) -> bool:
        """Whether an entity's id follows from this attribute's value."""
        return False

    def entid(self, ref) -> int | None:
        """Entity id of an id, an ident, or a lookup reference."""
        if isinstance(ref, bool):
            raise QueryError("no entity is named by a boolean")
        if isinstance(ref, int):
            return ref
        if isinstance(ref, str):
            return self.schema.idents.get(ref.lstrip(":"))
        if isinstance(ref, (list, tuple)) and len(ref) == 2:
            ref = Lookup(str(ref[0]).lstrip(":"), ref[1])
        if isinstance(ref, Lookup):
            attr = self.schema.attr(ref.attr)
            if not attr.unique:
                raise QueryError(f"{attr.ident} isn't unique")
            rows = self.relation(attr).where(F.col("v") == F.lit(coerced(attr.kind, ref.value))).select("e").limit(1).collect()
            return rows[0][0] if rows else None
        raise QueryError(f"no entity is named by {ref!r}")

    def values(self, attrs: Iterable[Attribute]) -> DataFrame:
        """(e, a, value struct) of some attributes."""
        facts = self.everything().where(F.col("a").isin([a.id for a in attrs]))
        return facts.select("e", "a", F.struct(*VALUE).alias("v"))

    # point reads

    def datoms(self, e=None, a=None, v=None) -> DataFrame:
        """Facts by prefix: any of entity, attribute and value may be left out."""
        out = self.everything()
        if e is not None:
            out = out.where(F.col("e") == self.entid(e))
        if a is not None:
            attr = self.schema.attr(a)
            out = out.where(F.col("a") == attr.id)
            if v is not None:
                out = out.where(F.col(SLOTS[attr.kind]) == F.lit(coerced(attr.kind, v)))
        return out

    def seek_many(self, keys: DataFrame) -> DataFrame:
        """Facts for many (e) or (e, a) keys at once, with all columns of keys: repeated keys repeat, and a key without
        facts has one row of nulls, so results can be set beside the keys."""
        on = [c for c in ("e", "a") if c in keys.columns]
        return keys.join(self.everything(), on, "left")

    def first(self, **prefix):
        rows = self.datoms(**prefix).orderBy("e", "a", *VALUE, "t").limit(1).collect()
        return rows[0] if rows else None

    def stored(self) -> DataFrame:
        """All facts that an index holds, history included."""
        return self.everything()

    def estimate(self, attr=None) -> int:
        """Facts that a scan would read: of the whole history, before views and policies."""
        out = self.stored()
        return (out if attr is None else out.where(F.col("a") == self.schema.attr(attr).id)).count()

    def exists(self, e) -> bool:
        eid = self.entid(e)
        return eid is not None and bool(self.datoms(e=eid).limit(1).count())

    def entity(self, e) -> dict:
        """All attributes of an entity, many-valued ones as lists."""
        out: dict = {}
        eid = self.entid(e)
        if eid is None:
            return out
        for r in self.datoms(e=eid).orderBy("a", *VALUE).collect():
            attr = self.schema.by_id.get(r["a"])
            if attr is None:
                continue
            value = r[SLOTS[attr.kind]]
            if attr.many:
                out.setdefault(attr.ident, []).append(value)
            else:
                out[attr.ident] = value
        return out | ({"db/id": eid} if out else {})

    @staticmethod
    def is_tx(e: int) -> bool:
        return e >= TX0


def coerced(kind: str, value):
    """A constant as a column of this kind holds it."""
    value = plain(value)
    if kind == "double" and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind == "instant" and isinstance(value, str):
        from ..edn import Instant

        return int(Instant.of(value))
    return value


def value_struct(col: Column, kind: str) -> Column:
    """A typed column as the tagged union."""
    slot = SLOTS[kind]
    cells = [F.lit(TAGS[kind]).cast("tinyint").alias("vt")]
    for f in VALUE[1:]:
        cells.append((col if f == slot else F.lit(None)).cast(DATOMS[f].dataType).alias(f))
    return F.struct(*cells)


@dataclass(frozen=True)
class Facts(View):
    """A DataFrame of datoms, seen as of a transaction, with its history or without."""

    spark: SparkSession
    log: DataFrame
    schema: Schema
    bound: int | None = None
    past: bool = False
    snapshot: bool = False  # the log is already the current state: nothing to collapse
    allowed: object = None  # a policy filter: function of (facts, view) to facts

    def as_of(self, t: int) -> Facts:
        return replace(self, bound=t if self.bound is None else min(t, self.bound))

    def history(self) -> Facts:
        return replace(self, past=True)

    def filtered(self, allowed) -> Facts:
        return replace(self, allowed=allowed)

    def overlaid(self, pending: DataFrame) -> Facts:
        """With the facts of transactions that aren't confirmed yet."""
        return replace(self, log=self.log.unionByName(pending), snapshot=False)

    @property
    def basis(self) -> int:
        return self.log.agg(F.max("t")).head()[0] or 0

    def _shown(self, rows: DataFrame) -> DataFrame:
        if self.bound is not None:
            rows = rows.where(F.col("t") <= self.bound)
        if not self.past and not self.snapshot:
            # the last of (t, op) decides; grouping combines before the shuffle
            rows = rows.groupBy("e", "a", *VALUE).agg(F.max(F.struct("t", "op")).alias("m")).where("m.op").select("e", "a", *VALUE, F.col("m.t").alias("t"), F.col("m.op").alias("op"))
        return self.allowed(rows, self) if self.allowed else rows

    def everything(self) -> DataFrame:
        return self._shown(self.log)

    def stored(self) -> DataFrame:
        return self.log

    def relation(self, attr: Attribute, tx: bool = False) -> DataFrame:
        rows = self._shown(self.log.where(F.col("a") == attr.id))
        return rows.select("e", F.col(SLOTS[attr.kind]).alias("v"), *(("t", "op") if tx else ()))

    def star(self, attrs: Sequence[Attribute]) -> DataFrame | None:
        if self.past or any(a.many for a in attrs) or len(attrs) < 2:
            return None
        rows = self._shown(self.log.where(F.col("a").isin([a.id for a in attrs])))
        return rows.groupBy("e").agg(*[F.max(F.when(F.col("a") == a.id, F.col(SLOTS[a.kind]))).alias(a.ident) for a in attrs])


@dataclass(frozen=True)
class Column_:
    """A table's column as an attribute: its name there, and the table that it refers to."""

    name: str
    kind: str
    refers: str | None = None


class Tables(View):
    """Tables as namespaces: a row is an entity, a column an attribute `table/column`.

    An entity id is (number of the table << 36) + row key, so it cannot meet a transaction's; keys are unique. A foreign
    key is an attribute twice: under its own name as a reference to the other table's entity, and as `name#` plain."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame], keys: Mapping[str, Column | str], refs: Mapping[str, Mapping[str, str]] | None = None, names=lambda table, column: column):
        self.spark, self.frames, self.keys = spark, dict(frames), dict(keys)
        self.number = {t: k + 1 for k, t in enumerate(sorted(frames))}
        attrs: dict[str, Attribute] = {}
        self.columns: dict[str, tuple[str, Column]] = {}
        next_id = 1000
        for table in sorted(frames):
            df = frames[table]
            for f in df.schema.fields:
                base = f"{table}/{names(table, f.name)}"
                target = (refs or {}).get(table, {}).get(f.name)
                kind, value = _column_kind(f.dataType, df[f.name])
                if kind is None:
                    continue
                shown = [(base, "ref", self._entity(target, df[f.name]), target), (base + "#", kind, value, None)] if target else [(base, kind, value, None)]
                for ident, k, col, to in shown:
                    unique = "identity" if isinstance(self.keys[table], str) and f.name == self.keys[table] and not to else None
                    attrs[ident] = Attribute(ident, next_id, k, False, unique, bool(unique), False, to)
                    self.columns[ident] = table, col
                    next_id += 1
        self.schema = Schema(attrs, {a.ident: a.id for a in attrs.values()})

    def _entity(self, table: str, key: Column) -> Column:
        return (F.lit(self.number[table] << 36) + key).cast("bigint")

    def _e(self, table: str) -> Column:
        key = self.keys[table]
        return self._entity(table, self.frames[table][key] if isinstance(key, str) else key)

    def identifies(self, attr: Attribute) -> bool:
        return attr.unique == "identity" and attr.kind == "long"

    def entid(self, ref) -> int | None:
        """A row's id follows from its key: no read, and a key without a row names an entity without facts."""
        if isinstance(ref, (list, tuple)) and len(ref) == 2:
            ref = Lookup(str(ref[0]).lstrip(":"), ref[1])
        if isinstance(ref, Lookup) and isinstance(ref.value, int) and not isinstance(ref.value, bool):
            attr = self.schema.attr(ref.attr)
            if attr.unique and attr.kind == "long":
                return (self.number[attr.namespace] << 36) + ref.value
        return super().entid(ref)

    def relation(self, attr: Attribute, tx: bool = False) -> DataFrame:
        table, col = self.columns[attr.ident]
        out = self.frames[table].select(self._e(table).alias("e"), col.alias("v"), *((F.lit(1).cast("bigint").alias("t"), F.lit(True).alias("op")) if tx else ()))
        return out.where(F.col("v").isNotNull())

    def star(self, attrs: Sequence[Attribute]) -> DataFrame | None:
        tables = {self.columns[a.ident][0] for a in attrs}
        if len(tables) != 1:
            return None
        table, = tables
        return self.frames[table].select(self._e(table).alias("e"), *[self.columns[a.ident][1].alias(a.ident) for a in attrs])

    def everything(self) -> DataFrame:
        parts = []
        for a in self.schema.attributes.values():
            parts.append(self.relation(a).select("e", F.lit(a.id).cast("bigint").alias("a"), value_struct(F.col("v"), a.kind).alias("x")).select("e", "a", "x.*", F.lit(1).cast("bigint").alias("t"), F.lit(True).alias("op")))
        return functools.reduce(DataFrame.unionByName, parts)

    def members(self, ns: str) -> DataFrame:
        """(e) of all rows of a table."""
        return self.frames[ns].select(self._e(ns).alias("e"))


def _column_kind(kind: T.DataType, col: Column) -> tuple[str | None, Column]:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "long", col.cast("bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "double", col.cast("double")
    if isinstance(kind, T.StringType):
        return "string", col
    if isinstance(kind, T.BooleanType):
        return "boolean", col
    if isinstance(kind, T.BinaryType):
        return "bytes", col
    if isinstance(kind, T.DateType):
        return "instant", F.unix_millis(F.to_timestamp(col))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "instant", F.unix_millis(col.cast("timestamp"))
    return None, col


__all__ = ["DATOMS", "TX0", "VALUE", "Attribute", "Facts", "Schema", "Tables", "View", "coerced", "kind_of", "value_struct", "SPARK_TYPES"]

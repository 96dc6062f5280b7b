"""Transactions: operations to datoms, appended to a log by one writer.

The driver resolves a transaction's operations (it is small: what a client sends at once) with a few filtered
reads of the current view, and appends the datoms. Facts are stored before the connection's own state moves, so a
failure of any kind leaves it where it was.

A store keeps the log as Parquet: `log/t=<n>` folders that a commit marker makes visible, and compactions: `snap/<n>`
holds the attributes that the log touched since the last one, partitioned by attribute and sorted by entity, and the
manifest `roots/<n>` names, for every attribute, the folder that has it. A manifest is written aside and renamed, so
the newest one is whole; nothing that a manifest names is ever written again. A transaction number is claimed by
creating `claims/<n>`, which fails for a second writer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .edn import Const, Instant, Uuid
from .functions.values import SLOTS, SPARK_TYPES, TAGS, kind_of, plain
from .sources.views import DATOMS, TX0, VALUE, Attribute, Facts, Schema, coerced


class TxError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


FIRST_USER = 1000
#: Attributes that describe attributes: ident -> (id, kind).
BOOT = {"db/ident": (10, "string"), "db/valueType": (40, "ref"), "db/cardinality": (41, "ref"), "db/unique": (42, "ref"), "db/index": (43, "boolean"), "db/isComponent": (44, "boolean"), "db/txInstant": (50, "instant"), "db/doc": (62, "string"), "db/clientTx": (63, "string")}
#: Entities that one transaction may retract along component references: they pass through the driver.
CLOSURE = 10_000
#: Transactions of clients that are remembered.
REPLAYS = 256
#: Entities that schema values name.
ENUMS = {f"db.type/{k}": 100 + t for k, t in TAGS.items()} | {"db.cardinality/one": 120, "db.cardinality/many": 121, "db.unique/identity": 122, "db.unique/value": 123}
_ENUM_NAMES = {v: k for k, v in ENUMS.items()}
SAFE = 2**53 - 1


def datom(e: int, attr: Attribute, value, t: int, op: bool) -> tuple:
    cells: dict[str, Any] = dict.fromkeys(VALUE[1:])
    cells[SLOTS[attr.kind]] = value
    return (e, attr.id, TAGS[attr.kind], *(cells[f] for f in VALUE[1:]), t, op)


def checked(attr: Attribute, value):
    """The value as its attribute stores it, or a TxError."""
    value = value.value if isinstance(value, Const) else value
    if value is None:
        raise TxError("null", f"{attr.ident} cannot hold null")
    try:
        kind = kind_of(value)
    except TypeError as error:
        raise TxError("type", str(error)) from None
    raw = coerced(attr.kind, value)
    ok = {
        "long": kind == "long" and abs(raw) <= SAFE,
        "double": kind in ("long", "double") and raw == raw,
        "string": kind == "string",
        "boolean": kind == "boolean",
        "ref": kind == "long" and raw >= 0,
        "uuid": kind in ("uuid", "string") and bool(Uuid.PATTERN.fullmatch(str(raw).lower())),
        "instant": kind == "instant" or isinstance(value, (str, int)) and isinstance(raw, int) and not isinstance(value, bool),
        "bytes": kind == "bytes",
    }[attr.kind]
    if not ok:
        raise TxError("type", f"{attr.ident} takes a {attr.kind}, not {value!r}")
    if attr.kind == "double":
        return float(raw) + 0.0
    return str(raw).lower() if attr.kind == "uuid" else bytes(raw) if attr.kind == "bytes" else raw


def schema_of(rows: Sequence[tuple]) -> Schema:
    """The schema that asserted facts (e, attribute id, value) describe."""
    facts: dict[int, dict[int, Any]] = {}
    for e, a, v in rows:
        facts.setdefault(e, {})[a] = v
    attrs = {n: Attribute(n, i, k, False, "identity" if n == "db/ident" else None, n == "db/ident") for n, (i, k) in BOOT.items()}
    idents = {n: a.id for n, a in attrs.items()} | ENUMS
    for e, f in facts.items():
        name = f.get(10)
        if name is None:
            continue
        idents[name] = e
        kind = _ENUM_NAMES.get(f.get(40), "").removeprefix("db.type/")
        if kind:
            unique = _ENUM_NAMES.get(f.get(42), "").removeprefix("db.unique/") or None
            attrs[name] = Attribute(name, e, kind, f.get(41) == 121, unique, bool(f.get(43)) or bool(unique), bool(f.get(44)))
    return Schema(attrs, idents)


@dataclass
class Report:
    t: int
    tempids: dict[str, int]
    datoms: list[tuple]


class StaleError(RuntimeError):
    """A store that hasn't reached the transaction that a reader must see."""


class Connection:
    """One database: a log of datoms with a single writer."""

    def __init__(self, spark: SparkSession, now=None, log: DataFrame | None = None, path: str | None = None):
        self.spark, self.path = spark, path
        self._now = now or (lambda: int(time.time() * 1000))
        self._tail: list[tuple] = []
        self._base = log
        self.t, self._next = 1, FIRST_USER
        self._schema_rows: dict[tuple[int, int], Any] = {}
        self._done: dict[str, Report] = {}
        if log is not None:
            told = log.where((F.col("a") == BOOT["db/clientTx"][0]) & F.col("op")).orderBy(F.desc("t")).limit(REPLAYS).select("t", "v_str").collect()
            for r in reversed(told):
                name, tempids = json.loads(r["v_str"])
                self._done[name] = Report(r["t"], tempids, None)
            top = log.agg(F.max("t"), F.max(F.when((F.col("e") < TX0) & (F.col("e") >= FIRST_USER), F.col("e")))).head()
            self.t, self._next = top[0] or 1, max(FIRST_USER, (top[1] or 0) + 1)
            current = Facts(spark, log, schema_of([])).everything().where(F.col("a").isin([i for i, _ in BOOT.values()])).select("e", "a", F.col("v_str"), F.col("v_long"), F.col("v_bool")).collect()
            self._schema_rows = {(r["e"], r["a"]): next((x for x in r[2:] if x is not None), None) for r in current}
        self.schema = schema_of([(e, a, v) for (e, a), v in self._schema_rows.items()])

    @staticmethod
    def from_datoms(spark: SparkSession, log: DataFrame) -> Connection:
        return Connection(spark, log=log)

    def log(self) -> DataFrame:
        tail = self.spark.createDataFrame(self._tail, DATOMS)
        return tail if self._base is None else self._base.unionByName(tail) if self._tail else self._base

    def db(self) -> Facts:
        return Facts(self.spark, self.log(), self.schema)

    def with_ops(self, ops: Sequence) -> tuple[Facts, Report]:
        """The view that a transaction would give, without writing it (an optimistic overlay)."""
        rows, report = self._expand(ops)
        return self.db().overlaid(self.spark.createDataFrame(rows, DATOMS)), report

    def transact(self, ops: Sequence, client_id: str | None = None, policy=None, who=None) -> Report:
        """Apply operations all or none, completed and checked by a policy if one is given. A client id that was applied
        before gives its report again."""
        if client_id is not None and client_id in self._done:
            known = self._done[client_id]
            if known.datoms is None:  # of an earlier connection: its facts are in the log
                known.datoms = [tuple(r) for r in self.log().where(F.col("t") == known.t).collect()]
            return known
        rows, report = self._expand(ops)
        if policy is not None:
            rows[:] = policy.completed(self.db(), who, rows)
            policy.check(self.db(), who, rows)
        if client_id is not None:
            rows.append(datom(TX0 + report.t, self.schema.by_id[BOOT["db/clientTx"][0]], json.dumps([client_id, report.tempids]), report.t, True))
        if self.path is not None:
            self._persist(rows, report.t, report.t)
        self._apply(rows)
        self.t, self._next = report.t, self._pending_next
        if client_id is not None:
            self._done[client_id] = report
            while len(self._done) > REPLAYS:
                self._done.pop(next(iter(self._done)))
        return report

    def transact_many(self, batch: Sequence[Sequence]) -> list[Report]:
        """A group of transactions committed by one write; none is kept if one fails, or the write does."""
        state = self.t, self._next, list(self._tail), dict(self._schema_rows), self.schema, dict(self._done)
        path, self.path = self.path, None
        try:
            out = [self.transact(ops) for ops in batch]
            if path is not None and out:
                Store(self.spark, path).append(self.spark.createDataFrame([d for r in out for d in r.datoms], DATOMS), out[-1].t, out[0].t)
        except BaseException:
            self.t, self._next, self._tail, self._schema_rows, self.schema, self._done = state
            raise
        finally:
            self.path = path
        return out

    def _apply(self, rows: list[tuple]) -> None:
        self._tail += rows
        boot = {i for i, _ in BOOT.values()}
        for r in rows:
            if r[1] in boot:
                value = next((x for x in r[3:8] if x is not None), None)
                if r[-1]:
                    self._schema_rows[r[0], r[1]] = value
                elif self._schema_rows.get((r[0], r[1])) == value:
                    self._schema_rows.pop((r[0], r[1]))
        self.schema = schema_of([(e, a, v) for (e, a), v in self._schema_rows.items()])

    # resolution

    def _expand(self, ops: Sequence) -> tuple[list[tuple], Report]:
        view, t = self.db(), self.t + 1
        tx = TX0 + t
        flat: list[tuple] = []
        fresh = iter(range(10**9))
        for op in ops:
            self._flatten(op, flat, fresh)
        attr = self._attr
        temp = lambda x: isinstance(x, str) and not x.startswith(":") and x != "db/tx" or isinstance(x, int) and not isinstance(x, bool) and x < 0
        # lookups that the operations need, answered with one read for each attribute
        wanted: dict[str, set] = {}
        for op, e, a, v in flat:
            for x in (e, v if a is not None and attr(a).kind == "ref" else None):
                if isinstance(x, list):
                    wanted.setdefault(attr(x[0]).ident, set()).add(checked(attr(x[0]), x[1]))
            if op == "add" and attr(a).unique:
                known = attr(a)
                if known.kind != "ref" or not temp(v):
                    wanted.setdefault(known.ident, set()).add(self._plain_value(known, v, temp))
        held = {name: {r["v"]: r["e"] for r in view.relation(self._attr(name)).where(F.col("v").isin([plain(x) for x in values if x is not None])).collect()} for name, values in wanted.items()}
        ids: dict[Any, int] = {}
        owner: dict[tuple, Any] = {}
        alias: dict[Any, Any] = {}

        def root(x):
            while x in alias:
                x = alias[x]
            return x

        for op, e, a, v in flat:  # upsert by identity, and temporary ids that mean one entity
            if op == "add" and temp(e) and attr(a).unique == "identity":
                key = attr(a).ident, self._plain_value(attr(a), v, temp)
                found = held.get(key[0], {}).get(key[1])
                if found is not None:
                    if ids.get(root(e), found) != found:
                        raise TxError("unique-conflict", f"{e} names two entities")
                    ids[root(e)] = found
                elif key in owner and root(owner[key]) != root(e):
                    x, y = root(owner[key]), root(e)
                    alias[y] = x
                    if y in ids:
                        ids.setdefault(x, ids[y])
                else:
                    owner[key] = e
        self._pending_next = self._next

        def entity(x) -> int:
            if isinstance(x, list):
                known = attr(x[0])
                if not known.unique:
                    raise TxError("lookup", f"{known.ident} isn't unique")
                found = held.get(known.ident, {}).get(checked(known, x[1]))
                if found is None:
                    raise TxError("lookup", f"no entity has {known.ident} {x[1]!r}")
                return found
            if x in ("db/tx", ":db/tx"):
                return tx
            if temp(x):
                x = root(x)
                if x not in ids:
                    ids[x] = self._pending_next
                    self._pending_next += 1
                return ids[x]
            if isinstance(x, str):
                if x.lstrip(":") not in self.schema.idents:
                    raise TxError("ident", f"unknown ident {x}")
                return self.schema.idents[x.lstrip(":")]
            if isinstance(x, int) and not isinstance(x, bool):
                return x
            raise TxError("entity", f"{x!r} names no entity")

        steps: list[tuple] = []
        for op, e, a, v in flat:
            if op == "gone":
                steps.append((op, entity(e), None, None))
                continue
            known = attr(a)
            if v is None and op == "retract":
                steps.append((op, entity(e), known, None))
            else:
                value = checked(known, entity(v)) if known.kind == "ref" and (isinstance(v, (str, list)) or temp(v)) else checked(known, v.lstrip(":") if known.ident == "db/ident" and isinstance(v, str) else v)
                steps.append((op, entity(e), known, value))
        gone = self._closure(view, [e for op, e, *_ in steps if op == "gone"])
        touched = {e for _, e, *_ in steps} | set(gone)
        now: dict[int, dict[int, set]] = {}
        if touched:
            for r in view.everything().where(F.col("e").isin(list(touched))).collect():
                if r["a"] in self.schema.by_id:
                    now.setdefault(r["e"], {}).setdefault(r["a"], set()).add(self._cell(r))
        added: dict[tuple, None] = {}
        removed: dict[tuple, None] = {}
        for op, e, known, value in steps:
            own = now.setdefault(e, {}).setdefault(known.id, set()) if known else set()
            if op == "add":
                if value in own:
                    removed.pop((e, known.id, value), None)
                    continue
                if not known.many:
                    for old in own:
                        removed[e, known.id, old] = None
                    own.clear()
                own.add(value)
                added[e, known.id, value] = None
            elif op == "retract":
                for old in [value] if value is not None else list(own):
                    if old in own:
                        own.discard(old)
                        if added.pop((e, known.id, old), 0) == 0:
                            removed[e, known.id, old] = None
        if gone:
            for e in gone:
                for a, values in now.get(e, {}).items():
                    for v in values:
                        if added.pop((e, a, v), 0) == 0:
                            removed[e, a, v] = None
            for r in view.everything().where((F.col("vt") == TAGS["ref"]) & F.col("v_long").isin(gone)).collect():
                if r["a"] in self.schema.by_id:
                    removed[r["e"], r["a"], r["v_long"]] = None
            for e, a, v in list(added):
                if self.schema.by_id[a].kind == "ref" and v in gone:
                    added.pop((e, a, v))
        self._check_unique(view, added, removed, held)
        stamp = (tx, BOOT["db/txInstant"][0])
        rows = [datom(e, self.schema.by_id[a], v, t, False) for e, a, v in removed] + [datom(e, self.schema.by_id[a], v, t, True) for e, a, v in added]
        if not any((e, a) == stamp for e, a, _ in added):
            rows.append(datom(tx, self.schema.by_id[stamp[1]], self._now(), t, True))
        names = {str(k): v for k, v in ids.items() if not (isinstance(k, str) and k.startswith("\0"))} | {str(k): ids[root(k)] for k in alias if root(k) in ids}
        return rows, Report(t, names, rows)

    def _attr(self, name) -> Attribute:
        found = self.schema.attributes.get(str(name).lstrip(":"))
        if found is None:
            raise TxError("attribute", f"unknown attribute {name}")
        return found

    def _plain_value(self, attr: Attribute, v, temp):
        if attr.ident == "db/ident" and isinstance(v, str):
            return v.lstrip(":")
        return None if attr.kind == "ref" and (temp(v) or isinstance(v, (str, list))) else checked(attr, v)

    def _cell(self, r):
        return r[SLOTS[self.schema.by_id[r["a"]].kind]] if r["v_bytes"] is None else bytes(r["v_bytes"])

    def _flatten(self, op, out: list[tuple], fresh) -> Any:
        """Operations and nested maps as (add | retract | gone, e, attribute, value); returns the entity."""
        if isinstance(op, Mapping):
            op = {str(k): v for k, v in op.items()}
            e = op.get(":db/id", op.get("db/id"))
            if e is None:
                e = f"\0{next(fresh)}"
            for k, v in op.items():
                if k.lstrip(":") == "db/id":
                    continue
                ns, _, name = k.lstrip(":").rpartition("/")
                if name.startswith("_"):
                    for x in v if isinstance(v, (list, tuple)) and not self._is_lookup(v) else [v]:
                        x = self._flatten(x, out, fresh) if isinstance(x, Mapping) else x
                        out.append(("add", x, f"{ns}/{name[1:]}", e))
                    continue
                attr = self._attr(k)
                many = isinstance(v, (list, tuple, set)) and not (attr.kind == "ref" and self._is_lookup(v))
                for x in v if many else [v]:
                    if isinstance(x, Mapping):
                        x = self._flatten(x, out, fresh)
                    out.append(("add", e, attr.ident, list(x) if isinstance(x, tuple) else x))
            return e
        if not isinstance(op, (list, tuple)) or not op:
            raise TxError("form", f"not an operation: {op!r}")
        name = str(op[0]).lstrip(":")
        if name == "db/add" and len(op) == 4:
            v = op[3]
            out.append(("add", op[1], self._attr(op[2]).ident, self._flatten(v, out, fresh) if isinstance(v, Mapping) else v))
        elif name == "db/retract" and len(op) in (3, 4):
            out.append(("retract", op[1], self._attr(op[2]).ident, op[3] if len(op) == 4 else None))
        elif name == "db/retractEntity" and len(op) == 2:
            out.append(("gone", op[1], None, None))
        else:
            raise TxError("form", f"not an operation: {op!r}")
        return op[1]

    def _is_lookup(self, v) -> bool:
        return len(v) == 2 and isinstance(v[0], str) and v[0].startswith(":") and v[0][1:] in self.schema.attributes and bool(self._attr(v[0]).unique)

    def _closure(self, view: Facts, start: list[int]) -> list[int]:
        """Entities and, over component references, their parts."""
        parts = [a.id for a in self.schema.attributes.values() if a.component and a.kind == "ref"]
        seen, edge = dict.fromkeys(start), list(start)
        while edge and parts:
            rows = view.everything().where(F.col("a").isin(parts) & F.col("e").isin(edge)).select("v_long").collect()
            edge = [r[0] for r in rows if r[0] not in seen]
            seen.update(dict.fromkeys(edge))
            if len(seen) > CLOSURE:
                raise TxError("closure", f"an entity has more than {CLOSURE} parts; retract them in several transactions")
        return list(seen)

    def _check_unique(self, view: Facts, added, removed, held) -> None:
        mine: dict[tuple, int] = {}
        for e, a, v in added:
            attr = self.schema.by_id[a]
            if not attr.unique:
                continue
            if mine.setdefault((a, v), e) != e:
                raise TxError("unique-conflict", f"two entities are given {attr.ident} {v!r}")
            other = held.get(attr.ident, {}).get(v)
            if other is None and attr.kind == "ref":
                found = view.relation(attr).where(F.col("v") == v).select("e").head()
                other = found[0] if found else None
            if other is not None and other != e and (other, a, v) not in removed:
                raise TxError("unique-conflict", f"{attr.ident} {v!r} belongs to another entity")

    # storage

    def _persist(self, rows: list[tuple], t: int, first: int) -> None:
        Store(self.spark, self.path).append(self.spark.createDataFrame(rows, DATOMS), t, first)


class Store:
    """Parquet layout of a log: committed transaction folders and compacted snapshots."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        p = self._path(f"{self.path}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _create(self, name: str, content: str) -> bool:
        """Create a small file, whole or not at all; False if it is there already."""
        target, aside = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/.aside-{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target):
            return False
        out = self._fs.create(aside, True)
        out.write(bytearray(content.encode()))
        out.close()
        return bool(self._fs.rename(aside, target)) or bool(self._fs.delete(aside, False)) and False

    def append(self, rows: DataFrame, t: int, first: int | None = None) -> None:
        """Write the datoms of transactions first to t; they are visible once Spark's commit marker is there. A writer
        that comes second to a number is refused."""
        numbers = range(t if first is None else first, t + 1)
        claimed = []
        try:
            for n in numbers:
                claim = self._path(f"{self.path}/claims/{n:012d}")
                self._fs.mkdirs(claim.getParent())
                if not self._fs.createNewFile(claim):  # atomic: one of two writers makes it
                    raise TxError("conflict", f"another writer has transaction {n}")
                claimed.append(claim)
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/t={t:012d}")
        except BaseException:
            for claim in claimed:
                self._fs.delete(claim, False)
            raise

    def recover(self) -> list[int]:
        """Give up the claims of writers that died before they committed. Only while no writer is at work."""
        done = max([*self.committed(), self.current(), 0])
        left = [int(n) for n in self._names("claims") if int(n) > done]
        for n in left:
            self._fs.delete(self._path(f"{self.path}/claims/{n:012d}"), False)
        return left

    def committed(self, after: int = 0) -> list[int]:
        return [t for n in self._names("log") if n.startswith("t=") and (t := int(n[2:])) > after and self._fs.exists(self._path(f"{self.path}/log/{n}/_SUCCESS"))]

    def current(self) -> int:
        """The transaction of the newest snapshot; 0 if there is none."""
        return max((int(n) for n in self._names("roots")), default=0)

    def manifest(self, t: int) -> dict[int, int]:
        """Attribute -> the snapshot whose folder has it, as of snapshot t."""
        if not t:
            return {}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/roots/{t:012d}", wholetext=True).collect())
        return {int(a): s for a, s in json.loads(text).items()}

    def tail(self, after: int) -> DataFrame:
        done = self.committed(after)
        files = [f"{self.path}/log/t={t:012d}" for t in done]
        return self.spark.read.schema(DATOMS).parquet(*files) if files else self.spark.createDataFrame([], DATOMS)

    def snapshot(self, t: int | None = None) -> DataFrame:
        """History of all transactions up to a snapshot, as compacted."""
        t = self.current() if t is None else t
        folders: dict[int, list[int]] = {}
        for a, s in self.manifest(t).items():
            folders.setdefault(s, []).append(a)
        out = self.spark.createDataFrame([], DATOMS)
        for s, attrs in sorted(folders.items()):
            base = f"{self.path}/snap/{s:012d}"
            part = self.spark.read.option("basePath", base).parquet(*[f"{base}/a={a}" for a in sorted(attrs)])
            out = out.unionByName(part.withColumn("a", F.col("a").cast("bigint")).select(*DATOMS.fieldNames()))
        return out

    def log(self) -> DataFrame:
        t = self.current()
        return self.snapshot(t).unionByName(self.tail(t)) if t else self.tail(0)

    def at_root(self, t: int) -> Facts:
        """The view of an old snapshot, as it was published."""
        return Connection(self.spark, log=self.snapshot(t)).db()

    def compact(self) -> int:
        """Merge the tail into a new snapshot: the attributes that it touches are written anew, partitioned by attribute
        and sorted by entity; the manifest takes all others from where they are."""
        root = self.current()
        done = self.committed(root)
        if not done:
            return root
        t, known, tail = done[-1], self.manifest(root), self.tail(root)
        touched = [r[0] for r in tail.select("a").distinct().collect()]  # attributes, not facts
        rows = tail.unionByName(self.snapshot(root).where(F.col("a").isin(touched))) if known else tail
        rows.repartition("a").sortWithinPartitions("a", "e").write.mode("overwrite").partitionBy("a").parquet(f"{self.path}/snap/{t:012d}")
        if not self._create(f"roots/{t:012d}", json.dumps(known | dict.fromkeys(touched, t))):
            raise TxError("conflict", f"snapshot {t} was published by another")
        return t

    def retain(self, n: int) -> list[int]:
        """Keep the n newest snapshots (the current one always) and all that they name; delete other folders, and the
        log before the oldest kept."""
        roots = sorted(int(x) for x in self._names("roots"))
        keep = sorted(set(roots[-n:] if n else []) | {self.current()})
        live = {s for t in keep for s in self.manifest(t).values()}
        for t in roots:  # a manifest goes before what it names
            if t not in keep:
                self._fs.delete(self._path(f"{self.path}/roots/{t:012d}"), False)
        for s in self._names("snap"):
            if int(s) not in live and int(s) <= keep[-1]:
                self._fs.delete(self._path(f"{self.path}/snap/{s}"), True)
        for t in self.committed():
            if t <= keep[0]:
                self._fs.delete(self._path(f"{self.path}/log/t={t:012d}"), True)
        return keep

    def connect(self, min_t: int = 0) -> Connection:
        """A connection that has seen transaction min_t, or a StaleError."""
        reached = max([*self.committed(), self.current()])
        if reached < min_t:
            raise StaleError(f"the store is at {reached}, behind {min_t}")
        return Connection(self.spark, log=self.log(), path=self.path)


__all__ = ["BOOT", "Connection", "Instant", "Report", "StaleError", "Store", "TxError", "SPARK_TYPES", "schema_of"]

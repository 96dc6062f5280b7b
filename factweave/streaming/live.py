"""Standing queries: a stream over a store's log runs a query again on each new batch of transactions.

A result is handed on only if its digest, which Spark computes over its rows, differs from the last one; an unchanged
result never comes to the driver. Views that are pinned to a transaction give one result and end. Transactions are
taken in the order of t; there is no event time. A run that fails is tried again after a wait that doubles; a query
that can't be right any more (an unknown attribute, a budget) ends the stream.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.compiler import run_query
from ..plans.query import BudgetError, QueryError
from ..sources.views import DATOMS, TX0, VALUE, Facts
from ..transactions import Connection, Store, TxError

#: Errors that another run won't mend.
TERMINAL = (QueryError, BudgetError, TxError)
#: Seconds before a failed run is tried again: first, and at most.
WAITS = (0.25, 5.0)


def digest(df: DataFrame) -> tuple:
    """Number of rows and two sums of their hashes, whatever their order."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return tuple(df.select(F.xxhash64(row).alias("x"), F.xxhash64(F.lit("salt"), row).alias("y")).agg(F.count("*"), F.bit_xor("x"), F.sum(F.col("y") % (1 << 40))).head())


class Live:
    """One standing query over a store."""

    def __init__(self, store: Store, query, *inputs, emit: Callable[[object, int], None], seen: Callable | None = None, tries: int = 8):
        self.store, self.query, self.inputs, self.emit, self.tries = store, query, inputs, emit, tries
        self.seen = seen or (lambda db: db)  # a policy's filter, or a pinned view
        self.ended: Exception | None = None
        self._last: tuple | None = None
        self.runs = 0

    def run(self, min_t: int = 0) -> bool:
        """Run once; True if the result was new."""
        db = self.seen(self.store.connect(min_t).db())
        result = run_query(db, self.query, *self.inputs)
        self.runs += 1
        now = digest(result.df)
        if now == self._last:
            return False
        self.emit(result.value(), db.bound if db.bound is not None else db.basis)
        self._last = now
        return True

    def _patiently(self, min_t: int = 0) -> None:
        wait = WAITS[0]
        for left in reversed(range(self.tries)):
            try:
                self.run(min_t)
                return
            except TERMINAL as error:
                self.ended = error
                raise
            except Exception:
                if not left:
                    raise
                time.sleep(wait)
                wait = min(2 * wait, WAITS[1])

    def start(self, spark: SparkSession, checkpoint: str, once: bool = False) -> StreamingQuery | None:
        """Follow the log; once: take what is there and stop. A pinned view runs once without a stream."""
        if self.seen(self.store.connect().db()).bound is not None:
            self.run()
            return None
        changes = spark.readStream.schema(DATOMS).option("recursiveFileLookup", "true").parquet(f"{self.store.path}/log")

        def batch(frame, _):
            reached = frame.agg(F.max("t")).head()[0]
            if reached is not None:
                self._patiently(reached)

        writer = changes.select("t").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1 second").start()


def changes(store: Store, after: int, now: Callable[[Facts], Facts] | None = None) -> list[dict]:
    """A principal's change feed: for each transaction behind `after`, the datoms visible to it, a skip mark if there are
    none but those of the transaction itself, or a resync mark where its view changed by more than the transaction's own datoms. now filters a view by the
    principal's policy, which is judged by the facts of that time."""
    conn, out = store.connect(), []
    log = conn.log()
    at = lambda t: now(Facts(conn.spark, log.where(F.col("t") <= t), conn.schema))
    numbers = [r[0] for r in log.where(F.col("t") > after).select("t").distinct().orderBy("t").collect()]
    for t in numbers:
        rows = log.where(F.col("t") == t)
        if now is not None:
            shown, before = at(t), at(t - 1)
            fact = ["e", "a", *VALUE]
            had, has = before.everything().select(*fact), shown.everything().select(*fact)
            own = rows.select(*fact)
            if not has.exceptAll(had).unionByName(had.exceptAll(has)).exceptAll(own).isEmpty():
                out.append({"t": t, "resync": True})
                continue
            # what it may see of the transaction: facts that it has now, or had
            rows = _kept(rows, has.unionByName(had).distinct(), fact)
        found = [tuple(r) for r in rows.collect()]
        out.append({"t": t, "datoms": found} if any(r[0] < TX0 for r in found) else {"t": t, "skip": True})
    return out


def _kept(rows: DataFrame, visible: DataFrame, fact: list[str]) -> DataFrame:
    other = visible.toDF(*[f"__{c}" for c in fact])
    cond = None
    for c in fact:
        same = rows[c].eqNullSafe(other[f"__{c}"])
        cond = same if cond is None else cond & same
    return rows.join(other, cond, "left_semi")


class Replica:
    """A follower of a store: takes transactions in any order, shows them in the order of t without gaps."""

    def __init__(self, store: Store):
        self.store, self.t = store, 0
        self._rows: list[tuple] = []
        self._base = store.log()
        self.t = self._base.agg(F.max("t")).head()[0] or 0

    def offer(self, t: int, rows: list[tuple]) -> str:
        """Take the datoms of a transaction: "applied", "duplicate" (known already), or "filled" if those before it had
        to be read from the store first; a transaction whose forerunners aren't there either is "early" and left."""
        if t <= self.t:
            return "duplicate"
        said = "applied"
        if t > self.t + 1:
            missing = [tuple(r) for r in self.store.tail(self.t).where((F.col("t") > self.t) & (F.col("t") < t)).collect()]
            if {r[-2] for r in missing} != set(range(self.t + 1, t)):
                return "early"
            self._rows += missing
            said = "filled"
        self._rows += rows
        self.t = t
        return said

    def db(self, min_t: int = 0) -> Facts:
        """The view at the replica's transaction; reads on to min_t if it is behind, and raises StaleError if it can't."""
        if self.t < min_t:
            self._base, self._rows = self.store.connect(min_t).log(), []
            self.t = self._base.agg(F.max("t")).head()[0] or 0
        tail = self.store.spark.createDataFrame(self._rows, DATOMS)
        return Connection(self.store.spark, log=self._base.unionByName(tail)).db()

"""Near duplicates by exact shingle similarity, for the pipeline: SimHash and min-hash candidates, all verified.

Texts of one set of shingles are one node. Candidates are nodes of equal or linked SimHash fingerprints, and nodes
that agree on one of BANDS bands of ROWS minimum hashes each: a pair of similarity s is met with probability
1 - (1 - s ** ROWS) ** BANDS, 0.9994 at 0.8. Links are spanning pairs whose Jaccard similarity over their whole shingle
sets is `least` or more; no other pair is ever linked. Buckets of the same members are one. The members of a bucket are
first compared with its leader, the smallest of them: those that link to it are in one component, so they needn't meet,
and a bucket of very many near copies costs one comparison a member. The members that don't link to it are then compared
with all others, in blocks of BLOCK by BLOCK; so two members of a bucket are joined if any chain of links in it joins them.
Only texts that have a candidate are read again, once.

Defined cases: null and empty texts have the empty set, and are equal; rows without an id are left out; rows of
one id are one document; shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, give_back, written
from .components import Forest, components
from .simhash import links, majority, shingle_hashes

BANDS, ROWS = 14, 4
BLOCK = 1024
_RNG = np.random.default_rng(31)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def name_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band of a set of hashes; none of the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[k : k + 2048, None] * _A + _B).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(queries: list[np.ndarray], others: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Spanning pairs (query, other) of at least that Jaccard similarity."""
    sets = queries + others
    n, first, size = len(sets), len(queries), np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    # which of the others hold each shingle
    theirs = word[at[first] :]
    order = np.argsort(theirs, kind="stable")
    held, cuts = np.repeat(np.arange(n - first), size[first:])[order], np.searchsorted(theirs[order], np.arange(word.max(initial=-1) + 2))
    tree, out = Forest(n), []
    for i in range(first):
        common = np.zeros(n - first, np.int64)
        for w in word[at[i] : at[i + 1]].tolist():
            common[held[cuts[w] : cuts[w + 1]]] += 1  # a set holds a shingle once
        near = common >= least * (size[i] + size[first:] - common) - 1e-9
        out += [(i, j - first) for j in tree.joined(i, first + np.flatnonzero(near)).tolist()]
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8, radius: int = 7, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of the ids that verified links join to a smaller id."""
    base = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).where("id is not null")

    def describe(batches):
        gc.disable()
        for b in batches:
            names, fps, keys = [], [], []
            for t in each(b.column(1)):
                h = shingle_hashes(t, shingle)
                s = np.unique(h)
                names.append(name_of(s))
                fps.append(majority(h))
                keys.append(band_keys(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["id", "name", "fp", "keys"])
        give_back()

    rows = written(base.mapInArrow(describe, "id bigint, name bigint, fp bigint, keys array<bigint>"), "verified-rows")
    nodes = rows.groupBy("name").agg(F.min("id").alias("node"), F.min_by("fp", "id").alias("fp"), F.min_by("keys", "id").alias("keys"))
    nodes = written(nodes, "verified-nodes")
    heads = nodes.groupBy("fp").agg(F.min_by("name", "node").alias("name"))
    linked = links(heads.select("fp"), radius).distinct()
    pairs = linked.select(F.xxhash64(F.lit("link"), "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp")).join(heads, "fp").select("name", "key")
    banded = nodes.select("name", F.explode(F.concat("keys", F.array(F.xxhash64(F.lit("fp"), "fp")))).alias("key"))
    dealt = written(banded.unionByName(pairs).distinct(), "verified-dealt")
    # one bucket of each set of members
    buckets = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("leader"), F.sum((F.xxhash64("name") / 4).cast("bigint") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64("name")).alias("x")).where("n > 1")
    buckets = buckets.groupBy("n", "leader", "s", "x").agg(F.min("key").alias("key")).select("key", "n", "leader")
    met = written(dealt.join(buckets, "key"), "verified-met")

    def sets(batches):
        gc.disable()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                found = [np.unique(shingle_hashes(t, shingle)) for t in each(b.column(1).slice(k, 256))]
                yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["name", "shingles"])
        give_back()

    # the text of the node's own id is enough: the others have the same set
    wanted = nodes.join(met.select("name").distinct(), "name", "left_semi").select(F.col("node").alias("id")).distinct()
    texts = written(base.join(wanted, "id", "left_semi").mapInArrow(sets, "name bigint, shingles binary").dropDuplicates(["name"]), "verified-sets")

    def compare(batches):
        gc.disable()
        last, held = None, ([], [])

        def links_of():
            queries, others = ([np.frombuffer(raw, np.uint64) for _, raw in h] for h in held)
            pairs = similar(queries, others, least) if queries and others else []
            return pa.RecordBatch.from_arrays([pa.array([held[0][i][0] for i, _ in pairs], pa.int64()), pa.array([held[1][j][0] for _, j in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            for unit, side, name, raw in zip(*(each(c) for c in b.columns)):
                if unit != last and last is not None:
                    yield links_of()
                    held = [], []
                last = unit
                held[side].append((name, raw))
        if last is not None:
            yield links_of()
        give_back()

    def compared(work: DataFrame, name: str) -> DataFrame:
        """Links (a, b) of the units of work (name, unit, side): side 0 against side 1."""
        ready = work.join(texts, "name").select("unit", "side", "name", "shingles").repartition("unit").sortWithinPartitions("unit")
        return written(ready.mapInArrow(compare, "a bigint, b bigint"), name)

    def piece(n):
        return F.ceil(n / BLOCK).cast("int")

    # members against the leader of their bucket; a pair of texts once, whatever number of buckets it shares
    stars = met.where("name <> leader").groupBy("leader", "name").agg(F.lit(1).alias("one"))
    sizes = stars.groupBy("leader").agg(piece(F.count("*")).alias("p"))
    member = stars.join(sizes, "leader").select("name", F.xxhash64("leader", F.pmod(F.xxhash64("name"), F.col("p")).cast("int")).alias("unit"), F.lit(1).alias("side"))
    leader = sizes.select(F.col("leader").alias("name"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i")).select("name", F.xxhash64("name", "i").alias("unit"), F.lit(0).alias("side"))
    first = compared(member.unionByName(leader), "verified-stars")
    # those that don't link to it, against all others of their bucket
    apart = met.where("n > 2 and name <> leader").join(first.select(F.col("a").alias("leader"), F.col("b").alias("name")), ["leader", "name"], "left_anti").select("key", "name", "n")
    left = apart.groupBy("key").agg(piece(F.count("*")).alias("q"), piece(F.max("n")).alias("p"))
    own = lambda c: F.pmod(F.xxhash64("name"), F.col(c)).cast("int")
    query = apart.join(left, "key").select("name", "key", own("q").alias("i"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("j"), F.lit(0).alias("side"))
    other = met.where("n > 2 and name <> leader").join(left, "key").select("name", "key", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"), own("p").alias("j"), F.lit(1).alias("side"))
    second = compared(query.unionByName(other).select("name", F.xxhash64("key", "i", "j").alias("unit"), "side"), "verified-others")
    found = first.unionByName(second).where("a <> b")
    na, nb = nodes.select(F.col("name").alias("a"), F.col("node").alias("na")), nodes.select(F.col("name").alias("b"), F.col("node").alias("nb"))
    edges = found.distinct().join(na, "a").join(nb, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    copies = rows.join(nodes.select("name", "node"), "name").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return components(edges.unionByName(copies)).select(F.col("id").alias(id_col), F.col("component").alias("component_id"))

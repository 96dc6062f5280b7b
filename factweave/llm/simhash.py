"""SimHash near-duplicates (operator 5): fingerprints, links by bit-sliced comparison, components.

Fingerprints of at most `radius` differing bits link. Of radius + 2 blocks of the 64 bits, two such fingerprints
agree on two or more; so each distinct fingerprint is dealt to one bucket for every choice of two blocks (15 of them
at radius 4, whatever the size of the input). Buckets are compared in blocks: the 64 bit planes of a block are
stored vertically, one 64-bit word for
64 members; the distances of many queries to 64 members at once are counted by carry-save adders over the
planes, and a query is dropped once it is beyond the radius of all members. A bucket of more than `BLOCK`
fingerprints is cut into pieces, and every pair of pieces is one unit of work. Units emit a spanning forest of
their links, never all pairs; components are found by alternating star contractions.

Defined cases: null and empty texts have fingerprint 0 and link like any other; equal texts, rows with equal
ids and any number of copies are one fingerprint when compared; null ids are allowed but never name a
component unless all its ids are null; other columns are kept by `add_fingerprint`.
"""

from __future__ import annotations

import gc
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, written
from .components import Forest, components

SHINGLE = 4
BLOCK = 2048
#: Queries that are compared with all members of a unit at once.
QUERIES = 256
_ONE = np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a text, in order; a shorter text is one shingle, and none has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    out = np.empty(n, np.uint64)
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        out[i:j] = [digest(joined[a:b], 42) for a, b in zip(start[i:j].tolist(), end[i + k - 1 : j + k - 1].tolist())]
    return out


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit majority fingerprint of the word shingles of a text; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle))


def add_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""

    def run(batches):
        gc.disable()
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
        give_back()

    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id bigint, fp bigint")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: plane[bit, word] has bit j of the word set if member 64 * word + j has the bit."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, members: np.ndarray, radius: int, later: bool, first: int = 0, planes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) at most radius bits apart; later: the queries are members from place `first` on, and
    only members behind the query count. Distances saturate at 8, held as three bit-planes of counters."""
    if radius > 7:
        raise ValueError("the counters hold distances up to 7")
    planes = planes_of(members) if planes is None else planes
    words = planes.shape[1]
    valid = np.packbits(np.arange(words * 64) < len(members), bitorder="little").view("<u8")
    rows = np.arange(len(queries))
    live = np.broadcast_to(valid, (len(rows), words)).copy()
    if later:
        behind = np.arange(words * 64)[None, :] > first + rows[:, None]
        live &= np.packbits(behind, axis=1, bitorder="little").view("<u8").reshape(len(rows), words)
    c0, c1, c2 = (np.zeros((len(rows), words), np.uint64) for _ in range(3))
    full = ~np.uint64(0)
    q = queries.astype(np.uint64)
    for bit in range(64):
        flip = np.where((q >> np.uint64(bit)) & _ONE, full, np.uint64(0))[:, None]
        carry = planes[bit][None, :] ^ flip  # members that differ from the query in this bit
        c0, carry = c0 ^ carry, c0 & carry
        c1, carry = c1 ^ carry, c1 & carry
        c2, carry = c2 ^ carry, c2 & carry
        live &= ~carry  # beyond 7
        if bit % 4 == 3 and bit >= radius:
            live &= ~beyond(c0, c1, c2, radius)
            keep = live.any(axis=1)
            if not keep.all():
                rows, q, live, c0, c1, c2 = rows[keep], q[keep], live[keep], c0[keep], c1[keep], c2[keep]
                if not len(rows):
                    break
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.unpackbits(live.view(np.uint8).reshape(len(rows), words * 8), axis=1, bitorder="little")
    a, b = np.nonzero(hit)
    return rows[a] + first * later, b


def beyond(c0, c1, c2, radius: int):
    """Where the three-bit counters exceed radius."""
    out, equal = np.zeros_like(c0), np.full_like(c0, ~np.uint64(0))
    for bit, plane in ((2, c2), (1, c1), (0, c0)):
        if radius >> bit & 1:
            equal = equal & plane
        else:
            out |= equal & plane
            equal = equal & ~plane
    return out


def block_links(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one unit. side: 0 and 1 for two pieces of one bucket (only pairs across), else all 2. QUERIES
    queries meet all members at once, so a unit of near copies doesn't hold all its pairs."""
    whole = bool((side == 2).all())
    queries, members = (fps, fps) if whole else (fps[side == 0], fps[side == 1])
    off = 0 if whole else len(queries)
    tree, planes = Forest(off + len(members)), planes_of(members)
    left, right = [], []
    for k in range(0, len(queries), QUERIES):
        a, b = within(queries[k : k + QUERIES], members, radius, whole, k, planes)
        a += 0 if whole else k
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        for i, own in zip(a[cuts].tolist(), np.split(b, cuts[1:])):
            met = tree.joined(i, own + off) - off
            left.append(np.full(len(met), i))
            right.append(met)
    none = [np.zeros(0, np.int64)]
    return queries[np.concatenate(left or none)], members[np.concatenate(right or none)]


def layout(radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Edges of the radius + 2 blocks, and the choices of two blocks to agree on. The same for every input: two
    fingerprints at most `radius` bits apart differ in that many blocks or fewer, so they agree on some choice."""
    m = radius + 2
    return [round(64 * i / m) for i in range(m + 1)], list(itertools.combinations(range(m), 2))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of column fp that differ in radius bits or fewer."""
    edges, choices = layout(radius)

    def mask(choice) -> int:
        m = 0
        for i in choice:
            m |= ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        return m - (1 << 64) if m >> 63 else m

    key = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask(c))).alias("v")) for t, c in enumerate(choices)])
    dealt = fps.select("fp", F.explode(key).alias("k")).select("fp", F.xxhash64("k.t", "k.v").alias("k"))
    sizes = dealt.groupBy("k").count().where(F.col("count") > BLOCK)  # buckets to cut; few and thin
    pieces = F.ceil(F.col("count") / BLOCK).cast("int")
    big = sizes.select("k", pieces.alias("p"))
    cut = dealt.join(big, "k", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).cast("tinyint").alias("s")))
    # piece x meets itself (2), every later piece as the first (0) and every earlier one as the second (1)
    many = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda y: F.struct(F.least(own, y).alias("i"), F.greatest(own, y).alias("j"), F.when(own == y, F.lit(2)).when(own < y, F.lit(0)).otherwise(F.lit(1)).cast("tinyint").alias("s")))
    units = cut.select("fp", "k", F.explode(F.when(F.col("p").isNull(), one).otherwise(many)).alias("u")).select(F.xxhash64("k", "u.i", "u.j").alias("unit"), "fp", F.col("u.s").alias("side"))

    def compare(batches):
        gc.disable()
        held: list[tuple] = []
        size = 0

        def run(group):
            unit, fp, side = (np.concatenate(x) for x in zip(*group))
            whole = side == 2
            jobs = []
            if whole.any():
                jobs.append(np.flatnonzero(whole))
            for u in np.unique(unit[~whole]):
                jobs.append(np.flatnonzero((unit == u) & ~whole))
            for own in jobs:
                s = side[own]
                f = fp[own].view(np.uint64)
                if (s == 2).all():
                    f = np.unique(f)
                    s = np.full(len(f), 2, np.int8)
                a, b = block_links(f, s, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rest = None
        for batch in batches:
            unit, fp, side = (np.asarray(batch.column(k)) for k in range(3))
            if rest is not None:
                unit, fp, side = (np.concatenate([x, y]) for x, y in zip(rest, (unit, fp, side)))
            cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
            start = 0
            for c in cuts.tolist():
                if c - start + size >= BLOCK // 2 or size == 0 and c - start >= BLOCK // 2:
                    held.append((unit[start:c], fp[start:c], side[start:c]))
                    yield from run(held)
                    held, size, start = [], 0, c
            last = int(cuts[-1]) if len(cuts) else 0
            if last > start:
                held.append((unit[start:last], fp[start:last], side[start:last]))
                size += last - start
            rest = unit[last:], fp[last:], side[last:]
        if rest is not None:
            held.append(rest)
        if held:
            yield from run(held)

    thin = units.repartition("unit").sortWithinPartitions("unit")
    return thin.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id that links reach."""
    fps = written(add_fingerprint(docs, id_col, text_col, shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    found = links(nodes.select("fp"), radius)
    name_a, name_b = nodes.select(F.col("fp").alias("a"), F.col("node").alias("na")), nodes.select(F.col("fp").alias("b"), F.col("node").alias("nb"))
    edges = found.join(name_a, "a").join(name_b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).dropna()
    comp = components(written(edges, "simhash-links"))
    label = nodes.join(comp, nodes["node"] == comp["id"], "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(label, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(col):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


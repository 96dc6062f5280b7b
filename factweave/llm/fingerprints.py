"""Document fingerprints by randomised edit embedding (operator 10).

A text is embedded by one walk over its characters: at step j the character c under the pointer puts out a bit,
BITS[j][c], and another, WALK[j][c], says whether the pointer moves on. Both are random and shared by all texts
(they repeat after PERIOD steps). Two walks are in step until the first edit, and after it soon meet again by
chance, so few edits give a small Hamming distance of what the walks put out, and unrelated texts differ in half.

The walk is as long as the text asks for, two steps a character on average, and never cut short. A fingerprint
samples its bits: the first LEVEL steps all, and LEVEL more from each following stretch that is twice as long as the
one before, one at random from each LEVEL-th of it (the same places for all texts). So a text of n characters has
about LEVEL * log2(2 n / LEVEL) bits, and each stretch of the walk is sampled evenly. The distance of two
fingerprints weighs each sampled bit by the steps that it stands for: it estimates the Hamming distance of the whole
walks, where a walk that has ended differs from one that goes on in half the steps. `likeness` is 1 for equal walks
and 0 for walks that differ in half their steps or more.

Candidates are found by bit-sampled banding: BANDS bands of SAMPLED bits each, from each of the three longest
stretches that a walk covers whole (texts that don't fill the first take runs of few bits). Two fingerprints without
a band in common have likeness 0; all others are verified on their whole fingerprints. `near_pairs` deals
fingerprints to buckets by band, and compares all members of a bucket.

Defined cases: a null text is the empty text; the empty text has the fingerprint of no bits, which is like itself
(1) and unlike all others (0); equal texts have equal fingerprints wherever they are; memory is in proportion to
the longest text, one byte a character; null ids come first; equal ids are ordered by text; rows that repeat are
each a row, next to one another.
"""

from __future__ import annotations

import gc
import hashlib
from bisect import bisect_left
from itertools import chain, cycle, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, give_back
from .components import Forest
from .tokenfile import bucket_of, range_bounds

LEVEL = 128
PERIOD = 4096
BANDS, SAMPLED = 16, 20
#: Bits of a band of a text that doesn't fill the first level: in a comparison, and in a search.
TINY, TINY_SEARCH = 8, 16
#: Members of a bucket compared at once; larger buckets are cut into pieces, and every two pieces meet.
BLOCK = 1024
#: Characters that are classed at once.
SLICE = 1 << 20
_END = 255  # the class behind the last character: the pointer stays

_RNG = np.random.default_rng(20)
#: Per step, by class of character: does the pointer move on, and the bit put out.
_WALK = _RNG.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
_WALK[:, _END] = 0
_ROWS = [r.tobytes() for r in _WALK]
_BITS = [r.tobytes() for r in _RNG.integers(0, 2, (PERIOD, 256), dtype=np.uint8)]
#: Bands as masks over the bits of a level.
_MASKS = [sum(1 << int(i) for i in _RNG.choice(LEVEL, SAMPLED, replace=False)) for _ in range(BANDS)]
_WITHIN = _RNG.random((64, LEVEL))  # where in its part of level l sample t lies


def places(level: int) -> list[int]:
    """The steps that a level samples, ascending."""
    if not level:
        return list(range(LEVEL))
    part = 1 << level - 1
    return [LEVEL * part + t * part + int(_WITHIN[level][t] * part) for t in range(LEVEL)]


_PLACES: list[list[int]] = []


def _level(k: int) -> list[int]:
    while len(_PLACES) <= k:
        _PLACES.append(places(len(_PLACES)))
    return _PLACES[k]


def classes(text: str) -> bytes:
    """One class a character, and the end behind them."""
    out = []
    for k in range(0, len(text), SLICE):
        points = np.frombuffer(text[k : k + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(np.minimum((points * np.uint32(0x9E3779B1)) >> np.uint32(24), _END - 1).astype(np.uint8).tobytes())
    return b"".join([*out, bytes([_END])])


def walk(chars: bytes, first: int = 0, at: int = 0) -> tuple[list[int], list[int]]:
    """The sampled bits of a walk that stands at place `at` when sample `first` is due, until it reaches the end; and the
    pointer at each of them."""
    n, bits, pointers = len(chars) - 1, [], []
    level, k = divmod(first, LEVEL)
    due = _level(level)
    step = due[k]
    rows = chain(_ROWS[step % PERIOD :], cycle(_ROWS))
    while at < n:
        bits.append(_BITS[step % PERIOD][chars[at]])
        pointers.append(at)
        k += 1
        if k == LEVEL:
            level, k = level + 1, 0
            due = _level(level)
        after = due[k]
        for row in islice(rows, after - step):
            at += row[chars[at]]
        step = after
    return bits, pointers


Fingerprint = tuple[int, int]  # number of bits, and the bits, the first lowest


def packed(bits: list[int]) -> Fingerprint:
    return len(bits), int("".join(map(str, reversed(bits))), 2) if bits else 0


def fingerprint(text: str | None) -> Fingerprint:
    return packed(walk(classes(text or ""))[0])


def as_hex(fp: Fingerprint) -> str:
    """Four digits of the number of bits, then the bits."""
    return f"{fp[0]:04x}" + (f"{fp[1]:0{-(-fp[0] // 4)}x}" if fp[0] else "")


def from_hex(raw: str) -> Fingerprint:
    return int(raw[:4], 16), int(raw[4:] or "0", 16)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1 - 2 * (estimated Hamming distance of the walks) / (steps of the longer one), at least 0; the steps that only one
    of them takes count half, as unrelated bits do."""
    if a == b:
        return 1.0
    differ = steps = 0
    both = a[1] ^ b[1]
    short, long = sorted((a[0], b[0]))
    for level in range(-(-long // LEVEL)):
        low = LEVEL * level
        here, known = min(LEVEL, long - low), max(0, min(LEVEL, short - low))
        weight = 1 << max(0, level - 1)
        steps += weight * here
        differ += weight * (2 * (both >> low & (1 << known) - 1).bit_count() + here - known)
    return max(0.0, 1 - differ / steps)


def bands(fp: Fingerprint, tiny: int = TINY) -> list[tuple[int, int, int]]:
    """(level, band, bits): keys that candidates share."""
    n, bits = fp
    full = n // LEVEL
    out = [(-1, n, bits)]
    for level in range(max(0, full - 3), full):
        own = bits >> LEVEL * level & (1 << LEVEL) - 1
        out += [(level, k, own & m) for k, m in enumerate(_MASKS)]
    if not full:
        out += [(-2, k, bits >> k & (1 << tiny) - 1) for k in range(0, n - tiny + 1, tiny)]
    return out


def compared(a: Fingerprint, b: Fingerprint) -> float:
    """0 without a band in common, else the verified likeness."""
    return likeness(a, b) if a == b or not set(bands(a)).isdisjoint(bands(b)) else 0.0


def edited(text: str, after: str) -> str:
    """The last half of a text's code points replaced by as many of the next text's first (or all of them)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_edited(text: str, after: str) -> tuple[Fingerprint, str, Fingerprint]:
    """The fingerprint of a text, its edited text, and that text's fingerprint; the walks share their first half."""
    bits, pointers = walk(classes(text))
    new, kept = edited(text, after), len(text) - len(text) // 2
    if new == text:
        return packed(bits), new, packed(bits)
    fork = bisect_left(pointers, kept) - 1  # the last sample that was due before the edit
    return packed(bits), new, packed(bits[:fork] + walk(classes(new), fork, pointers[fork])[0])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2048) -> DataFrame:
    """Fingerprint every text, its edited text, and the next text in ascending id order.

    Ranges of ids are dealt to tasks and sorted there; each range also gets a copy of the following range's first
    row, so the next text is always at hand and no text moves twice."""
    base = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    bounds = np.array(range_bounds(base, "doc_id", rows_per_bucket), np.int64)

    def place(batches):
        for b in batches:
            own = bucket_of(b.column(0), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], ["bucket", "doc_id", "text"])

    placed = base.mapInArrow(place, "bucket int, doc_id bigint, text string")
    # the first row of each range: thin ids first, then the texts of these ids only
    ids = base.select("doc_id", F.lit("").alias("text")).mapInArrow(place, "bucket int, doc_id bigint, text string")
    firsts = sorted(((r["bucket"], r["doc_id"]) for r in ids.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m")).select("bucket", "m.doc_id").collect()), key=lambda x: x[0])  # a row a range
    if not firsts:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    before = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}  # the range that a range follows; the first follows the last
    named = docs.sparkSession.createDataFrame([(d, before[b]) for b, d in firsts], "first bigint, to int")
    copies = base.join(F.broadcast(named), base["doc_id"].eqNullSafe(named["first"])).groupBy("to").agg(F.min(F.struct("doc_id", "text")).alias("m")).select(F.col("to").alias("bucket"), F.lit(1).alias("copy"), "m.doc_id", "m.text")
    # a table of one range: its last row is followed by its first
    rows = placed.select("bucket", F.lit(0).alias("copy"), "doc_id", "text").unionByName(copies)

    def run(batches):
        gc.disable()
        last = None  # (copy, id, text) of the row before, and its likeness is open
        out: list[tuple] = []
        waiting = None  # the row before, done but for its near_next: (cells, its fingerprint)
        for b in batches:
            for copy, doc, text in zip(*(each(c) for c in b.columns[1:])):
                if last is not None and not last[0]:
                    own, new, changed = with_edited(last[2], text)
                    if waiting:
                        out.append((*waiting[0], compared(waiting[1], own)))
                    waiting = (last[1], len(last[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(own), as_hex(changed), compared(own, changed)), own
                    if copy:  # the last row of its range
                        out.append((*waiting[0], compared(own, fingerprint(text))))
                        waiting = None
                last = copy, doc, text
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], _SCHEMA.names)
                out = []
        give_back()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "copy", "doc_id", "text").mapInArrow(run, _SCHEMA)


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
_ARROW = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def add_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a hexadecimal fingerprint column (a column of that name is replaced). Map-only."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([as_hex(fingerprint(t)) for t in each(b.column(at))], pa.string())], [*b.schema.names, name])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def spanning(fps: list[Fingerprint], side: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """A spanning forest (i, j, likeness) of the pairs of at least that likeness. side: 0 and 1 for two pieces of a
    bucket (only pairs across), else 2."""
    tree, out = Forest(len(fps)), []
    for i in range(len(fps) - 1):
        others = np.arange(i + 1, len(fps))
        others = others[((side[others] == 2) | (side[others] != side[i])) & (tree.tree[others] != tree.tree[i])]
        like = {j: s for j in others.tolist() if (s := likeness(fps[i], fps[j])) >= least}
        out += [(i, j, like[j]) for j in tree.joined(i, np.array(list(like), np.int64)).tolist()]
    return out


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id_a, id_b, likeness): spanning links of the documents that share a band and whose likeness is `least` or more:
    two such documents are joined by a chain of links. All different fingerprints of a band are compared, in blocks;
    equal ones are one member, linked once each to its first id."""
    every = add_fingerprint(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("id is not null")).select("id", "fingerprint")
    fps = every.groupBy("fingerprint").agg(F.min("id").alias("id"))
    first = fps.select("fingerprint", F.col("id").alias("id_a"))
    equal = every.distinct().join(first, "fingerprint").where(F.col("id") > F.col("id_a")).select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("likeness"))

    def deal(batches):
        for b in batches:
            keys = [[f"{level} {k} {v:x}" for level, k, v in bands(from_hex(f), TINY_SEARCH)[1:]] for f in each(b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.string()))], ["id", "fingerprint", "keys"])

    kind = every.schema["id"].dataType
    dealt = fps.select("id", "fingerprint").mapInArrow(deal, T.StructType([T.StructField("id", kind), T.StructField("fingerprint", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))]))
    dealt = dealt.select("id", "fingerprint", F.explode("keys").alias("key")).select("id", "fingerprint", F.xxhash64("key").alias("key"))
    pieces = dealt.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("p"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("p")).cast("int")
    # piece x meets itself (2), every later piece as the first (0) and every earlier one as the second (1)
    meets = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda y: F.struct(F.least(own, y).alias("i"), F.greatest(own, y).alias("j"), F.when(own == y, 2).when(own < y, 0).otherwise(1).alias("s")))
    units = dealt.join(pieces, "key").select("id", "fingerprint", "key", F.explode(meets).alias("u")).select("id", "fingerprint", F.xxhash64("key", "u.i", "u.j").alias("unit"), F.col("u.s").cast("int").alias("side"))
    schema = T.StructType([T.StructField("id_a", kind), T.StructField("id_b", kind), T.StructField("likeness", T.DoubleType())])

    def compare(batches):
        last, held = None, []

        def run(id_type):
            found = spanning([from_hex(r[1]) for r in held], np.array([r[2] for r in held]), least) if len(held) > 1 else []
            ends = [(*sorted((held[i][0], held[j][0])), s) for i, j, s in found]
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], id_type), pa.array([e[1] for e in ends], id_type), pa.array([e[2] for e in ends], pa.float64())], schema.names)

        for b in batches:
            for i, fp, unit, side in zip(*(each(c) for c in b.columns)):
                if unit != last and held:
                    yield run(b.column(0).type)
                    held = []
                last = unit
                held.append((i, fp, side))
        if held:
            yield run(b.column(0).type)

    near = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, schema).distinct()
    return near.where("id_a <> id_b").unionByName(equal)

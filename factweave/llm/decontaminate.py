"""Benchmark decontamination by spaced-seed hashing (operator 6), in DataFrame functions only.

Words of documents and benchmark items are hashed. A seed is a fixed mask over consecutive words: the hash of
the words at its care positions, so words at the other positions may differ. Seeds of the items and of the
documents are joined; around each hit the document and the item are aligned and compared word by word, and a
window of `WINDOW` words of which `NEED` or more are equal is an overlap. The masks are lossless: every window
of 15 words with up to 3 differing words holds a hit of one of them, so no overlap is missed. An item of fewer
words is matched as a whole, and needs 80 % of its words: with s words that may differ it is cut into s + 1 runs, of
which one must be whole, so the runs are its seeds and nothing is missed there either.

All masks care for their first two words (but that of one word), so a document's positions are first filtered by the
items' word pairs, inside the document's own array: no row is made for a position, and texts are never shuffled. The
items' pair and seed hashes are literals of the plan while there are at most INLINE of them; beyond it the
seeds of all positions are joined as a table. Both ways give the same rows. Seeds travel as (seed, item, position)
and an item's words once an item; Spark broadcasts either only by its size.

Defined cases: null texts and texts without words have no overlap; repeated items and documents are reported
each, those without an id too; an empty benchmark leaves every document clean; other columns of documents are
ignored by `overlaps` and kept by `decontaminate`; texts of any length are one array of hashes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Care positions of the seeds; a lossless family for 15 words with 3 substitutions (checked by test).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
WINDOW, NEED = 15, 12
#: Benchmark hashes that are put into the plan as literals; a table join beyond.
INLINE = 200_000


def word_hash_array(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters, marks and digits) of a text; null gives an empty array."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _once(value: Column) -> Column:
    """The value by way of a generator, which the optimizer doesn't copy into the functions that use it."""
    return F.explode(F.array(value))


def _at(words: Column, i: Column) -> Column:
    return F.get(words, i)


def runs_of(n: int) -> list[tuple[int, int]]:
    """(start, words) of the runs that an item of n words is cut into, n below WINDOW: one more than words may differ."""
    parts = n - needed(n) + 1
    edges = [round(k * n / parts) for k in range(parts + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def needed(width: int) -> int:
    """Equal words that a window needs."""
    return NEED if width == WINDOW else math.ceil(width * 4 / 5)


def _seed(words: Column, i: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(",".join(map(str, mask))), *[_at(words, i + p) for p in mask])


def _pair(words: Column, i: Column, mask: tuple[int, ...]) -> Column:
    """What a position must show to be looked at: its first two words (of a mask of one word, that)."""
    return F.xxhash64(_at(words, i), _at(words, i + 1)) if len(mask) > 1 else F.xxhash64(_at(words, i))


def _cells(words: Column, mask: tuple[int, ...]):
    return lambda i: F.struct(_seed(words, i, mask).alias("seed"), _pair(words, i, mask).alias("pair"), i.alias("at"), (i < F.size(words) - mask[-1]).alias("fits"))


def _placed(words: Column, at: Column, masks) -> Column:
    """Seeds of the masks at positions `at`, those that fit."""
    return F.filter(F.flatten(F.array(*[F.transform(at, _cells(words, m)) for m in masks])), lambda h: h["fits"])


def seeds_of(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(seed, pair, item, at) of all items, and the masks that they use."""
    base = items.select(items[id_col].alias("item"), _once(word_hash_array(items[text_col])).alias("words"))
    words = F.col("words")
    sizes = [r[0] for r in base.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()]  # WINDOW + 1 rows at most
    parts, masks = [], []
    if WINDOW in sizes:
        masks += MASKS
        parts.append(base.where(F.size("words") >= WINDOW).select("item", F.explode(_placed(words, F.sequence(F.lit(0), F.size("words") - 1), MASKS)).alias("p")))
    for n in sorted(set(sizes) - {0, WINDOW}):
        own = [(at, tuple(range(size))) for at, size in runs_of(n)]
        masks += [m for _, m in own if m not in masks]
        cells = F.array(*[_cells(words, m)(F.lit(at)) for at, m in own])
        parts.append(base.where(F.size("words") == n).select("item", F.explode(cells).alias("p")))
    none = base.select("item", F.lit(0).cast("bigint").alias("seed"), F.lit(0).cast("bigint").alias("pair"), F.lit(0).alias("at")).where(F.lit(False))
    return reduce(DataFrame.unionByName, [p.select("item", "p.seed", "p.pair", "p.at") for p in parts], none).distinct(), masks


def _aligned(doc: Column, item: Column, shift: Column) -> Column:
    """Equality of the item's words with the document's, at document position = item position + shift."""
    return F.transform(item, lambda w, j: F.coalesce(F.when(j + shift >= 0, _at(doc, j + shift) == w), F.lit(False)))


def _matches(equal: Column) -> Column:
    """Most equal words in any window of WINDOW words (or the whole, if shorter)."""
    width = F.least(F.lit(WINDOW), F.size(equal))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(equal) - width), lambda s: F.aggregate(F.slice(equal, s + 1, width), F.lit(0), lambda a, x: a + x.cast("int"))))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", inline: int = INLINE) -> DataFrame:
    """(doc, item, doc_at, matched): verified overlaps, one row per document, item and alignment; doc_at is the
    document word aligned with the item's first word, matched the equal words of its best window."""
    found, masks = seeds_of(items, item_col, item_text_col)
    seeds = written(found, "seeds")
    base = docs.select(docs[id_col].alias("doc"), _once(word_hash_array(docs[text_col])).alias("words"))
    count = seeds.count()
    if not count:
        return base.select("doc", F.lit(None).cast(items.schema[item_col].dataType).alias("item"), F.lit(0).alias("doc_at"), F.lit(0).alias("matched")).where(F.lit(False))
    words = F.col("words")
    thin = seeds.select("seed", "item", F.col("at").alias("item_at"))
    texts = items.select(items[item_col].alias("__item"), word_hash_array(items[item_text_col]).alias("item_words"))
    if count <= inline:
        known = seeds.select("seed", "pair").collect()  # at most `inline` rows of two numbers
        pairs, keys = sorted({r.pair for r in known}), sorted({r.seed for r in known})
        looks = [m for m in {len(m) > 1: m for m in masks}.values()]
        start = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: reduce(lambda x, y: x | y, [_pair(words, i, m).isin(pairs) for m in looks]))
        hits = F.filter(_placed(words, F.col("start"), masks), lambda h: h["seed"].isin(keys))
        rows = base.select("doc", "words", _once(start).alias("start")).select("doc", "words", F.explode(hits).alias("h")).select("doc", "words", F.col("h.seed").alias("seed"), F.col("h.at").alias("at"))
        joined = rows.join(thin, "seed").select("doc", "words", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    else:
        # a row's key is a hash of all it holds: rows that share one are candidates of each other's, and verified
        keyed = base.select("doc", "words", F.xxhash64("doc", "words").alias("key"))
        placed = _placed(words, F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), masks)
        every = keyed.select("key", F.explode(placed).alias("h")).select("key", F.col("h.seed").alias("seed"), F.col("h.at").alias("at"))
        lined = every.join(thin, "seed").select("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        joined = lined.join(keyed, "key").select("doc", "words", "item", "shift")
    joined = joined.join(texts, joined["item"].eqNullSafe(texts["__item"]))
    lined = joined.select("doc", F.xxhash64("doc", "words").alias("key"), "item", "shift", _once(_aligned(words, F.col("item_words"), F.col("shift"))).alias("equal"))
    # hits of one alignment are one; texts of one item id are told apart by what is equal
    scored = lined.groupBy("doc", "key", "item", "shift", "equal").count().select("doc", "item", F.col("shift").alias("doc_at"), _matches(F.col("equal")).alias("matched"), F.least(F.lit(WINDOW), F.size("equal")).alias("width"))
    need = F.when(F.col("width") == WINDOW, F.lit(NEED)).otherwise(F.ceil(F.col("width") * 4 / 5).cast("int"))
    return scored.where(F.col("matched") >= need).drop("width").distinct()


def contaminated(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(doc, n_items, item, matched): one row per document with an overlap; item is the smallest of its items."""
    return overlaps(docs, items, **names).groupBy("doc").agg(F.count_distinct("item").cast("bigint").alias("n_items"), F.min("item").alias("item"), F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of docs whose id has no overlap with an item, all columns as they are; rows without an id stay."""
    bad = contaminated(docs, items, id_col=id_col, **names).select(F.col("doc").alias("__bad"))
    return docs.join(bad, docs[id_col] == bad["__bad"], "left_anti")

"""Exact substring deduplication with a suffix array by bucket-pointer refinement (operator 3).

A byte is removed if a LENGTH-byte string that covers it also starts earlier (smaller document id, or the same
document at an earlier byte). A suffix array of the whole corpus would meet in one place, so the suffixes are
first dealt out so that equal ones meet: every LENGTH-byte string belongs to the smallest hash of its K-byte
grams (its anchor), which depends on its content alone. The consecutive strings of one anchor form a span, and

 1. spans travel as (anchor, span hash, document, position) only. Sorted within a partition, a span that equals
    an earlier one is removed whole; equal spans of one slice of a task were already joined before the shuffle;
 2. the first spans of anchors that have several different ones (the rims of repeated passages) fetch their
    bytes, and a suffix array of all strings that meet in a task is built by bucket-pointer refinement: buckets
    of Q-byte grams are refined by sorting on the bucket pointers of later offsets, and refined pointers are
    used for the next, twice as deep refinement, until buckets agree in LENGTH bytes. All but the first string
    of a bucket are repeats. Anchors with more than HOT different spans are dealt out again by the hash of each
    string, of which a task sends the first of its own only, so no group of any size must fit in memory;
 3. the repeats' ranges are joined to the documents by id.

Anchors that are met very often (`common_anchors`, found in every SEEN-th document) would bring their spans to one task.
Their spans are dealt out by anchor and span hash instead, so equal ones still meet, and are counted by anchor
afterwards, combined before the shuffle. Which anchors count as common changes no result.

Defined cases: null texts are empty; texts under LENGTH bytes keep all; overlapping repeats count; rows that are
equal in id and text are one document (none repeats the other); rows of equal id and different text are
ordered by a hash of the text; null ids come first; other columns stay in `deduplicate`.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, each, give_back, mix64, utf8_parts, written

LENGTH, K, Q = 100, 24, 8
HOT = 20_000
#: One document in SEEN is looked at for common anchors; they have OFTEN spans there or more, the COMMON commonest.
SEEN, OFTEN, COMMON = 64, 16, 20_000
#: Bytes of text whose spans are taken at once, and of strings in one suffix array: a worker holds some 15 words of 8
#: bytes for each.
SLICE = 1 << 18
BATCH = 1 << 20
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, for at least n places."""
    if n not in _POWERS:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[n]


def spans_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor key, span key, start, strings) of every span: the strings start at start .. start + strings - 1."""
    n = len(data)
    none = tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if n < LENGTH:
        return none
    up, down = _powers(max(2 * SLICE, 1 << (n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    gram = (total[K:] - total[:-K]) * down[: n - K + 1]
    gram = mix64(gram)
    bits = np.uint64(n.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    width, done = LENGTH - K + 1, 1
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    size = np.diff(offs)
    fits = np.maximum(size - LENGTH + 1, 0)
    rows = np.repeat(np.arange(len(size)), fits)
    if not len(rows):
        return none
    at = np.arange(len(rows)) - np.repeat(np.cumsum(fits) - fits, fits) + offs[:-1][rows]
    anchor = (low[at] & mask).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(rows, prepend=-1))
    strings = np.diff(np.append(first, len(at)))
    row, start, anchor = rows[first], at[first], anchor[first]
    end = start + strings - 1 + LENGTH
    shape = (anchor - start).astype(np.uint64) << np.uint64(8) | strings.astype(np.uint64)
    span = mix64((total[end] - total[start]) * down[start] ^ shape * np.uint64(_BASE))
    return row, gram[anchor], span & ~np.uint64(0xFF) | strings.astype(np.uint64), start - offs[:-1][row], strings


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join overlapping or touching ranges, sorted by (doc, start)."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = np.cumsum(group) * (int(end.max()) + 1)  # ends of earlier documents lie below
    reach = np.maximum.accumulate(end + shift) - shift
    new = group.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def repeated(flat: np.ndarray, start: np.ndarray, strings: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For contexts flat[start : start + strings + LENGTH - 1], whether each string, in order of contexts, repeats one
    of smaller (doc, place); place: of the context's first string in its document. Strings of equal (doc, place)
    are the same one."""
    n = len(flat)
    at = np.repeat(start, strings) + (within := np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings))
    # bucket pointers by the first Q bytes, of every place that a later step looks at
    gram = np.zeros(n, np.uint64)
    for k in range(Q):
        gram[: n - Q + 1] = gram[: n - Q + 1] << np.uint64(8) | flat[k : n - Q + 1 + k]
    order = np.argsort(gram, kind="stable")
    pointer, size = _pointers(order, gram[order], n)
    depth = Q
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        # buckets of one suffix are final; the others are sorted by the pointer `step` further on
        live = np.flatnonzero(size[pointer] > 1)
        live = live[live + step < n]
        key = pointer[live].astype(np.int64) << 32 | pointer[live + step]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        if not len(live):
            break
        new = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(new, len(key)))
        # a bucket keeps its last place in the array; its parts end one behind the other before it
        old = pointer[live[new]]
        total = np.cumsum(count)
        head = np.concatenate([[True], old[1:] != old[:-1]])
        base = np.maximum.accumulate(np.where(head, total - count, 0))
        first = old - size[old] + 1
        pointer_new = first + (total - base) - 1
        size_new = size.copy()
        size_new[pointer_new] = count
        pointer[live] = np.repeat(pointer_new, count)
        size = size_new
        depth += step
    own = pointer[at].astype(np.int64)
    doc_, place_ = np.repeat(doc, strings), np.repeat(place, strings) + within
    order = np.lexsort((place_, doc_, own))
    same = np.concatenate([[False], own[order][1:] == own[order][:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = order[head]
    out = np.zeros(len(at), bool)
    out[order] = same & ~((doc_[order] == doc_[lead]) & (place_[order] == place_[lead]))
    return out


def _pointers(order: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointer (last place of the bucket in the sorted order) of each suffix, and bucket sizes by pointer."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, n))
    last = new + count - 1
    pointer, size = np.empty(n, np.int64), np.zeros(n, np.int64)
    pointer[order] = np.repeat(last, count)
    size[last] = count
    return pointer, size


_SPAN = "akey bigint, skey bigint, doc bigint, tie bigint, pos bigint, n bigint"
_RANGE = "doc bigint, tie bigint, pos bigint, n bigint"


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64, copy=False) if c.dtype != np.uint64 else c.view(np.int64)) for c in cols], [x.split()[0] for x in names.split(", ")])


def _emit_spans(batches):
    """(akey, skey, doc, tie, pos, n) of spans; n = -length marks a range that is already known to repeat."""
    gc.disable()
    for b in batches:
        ids, ties = np.asarray(b.column(0)), np.asarray(b.column(1))
        data, offs = utf8_parts(b.column(2))
        for i, j in byte_slices(offs, SLICE):
            # a long text runs in pieces that overlap by LENGTH - 1 bytes: every string lies in one of them
            for lo in range(int(offs[i]), max(int(offs[j]) - LENGTH + 1, int(offs[i]) + 1), SLICE if j - i == 1 else 1 << 62):
                hi = min(int(offs[j]), lo + SLICE + LENGTH - 1) if j - i == 1 else int(offs[j])
                own = np.array([0, hi - lo]) if j - i == 1 else offs[i : j + 1] - offs[i]
                row, akey, skey, pos, n = spans_of(data[lo:hi], own)
                if not len(row):
                    continue
                row = row + i
                pos = pos + (lo - offs[i]) * (j - i == 1)
                doc, tie = ids[row], ties[row]
                order = np.lexsort((pos, tie, doc, skey, akey))
                a, s = akey[order], skey[order]
                same = np.concatenate([[False], (a[1:] == a[:-1]) & (s[1:] == s[:-1])])
                lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                again = same & (doc[order] == doc[lead]) & (tie[order] == tie[lead]) & (pos[order] == pos[lead])
                keep, drop = order[~same], order[same & ~again]
                yield _batch(_SPAN, akey[keep], skey[keep], doc[keep], tie[keep], pos[keep], n[keep])
                if len(drop):
                    key = row[drop]
                    key, start, end = _runs(key, pos[drop], pos[drop] + n[drop] - 1 + LENGTH)
                    yield _batch(_SPAN, mix64(ids[key].astype(np.uint64) + start.astype(np.uint64)), np.zeros(len(key), np.int64), ids[key], ties[key], start, start - end)
    _POWERS.clear()
    give_back()


def _compare_spans(batches, common: np.ndarray):
    """Of spans sorted by (akey, skey, doc, tie, pos): akey 0 and a range's length for a repeat; for the first of
    each of several different spans of an anchor (of any number, of a common anchor), the span itself."""
    gc.disable()
    last = None  # the row before: (akey, skey, doc, tie, pos, n, is a first span, was sent on)
    names = "akey bigint, doc bigint, tie bigint, pos bigint, n bigint"
    for b in batches:
        a, s, doc, tie, pos, n = (np.asarray(c) for c in b.columns)
        known = n < 0
        if known.any():
            yield _batch(names, np.zeros(int(known.sum()), np.int64), doc[known], tie[known], pos[known], -n[known])
            a, s, doc, tie, pos, n = (x[~known] for x in (a, s, doc, tie, pos, n))
        if not len(a):
            continue
        if last is not None:
            a, s, doc, tie, pos, n = (np.concatenate([[x], y]) for x, y in zip(last[0], (a, s, doc, tie, pos, n)))
        off = last is not None
        same_a = np.concatenate([[False], a[1:] == a[:-1]])
        same = same_a & np.concatenate([[False], s[1:] == s[:-1]])
        # repeats of the row before carry its lead on
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
        repeat = same & ~((doc == doc[lead]) & (tie == tie[lead]) & (pos == pos[lead]))
        repeat[:off] = False
        if repeat.any():
            yield _batch(names, np.zeros(int(repeat.sum()), np.int64), doc[repeat], tie[repeat], pos[repeat], n[repeat] - 1 + LENGTH)
        firsts = np.flatnonzero(~same)
        fa = a[firsts]
        prior = np.concatenate([[False], fa[1:] == fa[:-1]])
        after = np.concatenate([fa[1:] == fa[:-1], [False]])
        several = prior | after | np.isin(fa, common)
        if off:
            several[0] = after[0] and not last[1]  # the row before was sent on with an earlier batch, or not yet
            if last[1] and len(several) > 1 and fa[1] == fa[0]:
                several[1] = True
        go = firsts[several]
        if len(go):
            yield _batch(names, a[go], doc[go], tie[go], pos[go], n[go])
        k = firsts[-1]  # the lead of the last row stands for it
        sent = bool(several[-1]) or bool(off and len(firsts) == 1 and last[1])
        last = (a[k], s[k], doc[k], tie[k], pos[k], n[k]), sent


def _resolve(batches):
    """Repeats' ranges among contexts sorted by akey: one suffix array for each BATCH bytes of whole groups."""
    gc.disable()
    held: list[tuple] = []
    alone: list[tuple] = []
    size = 0

    def run(rows):
        raw = [r[5] for r in rows]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        strings = sizes - LENGTH + 1
        names = {k: i for i, k in enumerate(sorted({(r[1], r[2]) for r in rows}))}
        doc = np.array([names[r[1], r[2]] for r in rows])
        place = np.array([r[3] for r in rows])
        out = repeated(flat, np.cumsum(sizes) - sizes, strings, doc, place)
        if out.any():
            where = np.repeat(np.arange(len(rows)), strings)[out]
            p = (np.repeat(place, strings) + np.arange(len(out)) - np.repeat(np.cumsum(strings) - strings, strings))[out]
            d, start, end = _runs(doc[where], p, p + LENGTH)
            back = np.array(sorted(names, key=names.get), np.int64).reshape(-1, 2)
            yield _batch(_RANGE, back[d, 0], back[d, 1], start, end - start)
        first = np.zeros(len(rows), bool)
        first[np.repeat(np.arange(len(rows)), strings)[~out]] = True
        return [r for r, f in zip(rows, first) if f]

    for b in batches:
        for r in zip(*(each(c) for c in b.columns)):
            if r[4] < 0:  # a string that repeats another of its task's
                alone.append((r[1], r[2], r[3], -r[4]))
                continue
            if held and r[0] != held[-1][0] and size >= BATCH:
                yield from run(held)
                held, size = [], 0
            elif size >= 4 * BATCH and r[0] == held[0][0]:  # only strings dealt by hash: their firsts are few
                held = yield from run(held)
                size = sum(len(x[5]) for x in held)
            held.append(r)
            size += len(r[5])
        if alone:
            yield _batch(_RANGE, *np.array(alone, np.int64).T)
            alone = []
    if held:
        yield from run(held)
    held = []
    give_back()


def common_anchors(docs: DataFrame) -> list[int]:
    """Keys of the anchors with very many spans, COMMON at most."""
    some = docs.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(SEEN)) == 0).select("doc", "tie", "text").mapInArrow(_emit_spans, _SPAN).where("n > 0")
    often = some.groupBy("akey").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count")).limit(COMMON)
    return sorted(r[0] for r in often.select("akey").collect())


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, tie, pos, n): byte ranges to remove, of docs (doc, tie, text); ranges may overlap."""
    often = common_anchors(docs)
    common, is_common = np.array(often, np.int64), F.col("akey").isin(often)
    spans = docs.select("doc", "tie", "text").mapInArrow(_emit_spans, _SPAN)
    deal = F.when(is_common, F.xxhash64("akey", "skey")).otherwise(F.col("akey")) if often else F.col("akey")
    found = spans.repartition(deal).sortWithinPartitions("akey", "skey", "doc", "tie", "pos")
    found = written(found.mapInArrow(lambda batches: _compare_spans(batches, common), "akey bigint, doc bigint, tie bigint, pos bigint, n bigint"), "spans")
    known, rims = found.where("akey = 0").drop("akey"), found.where("akey <> 0")
    rest = rims.where(~is_common) if often else rims
    hot = rest.groupBy("akey").count().where(F.col("count") > HOT).select(F.col("akey").alias("h"))
    ask = rest.join(hot, F.col("akey") == F.col("h"), "left").select("akey", "doc", "tie", "pos", "n", F.col("h").isNotNull().alias("hot"))
    if often:
        mine = rims.where(is_common)
        sizes = {r[0]: r[1] for r in mine.groupBy("akey").count().collect()}  # COMMON rows at most
        alone, many = ([a for a, n in sizes.items() if test(n)] for test in (lambda n: n == 1, lambda n: n > HOT))
        ask = ask.unionByName(mine.where(~F.col("akey").isin(alone)).withColumn("hot", F.col("akey").isin(many)))
    asked = ask.groupBy("doc", "tie").agg(F.collect_list(F.struct("akey", "pos", "n", "hot")).alias("asked"))

    def contexts(batches):
        gc.disable()
        for b in batches:
            out: list[tuple] = []
            strings: dict[bytes, tuple] = {}  # string -> where this batch has it first
            size = 0
            for doc, tie, text, asks in zip(*(each(c) for c in b.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for q in asks:
                    own = raw[q["pos"] : q["pos"] + q["n"] - 1 + LENGTH]
                    if q["hot"]:
                        for k in range(q["n"]):
                            s, here = own[k : k + LENGTH], (doc, tie, q["pos"] + k)
                            first = strings.setdefault(s, here)
                            if first != here:
                                strings[s], again = min(first, here), max(first, here)
                                out.append(((again[2] * 31 + again[0]) % (1 << 62), *again, -LENGTH, b""))
                    else:
                        out.append((q["akey"], doc, tie, q["pos"], q["n"], own))
                    size += len(own) * (LENGTH if q["hot"] else 1)
                if size > BATCH:
                    yield pack(out + dealt(strings))
                    out, strings, size = [], {}, 0
            if out or strings:
                yield pack(out + dealt(strings))
        give_back()

    def dealt(strings):
        return [(int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True), *at, 1, s) for s, at in strings.items()]

    def pack(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], ["akey", "doc", "tie", "pos", "n", "bytes"])

    texts = asked.join(docs.select("doc", "tie", "text"), ["doc", "tie"]).select("doc", "tie", "text", "asked")
    met = texts.mapInArrow(contexts, "akey bigint, doc bigint, tie bigint, pos bigint, n bigint, bytes binary")
    rim = met.repartition("akey").sortWithinPartitions("akey", "doc", "tie", "pos").mapInArrow(_resolve, _RANGE)
    return known.unionByName(written(rim, "rims"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with doc (id, nulls smallest) and tie (0, or a hash of the text if ids repeat)."""
    twice = docs.groupBy(docs[id_col]).count().where(F.col("count") > 1).limit(1).count()
    tie = F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) if twice else F.lit(0).cast("bigint")
    return docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(-(1 << 63))).alias("doc"), tie.alias("tie"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def kept_bytes(raw: bytes, cuts) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs) of a text and its ranges (pos, n)."""
    if not cuts:
        return raw, 0, 0
    start, n = (np.array(x, np.int64) for x in zip(*cuts))
    _, start, end = _runs(np.zeros(len(start), np.int64), start, start + n)
    out, at = [], 0
    for a, b in zip(start.tolist(), end.tolist()):
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    left = b"".join(out)
    return left, len(raw) - len(left), len(start)


def _with_cuts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    cuts = repeats(keyed).groupBy("doc", "tie").agg(F.collect_list(F.struct("pos", "n")).alias("cuts"))
    return keyed.join(cuts, ["doc", "tie"], "left")


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches):
        for b in batches:
            rows = []
            for text, cuts in zip(each(b.column(1)), each(b.column(2))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                left, gone, spans = kept_bytes(raw, [(c["pos"], c["n"]) for c in cuts or ()])
                rows.append((len(raw), gone, spans, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        give_back()

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return _with_cuts(docs, id_col, text_col).select(F.col(f"row.`{id_col}`").alias("id"), "text", "cuts").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeats cut out of the texts, all columns in place. Characters of which a cut leaves only a part go
    too; untouched rows, null texts included, stay as they are."""

    def cut(batches):
        for b in batches:
            left = [t if not c else kept_bytes(t.encode("utf-8", "surrogatepass"), [(x["pos"], x["n"]) for x in c])[0].decode("utf-8", "ignore") for t, c in zip(each(b.column(1)), each(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string())], ["row", "left"])
        give_back()

    done = _with_cuts(docs, id_col, text_col)
    others = F.struct(F.lit(0).alias("__none"), *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text_col])
    done = done.select(others.alias("row"), "text", "cuts")
    done = done.mapInArrow(cut, T.StructType([done.schema["row"], T.StructField("left", T.StringType())]))
    return done.select(*[F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

"""Token ids as files (operator 9): frequency-ranked ids in byte-aligned variable-length coding.

A shard holds whole documents in ascending id order: a rank table (its ids, most frequent first), the rank of
every token in one to four little-endian bytes, and, apart from the data, control bytes with two bits a token
for the number of bytes. Readers turn control bytes into lengths with a table of 256 rows and gather the data
with numpy, without a loop over tokens. Shards are rows (bucket, seq, start, n_ids, payload) of a Parquet
table in the shared folder, so the write is committed by Spark and a lost task only writes again.

Defined cases: a null or empty text has only the end id; null document ids come first; equal document ids are
ordered by their tokens; an empty table gives no shards; documents longer than a shard stand alone in one; a
document's ids must fit a row, which holds two gigabytes.
"""

from __future__ import annotations

import array
import gc
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import MARKS, PIECES, MadeCache, byte_symbols, words_of
from .common import each, written

_HEAD = struct.Struct("<8sIQQIQ")
_MAGIC = b"FWTOKENS"
#: Byte counts of the four tokens of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
SHARD_IDS = 1 << 20
#: Ranges of ids that a table is dealt into at most: at 2,048 rows each, 537 million rows; ranges are longer beyond.
MAX_BUCKETS = 1 << 18

_LIBRARY: dict[str, Library] = {}


def pack_shard(doc_ids: list, parts: list[np.ndarray], start: int) -> bytes:
    """The bytes of one shard; start: ids in the bucket's earlier shards."""
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    used = used[np.argsort(-counts[used], kind="stable")].astype(np.uint32)
    rank = np.zeros(len(counts), "<u4")
    rank[used] = np.arange(len(used), dtype=np.uint32)
    width = max(1, (len(used) - 1).bit_length() + 7 >> 3)
    size = np.ones(len(counts), np.uint8)
    for k in range(1, width):
        size += rank >= 1 << 8 * k
    rank, size = rank[ids], size[ids]
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = size - 1
    packed = padded.view("<u4")  # two bits of each of four bytes, side by side
    control = (packed | packed >> 6 | packed >> 12 | packed >> 18).astype(np.uint8)
    at = np.cumsum(size, dtype=np.int64)
    data = np.empty(at[-1] if len(at) else 0, np.uint8)
    at -= size
    data[at] = rank.astype(np.uint8)
    for k in range(1, width):
        longer = np.flatnonzero(size > k)
        data[at[longer] + k] = (rank[longer] >> 8 * k).astype(np.uint8)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    lengths = np.array([len(p) for p in parts], np.uint64)
    head = _HEAD.pack(_MAGIC, len(parts), len(ids), start, len(used), len(data))
    return b"".join([head, known.tobytes(), names.tobytes(), lengths.tobytes(), used.tobytes(), control.tobytes(), data.tobytes()])


def read_shard(raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(document ids, tokens of each, all ids as uint32, ids of the bucket before this shard)."""
    magic, n, total, start, n_used, n_data = _HEAD.unpack_from(raw)
    if magic != _MAGIC:
        raise ValueError("not a token shard")
    at = _HEAD.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    known, names, lengths = take(np.uint8, n), take(np.int64, n), take(np.uint64, n).astype(np.int64)
    used, control, data = take(np.uint32, n_used), take(np.uint8, -(-total // 4)), take(np.uint8, n_data)
    size = LENGTHS[control].ravel()[:total]
    at = np.cumsum(size, dtype=np.int64) - size
    rank = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        rank[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return [d if k else None for d, k in zip(names.tolist(), known.tolist())], lengths, used[rank] if total else np.zeros(0, np.uint32), start


class Library:
    """The tokenizers library's encoder of one file, with bounded caches of encoded parts and pieces.

    `parts` holds the ids, as bytes, of text parts that start with a space; the pieces of a part go to the library's model.
    A tokenizer of another kind than plain byte-level BPE (`plain` is false) encodes each text whole."""

    def __init__(self, path: str, limit: int = 176 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores already have a Python worker each
        from tokenizers import Tokenizer, models, pre_tokenizers

        tok = self.tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        cut = tok.pre_tokenizer
        self.plain = tok.normalizer is None and isinstance(tok.model, models.BPE) and not tok.model.dropout and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        self.kind = "H" if tok.get_vocab_size() <= 1 << 16 else "I"
        self.special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        self.parts = MadeCache(self._part, limit)
        self.heads = MadeCache(self.whole, limit // 8)  # texts' first parts, without a space before them
        self._pieces = MadeCache(self._piece, limit // 8)
        self._symbols = dict(enumerate(byte_symbols()))
        self._space = self._symbols[32]
        self._tokens = tok.model.tokenize

    def whole(self, text: str) -> bytes:
        return array.array(self.kind, self.tok.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these bytes, only the space has a stand-in
            symbols = piece.replace(" ", self._symbols[32])
        else:
            symbols = piece.encode().decode("latin-1").translate(self._symbols)
        return array.array(self.kind, [t.id for t in self._tokens(symbols)]).tobytes()

    def _part(self, part: str) -> bytes:
        """Most parts are letters and then marks, which are two pieces, the first a part itself; the pattern cuts others."""
        stem = part.rstrip(MARKS)
        if not stem.isalpha():
            pieces = self._pieces
            return b"".join([pieces[p] for p in PIECES.findall(" " + part)])
        if len(stem) < len(part):
            return self.parts[stem] + self._pieces[part[len(stem) :]]
        symbols = self._space + part if part.isascii() else (" " + part).encode().decode("latin-1").translate(self._symbols)
        return array.array(self.kind, [t.id for t in self._tokens(symbols)]).tobytes()


def library(path: str) -> Library:
    """One encoder for each Python process."""
    if path not in _LIBRARY:
        _LIBRARY[path] = Library(path)
    return _LIBRARY[path]


def encoded(path: str, texts):
    """Yield the ids of each text as bytes (unsigned shorts or ints). Parts of text between spaces, which the
    library encodes on their own, are encoded once each; a text with a special token goes to the library whole."""
    lib = library(path)
    get = lib.parts.__getitem__
    for text in texts:
        text = text or ""
        if not lib.plain or any([s in text for s in lib.special]):
            yield lib.whole(text)
            continue
        windows = words_of(text)
        out = [lib.heads[windows[0].pop(0)]]
        for w in windows:
            out.append(b"".join(map(get, w)))
        yield b"".join(out)


def range_bounds(df: DataFrame, id_col: str, rows: int) -> list[int]:
    """Boundaries that cut ids into ranges of about `rows` rows (at most MAX_BUCKETS ranges, then longer)."""
    ids = df.select(F.col(id_col).cast("bigint").alias("i"))
    n = min(MAX_BUCKETS, ids.count() // rows + 1)
    if n < 2:
        return []
    got = ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], max(10_000, 4 * n))).head()[0]
    return sorted(set(got or []))


def bucket_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range of each id; null ids are in the first."""
    values = np.asarray(ids.fill_null(np.iinfo(np.int64).min), np.int64)
    return np.searchsorted(bounds, values, "left").astype(np.int32)


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2048) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending id order; returns the table of shards."""
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    bounds = np.array(range_bounds(docs, "doc_id", rows_per_bucket), np.int64)

    def encode(batches):
        gc.disable()  # the caches hold no cycles
        kind = library(path).kind
        end = array.array(kind, [end_id]).tobytes()
        for b in batches:
            ids = [x + end for x in encoded(path, each(b.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(b.column(0), bounds)), b.column(0), pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])

    def shards(batches):
        kind = np.uint16 if library(path).kind == "H" else np.uint32
        bucket, seq, before, names, parts, size = None, 0, 0, [], [], 0

        def flush():
            nonlocal seq, before, names, parts, size
            raw = pack_shard(names, parts, before)
            out = pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], ["bucket", "seq", "n_ids", "payload"])
            seq, before, names, parts, size = seq + 1, before + size, [], [], 0
            return out

        for b in batches:
            for own, name, raw in zip(*(c.to_pylist() for c in b.columns)):
                if names and (own != bucket or size >= SHARD_IDS):
                    yield flush()
                if own != bucket:
                    bucket, seq, before = own, 0, 0
                names.append(name)
                parts.append(np.frombuffer(raw, kind))
                size += len(parts[-1])
        if names:
            yield flush()

    coded = docs.mapInArrow(encode, "bucket int, doc_id bigint, ids binary")
    sorted_ = coded.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return written(sorted_.mapInArrow(shards, "bucket int, seq int, n_ids bigint, payload binary"), "token-shards")


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the shards alone."""
    totals = {r[0]: r[1] for r in shards.groupBy("bucket").agg(F.sum("n_ids")).collect()}  # at most MAX_BUCKETS rows
    before, total = {}, 0
    for k in sorted(totals):
        before[k], total = total, total + totals[k]

    def read(batches):
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), each(b.column(1))):
                names, lengths, ids, start = read_shard(raw)
                first = np.cumsum(lengths) - lengths
                low = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(low[i : i + n]) for i, n in zip(first.tolist(), lengths.tolist())]
                cols = [pa.array(names, pa.int64()), pa.array(first + start + before[bucket]), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return shards.select("bucket", "payload").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)

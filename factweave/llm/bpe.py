"""BPE encoding and decoding of whole texts (operator 8).

`encode_column` adds the token ids of a text column, `decode_column` turns ids back into text, and
`round_trip` gives digests of both without moving ids between executors. All are map-only: no shuffle. Pieces of
text go through the bounded-lookahead transducer (`ByteBPE.transduce`), all new ones of about a megabyte of text at
once; a cache, bounded in bytes, keeps the ids of short pieces and parts in each Python worker.

Defined cases: a null or empty text has no tokens and decodes to the empty text; a special token's string in
a text is that one token; texts of any length run in windows; other columns, whatever their names, stay.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytebpe import LONGEST, PIECES, ByteBPE, PartCache, pieces_of, words_of
from .common import each, give_back

#: Bytes of pieces that a pass over ids keeps; the columns beside them need the memory.
IDS_CACHE = 32 << 20

_CODERS: dict[str, tuple] = {}


def coder(path: str) -> tuple[ByteBPE, PartCache, PartCache]:
    """The encoder of a file with its caches, once per Python process: pieces -> ids, parts -> (count, ",id,id", bytes).
    A part is the text behind a space that starts a piece, or, as a tuple, the text at the start of a span."""
    if path not in _CODERS:
        _CODERS[path] = ByteBPE(path), PartCache(), PartCache()
    return _CODERS[path]


def release(path: str) -> None:
    """Empty the caches at a task's end: Spark keeps idle Python workers, which should hold no memory."""
    for cache in coder(path)[1:]:
        cache.clear()
    give_back()


def packed(bpe: ByteBPE, ids: list[int]) -> tuple[int, str, bytes]:
    digits, raw = bpe.token_digits, bpe.token_bytes
    return len(ids), "".join([digits[i] for i in ids]), b"".join([raw[i] for i in ids])


def encode_pieces(path: str, wanted: set[str], limit: int) -> PartCache:
    """The cache of pieces, with ids of all wanted ones: those that it lacks go through the transducer, all at once."""
    bpe, pieces, _ = coder(path)
    pieces.limit = limit
    pieces.trim()
    pieces.loose = {}
    lack = list(wanted.difference(pieces))
    loose, total = pieces.loose, 0
    for p, ids in zip(lack, bpe.transduce([p.encode() for p in lack])):
        if len(p) <= LONGEST:
            pieces[p] = ids
            total += 200 + len(p) + 36 * len(ids)
        else:
            loose[p] = ids
    pieces.size += total
    return pieces


def fetch(path: str, lists: list[list]) -> None:
    """Encode, all at once, what the cache of parts lacks of some lists of parts."""
    bpe, _, parts = coder(path)
    parts.trim()
    parts.loose = {}
    new = list(set().union(*lists).difference(parts))
    found = [PIECES.findall(p[0]) if isinstance(p, tuple) else pieces_of(p) for p in new]
    pieces = encode_pieces(path, set().union(*found), parts.limit)
    loose, total = parts.loose, 0
    for part, own in zip(new, found):
        ids = pieces[own[0]] if len(own) == 1 else [i for p in own for i in pieces[p]]
        value = packed(bpe, ids)
        size = len(value[2])
        (parts if size <= LONGEST else loose)[part] = value
        if size <= LONGEST:
            total += 300 + size + size + len(value[1])
    parts.size += total
    pieces.loose = {}


def text_windows(path: str, text: str) -> list:
    """A text as special tokens' ids, and lists of parts."""
    out: list = []
    for span in coder(path)[0].spans(text):
        if isinstance(span, int):
            out.append(span)
        else:
            first, *rest = words_of(span)
            out += [[(first[0],), *first[1:]], *rest]
    return out


def entries(path: str, windows: list):
    """Lists of (count, ",id,id", bytes) that make up a text, window by window."""
    bpe, _, parts = coder(path)
    for window in windows:
        yield [packed(bpe, [window])] if isinstance(window, int) else list(map(parts.__getitem__, window))


def by_slices(path: str, texts, limit: int = 1 << 20):
    """Yield each text's windows after the caches were filled for about limit characters at once."""
    held: list[list] = []
    size = 0

    def ready():
        fetch(path, [w for ws in held for w in ws if not isinstance(w, int)])
        return iter(held)

    for text in texts:
        text = text or ""
        held.append(text_windows(path, text))
        size += len(text)
        if size >= limit:
            yield from ready()
            held, size = [], 0
    yield from ready()


def digest_windows(path: str, windows: list) -> tuple[int, str, str]:
    """(tokens, SHA-256 of the comma-joined ids, SHA-256 of the decoded text)."""
    n, started = 0, False
    ids, back = hashlib.sha256(), hashlib.sha256()
    decoder = coder(path)[0].decoder()
    for window in entries(path, windows):
        n += sum([e[0] for e in window])
        digits = "".join([e[1] for e in window])
        if digits:
            ids.update((digits if started else digits[1:]).encode())
            started = True
        back.update(decoder.feed_bytes(b"".join([e[2] for e in window])).encode())
    back.update(decoder.finish().encode())
    return n, ids.hexdigest(), back.hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encode, then decode the ids again."""

    def run(batches):
        gc.disable()  # the caches hold no cycles
        try:
            for b in batches:
                out = [digest_windows(path, w) for w in by_slices(path, each(b.column(1)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            release(path)

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def ids_of(path: str, texts: list[str]) -> list[list[int]]:
    """Token ids of some texts; pieces that the cache lacks are encoded together."""
    bpe = coder(path)[0]
    found = [[[span] if isinstance(span, int) else PIECES.findall(span) for span in bpe.spans(t or "")] for t in texts]
    pieces = encode_pieces(path, {p for spans in found for s in spans for p in s if not isinstance(p, int)}, IDS_CACHE)
    out = []
    for spans in found:
        ids: list[int] = []
        for s in spans:
            for p in s:
                ids += [p] if isinstance(p, int) else pieces[p]
        out.append(ids)
    pieces.loose = {}
    return out


def text_of(path: str, ids) -> str:
    decoder = coder(path)[0].decoder()
    return decoder.feed(np.asarray(ids if ids is not None else (), np.int64).tolist()) + decoder.finish()


def _slices(column, limit: int = 1 << 20):
    """Runs of texts of about limit characters."""
    held: list[str] = []
    size = 0
    for t in each(column):
        held.append(t or "")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    yield held


def _encoded(path: str, column) -> pa.Array:
    return pa.concat_arrays([pa.array(ids_of(path, part), pa.list_(pa.int32())) for part in _slices(column)])


def _decoded(path: str, column) -> pa.Array:
    return pa.array([text_of(path, x) for x in each(column)], pa.string())


def _appended(docs: DataFrame, path: str, source: str, new: dict[str, T.DataType], convert) -> DataFrame:
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in new.items())])
    at = docs.columns.index(source)

    def run(batches):
        gc.disable()
        try:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, *convert(b.column(at))], [*b.schema.names, *new])
        finally:
            release(path)

    return docs.mapInArrow(run, schema)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with an array<int> column of token ids; a column of that name is replaced."""
    return _appended(docs, path, text_col, {ids_col: T.ArrayType(T.IntegerType())}, lambda c: [_encoded(path, c)])


def decode_column(docs: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of a column of token ids; null ids give the empty text; a column of that name is replaced."""
    return _appended(docs, path, ids_col, {text_col: T.StringType()}, lambda c: [_decoded(path, c)])


def transcode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with token ids, and the text that these ids decode to, in one pass; columns of those names are replaced."""

    def both(column):
        ids = _encoded(path, column)
        return [ids, _decoded(path, ids)]

    return _appended(docs, path, text_col, {ids_col: T.ArrayType(T.IntegerType()), decoded_col: T.StringType()}, both)

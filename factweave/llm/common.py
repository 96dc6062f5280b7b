"""Shared plumbing of the training-data operators: tables, shared scratch, byte views of text."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, written

#: Bytes of text handled at once inside a Python worker; bounds its memory whatever the batch size.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32 of the id's decimal text, modulo n (the split rule of the contracts); a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the system at a task's end: Spark keeps idle Python workers beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


def one_thread() -> None:
    """Keep numpy's matrix products in this thread: an executor's cores have a Python worker each, and threads that wait
    for one another's small products would burn more time than the products take."""
    try:
        with open("/proc/self/maps") as f:
            found = {x.split()[-1] for x in f if "openblas" in x}
    except OSError:
        return  # not Linux
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def each(column):
    """The values of an Arrow column one by one, so that a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)


def byte_slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Yield (i, j) row ranges of about limit bytes; a longer row stands alone, for its user to take in blocks."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits, and every byte of a multi-byte character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True
_PRIME = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _PRIME | 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(256)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word (maximal run of WORD_BYTE in the ASCII-lower-cased bytes) of the rows data[offs[i]:offs[i+1]].

    Returns (hash uint64, row int64, length int64) in text order. A word is hashed as 64-byte blocks whose
    position-weighted sums are mixed, so its length is not bounded. Long data is taken in blocks that end between words."""
    if len(data) <= 2 * SLICE_BYTES:
        return _word_hashes(data, offs)
    found, i = [], 0
    while i < len(data):
        j = min(len(data), i + SLICE_BYTES)
        while j < len(data) and WORD_BYTE[LOWER[data[j - 1]]]:  # on to the word's end
            ahead = np.flatnonzero(~WORD_BYTE[LOWER[data[j : j + 4096]]])
            j = min(len(data), j + 4096) if not len(ahead) else j + int(ahead[0]) + 1
        found.append(_word_hashes(data[i:j], np.clip(offs, i, j) - i))
        i = j
    return tuple(map(np.concatenate, zip(*found)))


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[data]
    is_word = WORD_BYTE[low]
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = is_word[0], is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:n])
    cut = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
    cut = cut[is_word[cut] & is_word[cut - 1]]  # a word must not cross two rows
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, np.repeat(np.unique(cut), 2)]))
    start, end = at[0::2], at[1::2]
    if not len(start):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    h = span_hashes(low, start, end)
    row = np.searchsorted(offs, start, "right") - 1
    return h, row, end - start


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every non-empty byte span [start, end); spans are disjoint and ascending."""
    length = end - start
    within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    src = np.repeat(start, length) + within
    v = (low[src].astype(np.uint64) + np.uint64(1)) * _POW[within & 255]
    v ^= v >> np.uint64(29)
    v *= _MIX1
    if length.max(initial=0) > 256:
        far = np.flatnonzero(within >= 256)  # of long words only: a word's hash depends on the word alone
        v[far] = (v[far] ^ mix64((within[far] >> 8).astype(np.uint64))) * _MIX2
    first = np.cumsum(length) - length
    return mix64(np.add.reduceat(v, first) ^ (length.astype(np.uint64) << np.uint64(32)))


__all__ = ["LOWER", "SLICE_BYTES", "WORD_BYTE", "byte_slices", "crc_mod", "each", "give_back", "mix64", "one_thread", "read_table", "shared_dir", "span_hashes", "utf8_parts", "word_hashes", "written"]

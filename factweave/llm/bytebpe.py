"""Byte-level BPE as a streaming transducer with a bounded lookahead, and the matching decoder.

A tokenizer file gives a vocabulary and a ranked merge list. Text is cut into pieces by the byte-level
pattern; merges never cross pieces. Inside a piece the transducer keeps a short buffer: a token boundary is
final once `lookahead` bytes behind it have been read, so tokens before it are emitted and their bytes
dropped. `lookahead` is computed from the merge list: whether a merge takes place depends on bytes to its
right only through a merge of smaller rank that would take its last token away, which depends in turn on a
merge of smaller rank still; the longest such falling chain, in bytes, bounds how far a decision can see.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import regex

#: Fixed value: the piece pattern of the byte-level pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Marks that may stand behind a word; each is neither letter, digit nor white space.
MARKS = ".,;:!?*$&#%()-_\"'"
#: A space whose left neighbour isn't white space starts a new piece whatever follows.
_CUT = re.compile(r"(?<!\s) ")
_RUN = re.compile(r"\s ")
#: Characters of a text that are cut and looked up at once.
WINDOW_CHARS = 1 << 18
_FREE = (1 << 31) - 1


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else the next free code point from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else free))
        free += b not in keep
    return out


class ByteBPE:
    """Encoder and decoder of one tokenizer file (byte-level BPE, tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for s, i in vocab.items():
            if s not in self.special:
                self.token_bytes[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.byte_ids = [vocab[s] for s in symbols]
        self.shift = size.bit_length()
        self.merge: dict[int, int] = {}
        self.made: list[int] = []
        left = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a] << self.shift | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
            left.append((vocab[a], vocab[b]))
        self.token_sizes = list(map(len, self.token_bytes))
        self.token_digits = [f",{i}" for i in range(size)]
        self.lookahead = self._lookahead(left)
        self.window = max(1024, 4 * self.lookahead)
        keys = np.fromiter(self.merge, np.int64, len(self.merge))
        order = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[order], 1 << 62), np.append(order, _FREE).astype(np.int32)
        self._made = np.array(self.made, np.int32)
        self._byte_ids = np.array(self.byte_ids, np.int32)
        self._special_cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _lookahead(self, merges: list[tuple[int, int]]) -> int:
        beyond: dict[bytes, int] = {}  # left token -> how far a merge of it, seen so far, looks past that token
        most = 0
        for a, b in merges:
            whole, right = self.token_bytes[a] + self.token_bytes[b], len(self.token_bytes[b])
            reach = right + max((beyond.get(whole[i:], 0) for i in range(len(whole))), default=0)
            key = self.token_bytes[a]
            if reach > beyond.get(key, 0):
                beyond[key] = reach
            most = max(most, reach)
        return most + max(map(len, self.token_bytes))

    def merge_all(self, buffer: bytes) -> list[int]:
        """Apply the merges to a whole buffer, smallest rank first, leftmost first."""
        ids, get, shift, made = [self.byte_ids[b] for b in buffer], self.merge.get, self.shift, self.made
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << shift | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << shift | ids[j]) != rank:
                continue  # one of the two was merged already
            ids[i], ids[j] = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << shift | ids[k])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := get(ids[h] << shift | ids[i])) is not None:
                heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def stable(self, ids: list[int], size: int) -> tuple[int, int]:
        """(tokens, bytes) at the start of a merged buffer that what follows the buffer can't change."""
        done, sizes = 0, self.token_sizes
        for k, t in enumerate(ids):
            if done + sizes[t] > size - self.lookahead:
                return k, done
            done += sizes[t]
        return len(ids), done

    def stream(self, chunks) -> Iterator[int]:
        """Emit the tokens of one piece, whose bytes come in chunks, as they become stable: what is held is the lookahead
        and a chunk, whatever the piece's length."""
        buffer = b""
        for chunk in chunks:
            for k in range(0, len(chunk), self.window):
                buffer += chunk[k : k + self.window]
                if len(buffer) >= self.window + self.lookahead:
                    ids = self.merge_all(buffer)
                    n, done = self.stable(ids, len(buffer))
                    yield from ids[:n]
                    buffer = buffer[done:]
        yield from self.merge_all(buffer)

    def transduce(self, pieces: list[bytes]) -> list[list[int]]:
        """The transducer over many pieces at once. Each piece has a buffer of `window` bytes at most; in a round all
        buffers are filled and merged, and each emits and drops its stable tokens (at its piece's end, all)."""
        out: list[list[int]] = [[] for _ in pieces]
        open_ = [(i, 0) for i in range(len(pieces))]
        while open_:
            buffers = [pieces[i][at : at + self.window] for i, at in open_]
            still = []
            for (i, at), buffer, ids in zip(open_, buffers, self._merged(buffers)):
                if at + len(buffer) == len(pieces[i]):
                    out[i] += ids
                else:
                    n, done = self.stable(ids, len(buffer))
                    out[i] += ids[:n]
                    still.append((i, at + done))
            open_ = still
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << self.shift | right
        at = np.searchsorted(self._keys, pair)
        return np.where(self._keys[at] == pair, self._ranks[at], _FREE)

    def _merged(self, buffers: list[bytes]) -> list[list[int]]:
        """merge_all of many buffers: those of 64 bytes at most lie in the rows of a matrix, and each round applies every
        row's merge of smallest rank, leftmost first."""
        out: list[list[int]] = [[] for _ in buffers]
        sizes = np.fromiter(map(len, buffers), np.int64, len(buffers))
        for i in np.flatnonzero(sizes > 64).tolist():
            out[i] = self.merge_all(buffers[i])
        for low, width in ((0, 8), (8, 12), (12, 20), (20, 64)):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for k in range(0, len(rows), 4096):
                part = rows[k : k + 4096]
                for i, ids in zip(part.tolist(), self._merge_rows([buffers[i] for i in part.tolist()], sizes[part], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], live: np.ndarray, width: int) -> list[list[int]]:
        n, col = len(pieces), np.arange(width)
        ids = self._byte_ids[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8)].reshape(n, width)
        rank = np.full((n, width), _FREE, np.int32)
        rank[:, :-1] = np.where(col[1:] < live[:, None], self._rank(ids[:, :-1], ids[:, 1:]), _FREE)
        done: list = [None] * n
        row, live = np.arange(n), live.copy()
        while len(row):
            here = np.arange(len(row))
            at = rank.argmin(1)
            best = rank[here, at]
            over = best == _FREE
            if over.any():
                for r, x, size in zip(row[over].tolist(), ids[over].tolist(), live[over].tolist()):
                    done[r] = x[:size]
                keep = ~over
                row, ids, rank, live, at, best = row[keep], ids[keep], rank[keep], live[keep], at[keep], best[keep]
                here = np.arange(len(row))
                if not len(row):
                    break
            behind = col[:-1] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            new = self._made[best]
            ids[here, at] = new
            live -= 1
            ahead = at + 1 < live
            rank[here, at] = np.where(ahead, self._rank(new, ids[here, np.minimum(at + 1, width - 1)]), _FREE)
            prior = np.flatnonzero(at > 0)
            rank[prior, at[prior] - 1] = self._rank(ids[prior, at[prior] - 1], new[prior])
        return done

    def spans(self, text: str) -> Iterator[str | int]:
        """Cut a text into parts that are encoded on their own; a special token comes as its id."""
        if self._special_cut is None or not any(s in text for s in self.special):
            yield text
            return
        for part in self._special_cut.split(text):
            if part in self.special:
                yield self.special[part]
            elif part:
                yield part

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.spans(text):
            if isinstance(part, int):
                out.append(part)
            else:
                out += itertools.chain.from_iterable(self.transduce([p.encode() for p in PIECES.findall(part)]))
        return out

    def decoder(self) -> Decoder:
        return Decoder(self.token_bytes)


class Decoder:
    """Incremental state machine from token ids to text: ids in, characters out, at most three bytes held back."""

    def __init__(self, token_bytes: list[bytes]):
        self._bytes = token_bytes
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self._state.decode(b"".join([self._bytes[i] for i in ids]))

    def feed_bytes(self, raw: bytes, final: bool = False) -> str:
        return self._state.decode(raw, final)

    def finish(self) -> str:
        return self._state.decode(b"", True)


def words_of(text: str) -> list[list[str]]:
    """Cut a text at the spaces that start a piece: windows of parts, each part but the very first without its leading space.

    The first part of the first window stands without a space; all others are to be read as " " + part."""
    if len(text) <= WINDOW_CHARS:
        return [_CUT.split(text) if _RUN.search(text) else text.split(" ")]
    out, i, n = [], 0, len(text)
    while i < n:
        j = min(n, i + WINDOW_CHARS)
        while j < n and (m := _CUT.search(text, j)) is not None:
            j = m.start()
            break
        else:
            j = n
        part = text[i:j]
        out.append(_CUT.split(part) if _RUN.search(part) else part.split(" "))
        i = j + 1
        if j < n and i >= n:
            out.append([""])
    return out


def pieces_of(part: str) -> list[str]:
    """The pieces of a part, with the space before it. Most are letters and then marks; the pattern cuts the others."""
    stem = part.rstrip(MARKS)
    if not stem.isalpha():
        return PIECES.findall(" " + part)
    return [" " + part] if len(stem) == len(part) else [" " + stem, part[len(stem) :]]


#: Characters (or bytes) of the longest part that a cache keeps.
LONGEST = 64


class PartCache(dict):
    """Text part -> its ids in some form. Parts of more than LONGEST characters are `loose`: held with the texts at
    hand only; once what is kept has about `limit` bytes, it is dropped."""

    def __init__(self, limit: int = 96 << 20):
        super().__init__()
        self.limit, self.size = limit, 0
        self.loose: dict = {}

    def __missing__(self, part):
        return self.loose[part]

    def trim(self) -> None:
        """Drop all if the limit is reached."""
        if self.size >= self.limit:
            self.clear()

    def clear(self) -> None:
        super().clear()
        self.loose, self.size = {}, 0


class MadeCache(dict):
    """Text part -> the bytes that `make` gives for it, with the same bounds."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, part):
        value = self.make(part)
        if len(part) <= LONGEST:
            if self.size >= self.limit:
                self.clear()
                self.size = 0
            self[part] = value
            self.size += 190 + len(part) + len(value)  # with what a dict holds for each
        return value

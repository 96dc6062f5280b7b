"""Masked pseudo-likelihood scoring (operator 1): a bidirectional window network trained in numpy.

Words (hashed runs of letters and digits) are the tokens. The network has GROWTH * sqrt(D) ids for D different
words, and 1,024 at least: the most frequent words of the whole corpus have their own id, all others share the
rest by hash (VOCAB to HASHED). The network predicts each token from the two before and the two behind it: one
embedding table a position, summed, a tanh layer, and a softmax in two levels (class of the token, then the token
in its class), so a prediction costs about 2 * sqrt(V) outputs instead of V. The probability of a word that
shares its id is that of the id times the word's share of the id's count in the corpus, so each counted word has
its own probability. A document's score is the sum of the conditional log-probabilities of all its tokens.

Corpus statistics cover every word of every document: counts are summed per task and combined by Spark.
Training is local SGD on every position of every document, once each: a round of so many takes the positions of
its residue, every partition trains on its own from the shared parameters, and the parameters are averaged by the
number of positions; the average is a tree of small grouped sums, so parameters of all partitions never meet
in one place. Scoring is one pass over whole texts; counts of the COMMON most frequent words travel with the
model, and the words of lower counts are joined with the table of counts.

Defined cases: null texts and texts without words have no tokens, pll 0 and mean 0; ends of a document are a
token of their own; ties in frequency go to the smaller hash; an empty corpus trains nothing; other columns
are kept by `score`; all words that the corpus lacks count together as one word met once in their id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, each, give_back, one_thread, utf8_parts, word_hashes, written

CLASSES = 32  # at least
VOCAB, HASHED = 800, 223  # own to shared ids; with the end token 32 * 32 ids
GROWTH = 4
COMMON = 1 << 18
WINDOW, DIM = 2, 16
ROUNDS, RATE, BATCH = 2, 0.8, 8192
CHUNK = 4096
#: Outputs of the network, before the softmax, lie within this: no exponential leaves its range.
LIMIT = 60


def _sizes(classes: int) -> tuple[tuple[int, ...], ...]:
    return ((2 * WINDOW, classes * classes, DIM), (DIM,), (DIM + 1, classes), (classes, DIM + 1, classes))


def classes_for(different: int) -> int:
    """Classes of the softmax, the root of the number of ids, for a corpus of so many different words."""
    return max(CLASSES, math.ceil(math.sqrt(GROWTH) * different**0.25))


def own_ids(classes: int) -> int:
    return (classes * classes - 1) * VOCAB // (VOCAB + HASHED)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): hash and count of every word of every document."""

    def run(batches):
        for b in batches:
            data, offs = utf8_parts(b.column(0))
            for i, j in byte_slices(offs):
                h, n = np.unique(word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select(text_col).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def initial(classes: int = CLASSES, seed: int = 3) -> list[np.ndarray]:
    """Tables of the context places, their bias, and the weights of classes and of tokens in each class; the last row of
    weights is their bias."""
    rng = np.random.default_rng(seed)
    tables, bias, wc, wm = ((rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for s in _sizes(classes))
    wc[-1] = wm[:, -1] = 0
    return [tables, bias, wc, wm]


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the frequent words
    ids: np.ndarray  # their ids, by frequency
    params: list[np.ndarray]
    common: np.ndarray  # sorted hashes of the words whose counts travel with the model
    counts: np.ndarray  # their counts
    totals: np.ndarray  # count of all words that share each shared id
    rare: DataFrame | None = None  # (h, n): words that aren't common and were met more than once; None without any

    @property
    def classes(self) -> int:
        return self.params[2].shape[1]

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """The hidden layer, and a column of ones for the biases."""
        tables, bias = self.params[:2]
        z = tables[0][around[0]]
        for k in range(1, 2 * WINDOW):
            z += tables[k][around[k]]
        z += bias
        out = np.empty((len(z), DIM + 1), np.float32)
        np.tanh(z, out=out[:, :DIM])
        out[:, DIM] = 1
        return out

    def sent(self, scoring: bool) -> Model:
        """What tasks need."""
        none = np.zeros(0, np.uint64)
        return replace(self, rare=None) if scoring else replace(self, rare=None, common=none, counts=none, totals=none)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed words; 0 is the end of a document."""
        own = own_ids(self.classes)
        out = (1 + own + (h >> np.uint64(1)) % np.uint64(self.classes**2 - 1 - own)).astype(np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            own = self.known[at] == h
            out[own] = self.ids[at[own]]
        return out

    def shares(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each word's share of its id, 0 if the id is its own, and where a word isn't common:
        there its count is still to be added, 1 so far."""
        out, first = np.zeros(len(h)), 1 + own_ids(self.classes)
        folded = np.flatnonzero(ids >= first)
        out[folded] = -np.log(self.totals + 1.0)[ids[folded] - first]
        if not len(self.common):
            return out, folded
        at = np.minimum(np.searchsorted(self.common, h[folded]), len(self.common) - 1)
        met = self.common[at] == h[folded]
        out[folded[met]] += np.log(self.counts)[at[met]]
        return out, folded[~met]

    def contexts(self, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The tokens around every position, 0 beyond its document: shape (2 * WINDOW, n)."""
        n = len(ids)
        out = np.zeros((2 * WINDOW, n), np.int32)
        for k, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
            a, b = (slice(-d, n), slice(0, n + d)) if d < 0 else (slice(0, n - d), slice(d, n))
            if n > abs(d):
                out[k, a] = np.where(row[a] == row[b], ids[b], 0)
        return out

    def log_probability(self, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
        wc, wm = self.params[2:]
        classes = self.classes
        order = np.argsort(ids % classes, kind="stable")
        kind, own, hidden, n = ids[order] % classes, ids[order] // classes, self.hidden(around[:, order]), np.arange(len(ids))
        found = np.concatenate([np.zeros(0), *(_normalised(hidden[k : k + 4096] @ wc, n[: len(ids) - k][:4096], kind[k : k + 4096]) for k in range(0, len(ids), 4096))])
        cuts = np.searchsorted(kind, np.arange(classes + 1)).tolist()
        for c in range(classes):
            i, j = cuts[c], cuts[c + 1]
            if i < j:
                found[i:j] += _normalised(hidden[i:j] @ wm[c], n[: j - i], own[i:j])
        out = np.empty(len(ids))
        out[order] = found
        return out

    def train_step(self, ids: np.ndarray, around: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a minibatch, in place."""
        tables, bias, wc, wm = self.params
        classes = self.classes
        order = np.argsort(ids % classes, kind="stable")
        around, ids = around[:, order], ids[order]
        hidden, n, kind, own, size = self.hidden(around), np.arange(len(ids)), ids % classes, ids // classes, np.float32(len(ids))
        step, ones = 8 * np.float32(rate) / size, np.ones(classes, np.float32)
        g = _softmax(hidden @ wc, ones)
        g[n, kind] -= 1
        back = g @ wc.T
        cuts = np.searchsorted(kind, np.arange(classes + 1)).tolist()
        for c in range(classes):
            i, j = cuts[c], cuts[c + 1]
            if i < j:
                h = hidden[i:j]
                e = _softmax(h @ wm[c], ones)
                e[n[: j - i], own[i:j]] -= 1
                back[i:j] += e @ wm[c].T
                wm[c] -= step * (h.T @ e)
        wc -= step * (hidden.T @ g)
        back = back[:, :DIM] * (1 - hidden[:, :DIM] ** 2)
        bias -= step * back.sum(0)
        columns = back.T.astype(np.float64)
        place = np.zeros(classes * classes, np.int64)
        for k in range(2 * WINDOW):
            # rows of a table are met unevenly: scale by the root of how often, so rare contexts learn too
            times = np.bincount(around[k], minlength=classes * classes)
            met = np.flatnonzero(times)
            place[met] = np.arange(len(met))
            at = place[around[k]]
            move = np.empty((len(met), DIM), np.float32)
            for d in range(DIM):
                move[:, d] = np.bincount(at, columns[d], len(met))
            tables[k][met] -= np.float32(rate) * move / np.sqrt(times[met] * size)[:, None].astype(np.float32)


def _softmax(z: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probabilities of each row."""
    np.clip(z, -LIMIT, LIMIT, out=z)
    np.exp(z, out=z)
    z /= (z @ ones)[:, None]
    return z


def _normalised(z: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of one output a row."""
    np.clip(z, -LIMIT, LIMIT, out=z)
    own = z[n, at]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], z.dtype))


def _flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params]).astype(np.float32)


def _unflat(flat: np.ndarray, classes: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in _sizes(classes):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s).astype(np.float32).copy())
        at += n
    return out


def turned(row: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The positions of a turn: every one belongs to one turn. Documents start at different turns."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    first = np.repeat(starts, np.diff(np.append(starts, len(row))))  # where the row's document starts
    return np.flatnonzero((np.arange(len(row)) - first + row + turn) % rounds == 0)


def _round(docs: DataFrame, model: Model, text_col: str, turn: int, rounds: int) -> list[np.ndarray] | None:
    """One round of local SGD: parameters averaged over partitions by their number of trained positions. Over all
    turns, each position is trained on once."""
    shared = docs.sparkSession.sparkContext.broadcast(model.sent(False))

    def train(batches):
        one_thread()
        own = replace(shared.value, params=[p.copy() for p in shared.value.params])
        done, held = 0, []
        salt = 0

        def step():
            ids = np.concatenate([x[0] for x in held])
            around = np.concatenate([x[1] for x in held], axis=1)
            edges = np.linspace(0, len(ids), max(1, round(len(ids) / BATCH)) + 1).astype(int).tolist()  # no small last one
            for i, j in zip(edges, edges[1:]):
                own.train_step(ids[i:j], around[:, i:j], RATE)
            return len(ids)

        for b in batches:
            data, offs = utf8_parts(b.column(0))
            for i, j in byte_slices(offs):
                h, row, _ = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = own.tokens(h)
                around = own.contexts(ids, row)
                at = turned(row, turn, rounds)
                salt = (salt + int(h[:1].sum() & np.uint64(0xFFFF))) % 256 if len(h) else salt
                held.append((ids[at], around[:, at]))
                if sum(len(x[0]) for x in held) >= BATCH:
                    done += step()
                    held = []
        if held:
            done += step()
        if done:
            flat = _flat(own.params) * np.float32(done)
            chunks = np.array_split(flat, range(CHUNK, len(flat), CHUNK))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([salt] * len(chunks), pa.int32()), pa.array([done] * len(chunks), pa.int64()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "salt", "n", "v"])

    def add(key, table):
        total = np.zeros(len(table["v"][0].as_py()) // 4)
        for raw in each(table["v"]):
            total += np.frombuffer(raw, np.float32)
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "chunk int, salt int, n bigint, v binary"
    parts = docs.select(text_col).mapInArrow(train, schema)
    some = parts.groupBy("chunk", "salt").applyInArrow(add, schema)
    rows = some.groupBy("chunk").applyInArrow(add, schema).collect()  # the parameters once: 330 bytes an id
    if not rows:
        return None
    return _unflat(np.concatenate([np.frombuffer(r["v"], np.float32) / r["n"] for r in sorted(rows, key=lambda r: r["chunk"])]), model.classes)


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Count all words, then train the network on all documents."""
    words = written(word_counts(docs, text_col), "pseudolm-counts")
    met = sorted(((r["n"], r["k"]) for r in words.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)  # a row a count, not a word
    classes = classes_for(sum(k for _, k in met))
    own = own_ids(classes)
    top = words.orderBy(F.desc("n"), "h").limit(own).toArrow()
    known = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    least, size = 1 << 62, 0  # common words are those of this count and more
    for n, k in met:
        size += k
        if size > COMMON:
            break
        least = n
    common = words.where(F.col("n") >= least).toArrow()
    h, counts = common["h"].to_numpy().view(np.uint64), common["n"].to_numpy()
    by_hash = np.argsort(h)
    shared = classes**2 - 1 - own
    totals = np.zeros(shared, np.int64)
    for r in words.groupBy((F.shiftrightunsigned("h", 1) % shared).cast("int").alias("b")).agg(F.sum("n").alias("n")).collect():  # a row a shared id
        totals[r["b"]] = r["n"]
    np.subtract.at(totals, ((known >> np.uint64(1)) % np.uint64(shared)).astype(np.int64), top["n"].to_numpy())
    rare = words.where((F.col("n") < least) & (F.col("n") > 1)) if any(1 < n < least for n, _ in met) else None
    model = Model(known[order], (order + 1).astype(np.int32), initial(classes), h[by_hash], counts[by_hash], totals, rare)
    for k in range(rounds):
        params = _round(docs, model, text_col, k, rounds)
        if params is None:
            break
        model = replace(model, params=params)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, pll (summed log-probability) and mean_pll (columns of those names are replaced)."""
    docs = docs.drop("n_tokens", "pll", "mean_pll")
    at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != at]
    names = [docs.columns[k] for k in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model.sent(True))
    join = model.rare is not None

    def run(batches):
        one_thread()
        m = shared.value
        for b in batches:
            data, offs = utf8_parts(b.column(at))
            n, pll = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            words, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in byte_slices(offs):
                h, row, _ = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = m.tokens(h)
                around = m.contexts(ids, row)
                for k in range(0, len(ids), 1 << 15):
                    own = slice(k, k + (1 << 15))
                    share, open_ = m.shares(h[own], ids[own])
                    pll[i:j] += np.bincount(row[own], m.log_probability(ids[own], around[:, own]) + share, j - i)
                    if join:
                        words.append(h[own][open_])
                        owner.append(row[own][open_] + i)
                n[i:j] += np.bincount(row, minlength=j - i)
            cuts = np.searchsorted(np.concatenate(owner), np.arange(b.num_rows + 1))
            rare = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(words).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(n), pa.array(pll), rare], [*names, "n_tokens", "pll", "__rare"])
        give_back()

    out = docs.mapInArrow(run, T.StructType([*(docs.schema.fields[k] for k in kept), T.StructField("n_tokens", T.LongType()), T.StructField("pll", T.DoubleType()), T.StructField("__rare", T.ArrayType(T.LongType()))]))
    pll = F.col("pll")
    if join:
        out = written(out.withColumn("__row", F.monotonically_increasing_id()), "pseudolm-scores")
        sums = out.select("__row", F.explode("__rare").alias("h")).join(model.rare, "h").groupBy("__row").agg(F.sum(F.log("n")).alias("__more"))
        out, pll = out.join(sums, "__row", "left"), pll + F.coalesce("__more", F.lit(0.0))
    return out.select(*names, "n_tokens", F.round(pll, 4).alias("pll"), F.round(pll / F.greatest("n_tokens", F.lit(1)), 6).alias("mean_pll"))

"""Language identification (operator 2): averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the embeddings of its byte trigrams (hashed, ASCII-lower-cased, white space and
digits folded), put through a linear softmax; embeddings and softmax are trained together by stochastic
gradient descent in numpy. As averaging is linear, prediction needs one row of class scores per trigram
bucket (embedding times weights), so a whole text is one gather and one sum.

Training takes SAMPLE labelled documents in all on average and never more than twice as many, dealt evenly over the
LANGS most frequent languages (no other is learned) by a hash of their id and text, so copies of a text are drawn one
by one; their trigram counts, not their texts, come to the driver. A fifth of them is held back: a temperature makes
the probabilities honest there, and a text is rejected if its probability or the share of its trigrams that
the training had seen is below nearly all of that held-back fifth (REJECT of it).

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; ties go to the
first language in order; other columns are kept; without any labelled row every document is `und`; a text of
more than two megabytes is averaged over blocks of one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SLICE_BYTES, byte_slices, give_back, utf8_parts

BUCKETS, DIM = 1 << 15, 16
SAMPLE, LANGS = 4000, 1000
#: Share of held-back in-language texts that each of the two rejection rules may lose.
REJECT = 0.001
_FOLD = LOWER.copy()
_FOLD[:65] = 32  # white space, digits and ASCII punctuation before the letters
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def trigram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte trigram, rows' offsets into them); a row of n bytes has n trigrams, with one space
    put before and behind it."""
    n = len(offs) - 1
    total = len(data) + 2 * n
    padded = np.full(total, 32, np.uint8)
    where = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1
    padded[where] = _FOLD[data]
    code = padded[:-2].astype(np.uint32) << 16 | padded[1:-1].astype(np.uint32) << 8 | padded[2:]
    code *= np.uint32(0x9E3779B1)
    keep = np.ones(total, bool)
    ends = offs[1:] + 2 * np.arange(1, n + 1)
    keep[ends - 1] = keep[ends - 2] = False
    return (code >> np.uint32(17)).astype(np.int32)[keep[:-2]], offs.copy()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages: embedding times weights, divided by the temperature
    bias: np.ndarray
    seen: np.ndarray  # buckets that training met
    min_score: float
    min_seen: float

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, share of known trigrams, rejected) of each text."""
        n, k = len(column), len(self.langs)
        logits, known = np.zeros((n, k)), np.zeros(n)
        data, offs = utf8_parts(column)
        for i, j in byte_slices(offs):
            own = offs[i : j + 1] - offs[i]
            size = np.maximum(np.diff(own), 1)
            if own[-1] > 2 * SLICE_BYTES and k:  # a long text in blocks, with a space around each
                for at in range(int(offs[i]), int(offs[j]), SLICE_BYTES):
                    part = data[at : min(at + SLICE_BYTES, int(offs[j]))]
                    bucket = trigram_buckets(part, np.array([0, len(part)]))[0]
                    logits[i] += [self.scores[:, c][bucket].sum(dtype=np.float64) for c in range(k)]
                    known[i] += self.seen[bucket].sum()
                logits[i] /= size[0]
                known[i] /= size[0]
                continue
            bucket, at = trigram_buckets(data[offs[i] : offs[j]], own)
            full = np.flatnonzero(np.diff(at))
            if len(full):
                for c in range(k):
                    logits[i + full, c] = np.add.reduceat(self.scores[:, c][bucket], at[full])
                known[i + full] = np.add.reduceat(self.seen[bucket], at[full], dtype=np.float64)
            logits[i:j] /= size[:, None]
            known[i:j] /= size
        logits = (logits + self.bias) if k else logits
        letters = np.array([t is not None and has_letter(t) for t in (x.as_py() for x in column)], bool)
        if not k:
            return ["und"] * n, np.zeros(n), known, np.ones(n, bool)
        e = np.exp(logits - logits.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        best = p.argmax(1)
        score = np.where(letters, p[np.arange(n), best], 0.0)
        rejected = ~letters | (score < self.min_score) | (known < self.min_seen)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())], score, known, rejected


def features(sample: DataFrame, sample_col: str = "text") -> DataFrame:
    """(lang, buckets, counts): trigram counts of each text; at most BUCKETS pairs, however long it is."""

    def run(batches):
        for b in batches:
            data, offs = utf8_parts(b.column(1))
            rows = []
            for i in range(len(offs) - 1):
                counts = np.zeros(BUCKETS, np.int64)
                for k in range(int(offs[i]), int(offs[i + 1]), 1 << 22):
                    end = min(int(offs[i + 1]), k + (1 << 22))
                    counts += np.bincount(trigram_buckets(data[k:end], np.array([0, end - k]))[0], minlength=BUCKETS)
                own = np.flatnonzero(counts)
                rows.append((own.astype(np.int32), counts[own].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["lang", "buckets", "counts"])

    return sample.select("lang", sample_col).mapInArrow(run, "lang string, buckets array<int>, counts array<float>")


def training_rows(docs: DataFrame, text_col: str, lang_col: str, total: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """(lang, text) of about `total` rows, evenly over languages."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), docs[id_col].alias("id")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, total // len(counts))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    return rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("lang")]).select("lang", "text")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", total: int = SAMPLE, id_col: str = "doc_id", epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Train on labelled rows (about `total` of them)."""
    rows = features(training_rows(docs, text_col, lang_col, total, id_col)).limit(2 * total).toArrow()
    rows = ((lang.as_py(), b.values.to_numpy().astype(np.int64), c.values.to_numpy().astype(np.float64)) for lang, b, c in zip(rows["lang"], rows["buckets"], rows["counts"]))
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist()))
    langs = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(BUCKETS, bool), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: max(1, len(rows) // 5)].tolist()) if len(rows) >= 10 else set()
    train = [i for i in order.tolist() if i not in held]
    y = np.array([langs.index(r[0]) for r in rows])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    weight = [r[2] / r[2].sum() for r in rows]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train).tolist():
            own, p = rows[i][1], weight[i]
            hidden = p @ emb[own]
            z = hidden @ w + bias
            grad = np.exp(z - z.max())
            grad /= grad.sum()
            grad[y[i]] -= 1
            back = w @ grad
            w -= step * np.outer(hidden, grad)
            bias -= step * grad
            emb[own] -= step * len(own) ** 0.5 * p[:, None] * back
    scores = emb @ w
    seen = np.zeros(BUCKETS, bool)
    for i in train:
        seen[rows[i][1]] = True
    test = sorted(held) or train
    z = np.array([weight[i] @ scores[rows[i][1]] + bias for i in test])

    def loss(t: float) -> float:
        e = z / t
        e = e - e.max(1, keepdims=True)
        return float((np.log(np.exp(e).sum(1)) - e[np.arange(len(test)), y[test]]).mean())

    temperature = min(np.geomspace(0.05, 5, 60).tolist(), key=loss)
    e = np.exp(z / temperature - (z / temperature).max(1, keepdims=True))
    top = (e / e.sum(1, keepdims=True)).max(1)
    known = np.array([weight[i] @ seen[rows[i][1]] for i in test])
    # a text may be shorter than all of the sample's, so both limits stay well below its tail
    return Model(langs, (scores / temperature).astype(np.float32), bias / temperature, seen, float(min(0.5, np.quantile(top, REJECT))), float(min(0.5, np.quantile(known, REJECT))))


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, known and rejected (columns of those names are replaced). Map-only."""
    names = [prefix + x for x in ("lang_pred", "score", "known", "rejected")]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, known, rejected = shared.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(known), pa.array(rejected)], [*b.schema.names, *names])
        give_back()

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


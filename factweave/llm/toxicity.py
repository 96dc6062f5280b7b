"""Toxicity by non-negative positive-unlabelled learning (operator 4).

A linear model over the presence of hashed words, all BUCKETS of them, is trained in numpy from confirmed toxic texts
and unlabelled texts. The risk of the unlabelled texts holds that of the hidden positives among them; the estimator
takes prior * (risk of positives as negatives) off it, and where the remainder falls below zero - which only
overfitting can bring about - the step goes against it instead (the non-negative estimator). The class prior is the
share of toxic rows among the labelled training rows.

A word enters with a size of log((met + PRIOR) / (expected + PRIOR)): how often confirmed texts hold it, against how
often they would if they held it like all texts, whose document frequencies Spark counts over every text that may be
learned from. So a word that a single confirmed text holds is small, and the penalty on its weight, which is on the
word's size times the weight's, keeps it from learning that text by heart; no word is left out.

Training takes POSITIVES confirmed and UNLABELLED other texts on average, chosen by a hash of their id, and never more
than twice as many; what comes to the driver are their distinct word buckets, and one count a bucket. Scoring is
map-only over whole texts.

Defined cases: null and empty texts get the score of no words; ties at 0.5 are predicted toxic; a table without
confirmed rows scores below 1e-20 everywhere; label rows without a document and null labels are ignored; an
id that is labelled both ways counts as toxic; repeated rows count each; other columns are kept; a long text is
counted slice by slice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, give_back, mix64, utf8_parts, word_hashes

BUCKETS = 1 << 18
POSITIVES, UNLABELLED = 4000, 9000
#: Words' counts among the confirmed texts that are worth as much as what is expected.
PRIOR = 3.0
STEPS, RATE, PENALTY = 150, 4.0, 3e-4


@dataclass
class Model:
    weight: np.ndarray  # one per bucket; zero for words that training didn't meet
    bias: float
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        data, offs = utf8_parts(column)
        z = np.full(len(column), self.bias)
        for i, j in byte_slices(offs):
            row, bucket = distinct_buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])  # a word counts once a text
            z[i:j] += np.bincount(row, self.weight[bucket], j - i)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def distinct_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct words of each row, by row."""
    h, row, _ = word_hashes(data, offs)
    key = np.unique(row * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64))
    return key // BUCKETS, key % BUCKETS


def word_sets(rows: DataFrame) -> DataFrame:
    """(toxic, words): the distinct word buckets of each text of (toxic, text)."""

    def run(batches):
        for b in batches:
            data, offs = utf8_parts(b.column(1))
            out: list[np.ndarray] = []
            for i, j in byte_slices(offs):
                row, bucket = distinct_buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                out += np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["toxic", "words"])
        give_back()

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, words array<int>")


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, and how many texts there are: one row a bucket comes to the driver."""

    def run(batches):
        held, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            data, offs = utf8_parts(b.column(0))
            n += b.num_rows
            for i, j in byte_slices(offs):
                held += np.bincount(distinct_buckets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1], minlength=BUCKETS)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1).astype(np.int32)), pa.array(np.append(held[own], n))], ["bucket", "n"])
        give_back()

    rows = docs.select(text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def _thinned(rows: DataFrame, most: int, id_col: str = "id") -> DataFrame:
    """About `most` rows, or all if they are fewer, chosen by a hash of their id."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1_000_003)) / 1_000_003.0 < most / n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on the labels' confirmed rows; docs are the texts that may be learned from, labels the rows."""
    own = labels.select(labels[label_id].alias("id"), labels[label_col].cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    stats = own.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).head()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    nothing = Model(np.zeros(BUCKETS), -50.0, 0.0)
    if not stats[0] or not stats[1]:
        return nothing
    prior = min(0.9, max(1e-3, stats[1] / stats[0]))
    known = F.broadcast(_thinned(own.where("toxic = 1").select("id"), positives).limit(2 * positives))
    confirmed = texts.join(known, "id", "left_semi").select(F.lit(1).alias("toxic"), "text")
    plain = _thinned(texts, unlabelled).select(F.lit(0).alias("toxic"), "text")
    pos, unl = (word_sets(x).limit(2 * most).toArrow()["words"].combine_chunks() for x, most in ((confirmed, positives), (plain, unlabelled)))
    if not len(pos) or not len(unl):
        return nothing
    held, n = document_frequencies(texts)
    return trained(pos, unl, held / max(1, n), prior)


def _flat(sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of lists of buckets, ordered by a hash of what they hold: the order of rows doesn't matter."""
    bucket = sets.flatten().to_numpy().astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    key, some = np.zeros(len(sets), np.uint64), np.flatnonzero(np.diff(offs))
    if len(some):
        key[some] = np.add.reduceat(mix64(bucket.astype(np.uint64)), offs[some])
    row = np.repeat(np.argsort(np.argsort(key, kind="stable"), kind="stable"), np.diff(offs))
    order = np.lexsort((bucket, row))
    return row[order], bucket[order]


def risk(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The corrected risk of scores z under the logistic loss, and the direction of a step by each text's score."""
    up, un = 1 / (1 + np.exp(-z_pos)), 1 / (1 + np.exp(-z_unl))
    as_positive = prior * np.logaddexp(0, -z_pos).mean()
    as_negative = np.logaddexp(0, z_unl).mean() - prior * np.logaddexp(0, z_pos).mean()
    if as_negative >= 0:
        return as_positive + as_negative, prior * (up - 1) / len(up) - prior * up / len(up), un / len(un)
    return as_positive, prior * up / len(up), -un / len(un)


def trained(pos: pa.ListArray, unl: pa.ListArray, share: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Descend the corrected risk plus the penalty, with momentum; share: of all texts that hold each bucket."""
    (rp, cp), (ru, cu) = _flat(pos), _flat(unl)
    met = np.bincount(cp, minlength=BUCKETS)
    size = np.log((met + PRIOR) / (share * len(pos) + PRIOR))
    used, both = np.unique(np.concatenate([cp, cu]), return_inverse=True)
    cp, cu, x = both[: len(cp)], both[len(cp) :], size[used]
    w, bias, speed, drift = np.zeros(len(used)), math.log(prior / (1 - prior)), np.zeros(len(used)), 0.0
    for _ in range(steps):
        ahead, front = w + 0.9 * speed, bias + 0.9 * drift
        v = ahead * x
        z_pos = np.clip(np.bincount(rp, v[cp], len(pos)) + front, -50, 50)
        z_unl = np.clip(np.bincount(ru, v[cu], len(unl)) + front, -50, 50)
        _, gp, gu = risk(z_pos, z_unl, prior)
        g = (np.bincount(cp, gp[rp], len(used)) + np.bincount(cu, gu[ru], len(used))) * x + penalty * ahead
        speed, drift = 0.9 * speed - rate * g, 0.9 * drift - rate * (gp.sum() + gu.sum())
        w, bias = w + speed, bias + drift
    weight = np.zeros(BUCKETS)
    weight[used] = w * x
    return Model(weight, float(bias), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a double column of toxicity scores (a column of that name is replaced). Map-only."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column(at)))], [*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))

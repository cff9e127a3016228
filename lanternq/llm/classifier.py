"""Quality classifier: Naive Bayes support vectors.

Features are indicators of the word and symbol unigrams and bigrams of a lower-cased text; a bigram
that repeats one token counts as one common feature. All features of the sample count: each is hashed
to one of ``BUCKETS`` numbers, and features that share a number count as one. The model is fitted on a
bounded sample of labelled rows: at most ``train_rows`` / 2 of each class, those with the least hash of
doc_id. Each indicator is scaled by its class log-count ratio, rows are brought to length one, and a
linear hinge-loss model with class weights is fitted by dual coordinate descent. A score is the logistic
of twice the margin, so 0.5 is the decision boundary.

Only the sample's feature numbers (at most ``train_rows`` rows of at most ``BUCKETS`` numbers) reach the
driver, and two arrays of ``BUCKETS`` numbers (16 MB) the tasks. Scoring sends each text to Python once
and shuffles nothing.

Defined results: null and empty texts have no features and get the model's constant, as do texts whose
features the sample lacks; very long texts are read whole; documents with conflicting labels count as
label 0; null labels are ignored; with a single class all rows get that class; without labels every score
is 0.5; rows without doc_id are not fitted on but scored; repeated rows get equal scores; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import text_or_empty, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
TRAIN_ROWS = 6000
BUCKETS = 1 << 21
ALPHA = 1.0
COST = 1.0
EPOCHS = 30
SEED = 11
#: Odd multipliers of the hash of a bigram, and the bigram that stands for all repetitions.
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_REPEATED = np.uint64(0x165667B19E3779F9)


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The numbers of the features of ``text``, sorted and distinct."""
    tokens = TOKEN.findall(text.lower())
    t = np.fromiter(map(zlib.crc32, map(_encoded, tokens)), np.uint64, len(tokens))
    a, b = t[:-1], t[1:]
    pairs = np.where(a == b, _REPEATED, (a + np.uint64(1)) * _FIRST ^ (b + np.uint64(1)) * _SECOND)
    mixed = np.concatenate([t * _FIRST, pairs * _SECOND])
    return np.unique((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _encoded(token: str) -> bytes:
    return token.encode("utf-8", "surrogatepass")


def log_count_ratios(good: np.ndarray, bad: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """The ratio of each feature that occurs; 0 for the others."""
    own = good + bad > 0
    p, q = good + alpha, bad + alpha
    return np.where(own, np.log(p / p[own].sum()) - np.log(q / q[own].sum()), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, epochs: int = EPOCHS, seed: int = SEED, eps: float = 0.01) -> np.ndarray:
    """Weights of the L1-loss support vector machine with sparse rows (feature numbers and values); the last
    weight belongs to a constant feature 1."""
    w, a = np.zeros(width + 1), np.zeros(len(rows))
    norms = np.array([v @ v for v in values]) + 1.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1
            projected = min(gradient, 0) if a[i] == 0 else max(gradient, 0) if a[i] == cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(a[i] - gradient / norms[i], 0.0), cost[i])
                step = (new - a[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                a[i] = new
        if worst < eps:
            break
    return w


@dataclass(frozen=True)
class Model:
    """For each feature number its share of the margin and its squared scale, and the constant."""

    share: np.ndarray
    square: np.ndarray
    constant: float

    def margin(self, text: str) -> float:
        own = features(text, len(self.share))
        square = float(self.square[own].sum(dtype=np.float64))
        return self.constant + (float(self.share[own].sum(dtype=np.float64)) / math.sqrt(square) if square else 0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, label: str, train_rows: int) -> DataFrame:
    """doc_id, y (0 or 1) and text of the bounded sample."""
    known = labels.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    halves = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2) for v in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # no more than train_rows rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(text_or_empty()).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Model:
    sample = training_sample(docs, labels, label, train_rows)

    def numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = [features(x.as_py(), buckets).astype(np.int32) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("y"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "y", "at"])

    got = written(sample.mapInArrow(numbered, "doc_id string, y int, at array<int>"), "classifier-sample")
    got = got.orderBy("doc_id").toArrow()  # no more than train_rows rows
    good = got.column("y").to_numpy() == 1
    empty = np.zeros(1, np.float32)
    if not good.any() or good.all():
        return Model(empty, empty, 0.0 if not len(good) else 5.0 if good[0] else -5.0)
    rows = [at.values.to_numpy().astype(np.int64) for at in got.column("at")]
    counted = lambda own: np.bincount(np.concatenate([r for r, o in zip(rows, own) if o]), minlength=buckets).astype(float)
    ratio = log_count_ratios(counted(good), counted(~good))
    values = [ratio[at] / max(float(np.linalg.norm(ratio[at])), 1e-12) for at in rows]
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, COST * len(y) / (2 * good.sum()), COST * len(y) / (2 * (~good).sum()))
    w = dual_coordinate_descent(rows, values, y, cost, buckets)
    return Model((w[:-1] * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(w[-1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of BUCKETS numbers

    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in it:
            text = batch.column("text")
            margins = [own.margin(text[i].as_py()) for i in range(len(text))]
            score = [round(1 / (1 + math.exp(-max(min(2 * m, 30), -30))), 9) for m in margins]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(scores, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return scored(docs, fit(docs, labels, **options))

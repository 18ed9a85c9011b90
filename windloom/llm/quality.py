"""Quality classifier: naive Bayes support vectors.

A document's features are indicators of its n-grams: byte trigrams as they stand, and word unigrams and bigrams with a
mark in place of a word that repeats the one before; all are hashed into 2**18 buckets.  Each indicator is scaled by its class
log-count ratio (the naive Bayes weight), vectors are brought to length one, and a linear hinge-loss model is fitted
by dual coordinate descent.  Margins become probabilities by a logistic curve fitted on rows that the model hasn't seen.

The fit is on at most ``MAX_TRAINING`` labelled rows with at most ``MAX_FEATURES`` features in all, those with the smallest
hash of doc_id (one row a doc_id): a stated bound on what the driver gathers.  Scoring covers every row and every whole text.  Defined cases: a null text counts as empty; an empty text
gets the score of no features; rows of ``labels`` with nulls are ignored, and of repeated ones the majority counts
(ties: 1); without both classes every score is the share of label 1 (0.5 without labels); repeated rows keep a row each;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.llm.common import slices, store, text_bytes

#: Hash buckets; labelled rows fitted on at most, and their features in all; share of them kept for the logistic curve; passes;
#: cost; smoothing.
BUCKETS, MAX_TRAINING, MAX_FEATURES, CALIBRATION, PASSES, COST, SMOOTH = 1 << 18, 6000, 16_000_000, 4, 12, 1.0, 1.0


def remainder(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % modulus


def sampled_labels(labels: DataFrame, target: str, modulus: int, held_out: int, limit: int | None) -> DataFrame:
    """``(doc_id, y)`` of labelled rows outside the held-out remainder: one row per doc_id, the majority of its labels;
    with ``limit`` only those with the smallest hash."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (remainder(modulus) != held_out))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) if limit else rows


def features(text: bytes) -> np.ndarray:
    """Distinct buckets of a text, ascending."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    parts = [((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(14)] if len(b) > 2 else []
    words = text.split()
    if words:
        w = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        w[1:][w[1:] == w[:-1]] = 1  # the mark of a repeated word
        parts += [(w * np.uint32(2246822519)) >> np.uint32(14), ((w[:-1] * np.uint32(3266489917)) ^ (w[1:] * np.uint32(668265263))) >> np.uint32(14)]
    return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, np.int64)


@dataclass
class Model:
    """``weight`` already includes the ratio; ``ratio`` gives the length; probability is the logistic of a margin."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt((self.ratio[found] ** 2).sum()))
        return (float(self.weight[found].sum()) / length if length else 0.0) + self.bias

    def score(self, text: bytes) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Logistic regression with an intercept (last) and a small ridge, by Newton's method with halved steps.

    The loss falls with every step taken, so the fit also ends, with finite slopes, where the classes are separable.
    """
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = np.array([1e-2] * (x.shape[1] - 1) + [1e-6])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * b * b).sum() / 2)

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        new = loss(beta + step)
        while not new <= now and np.abs(step).max() > 1e-10:
            step = step / 2
            new = loss(beta + step)
        if not new <= now:
            break
        beta, done, now = beta + step, np.abs(step).max() < 1e-8, new
        if done:
            break
    return beta


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights and bias (a constant feature)."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    length = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - g / length[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(p / (1 - p))))
    kept = np.arange(len(y)) % CALIBRATION == 0
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept = np.zeros(len(y), bool)
    train = np.flatnonzero(~kept)
    counts = np.full((2, BUCKETS), SMOOTH)
    for i in train:
        counts[y[i], rows[i]] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    ratio[counts.sum(axis=0) <= 2 * SMOOTH] = 0  # never seen
    ends = np.cumsum([0, *(len(rows[i]) for i in train)])
    held = np.empty(int(ends[-1]))
    values = [held[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    for v, i in zip(values, train, strict=True):
        v[:] = ratio[rows[i]]
        v /= max(float(np.sqrt(v @ v)), 1e-12)
    n = np.bincount(y[train], minlength=2)
    cost = COST * len(train) / (2 * n[y[train]])
    w, bias = descend([rows[i] for i in train], values, np.where(y[train] == 1, 1.0, -1.0), cost, BUCKETS)
    model = Model(ratio, w * ratio, bias, 1.0, 0.0)
    own = np.flatnonzero(kept) if kept.any() else train
    beta = logistic(np.array([[model.margin(rows[i])] for i in own]), y[own])
    model.slope, model.shift = float(beta[0]), float(beta[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", modulus: int = 5, held_out: int = 0) -> Model:
    """The model from the labelled rows of ``docs`` whose crc32(doc_id as text) mod ``modulus`` isn't ``held_out``."""
    chosen = sampled_labels(labels, target, modulus, held_out, MAX_TRAINING)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t).astype("<i4").tobytes() for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "found"])

    # One row a doc_id, in the order of its hash while the features fit: at most MAX_TRAINING small rows are ordered.
    found = rows.mapInArrow(run, "doc_id long, y int, found binary").groupBy("doc_id", "y").agg(F.min("found").alias("found"))
    found = store(found, "features").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    upto = F.sum(F.octet_length("found") / 4).over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = found.select("doc_id", "h", upto.alias("upto")).where(F.col("upto") <= MAX_FEATURES).select("doc_id")
    got = found.join(F.broadcast(taken), "doc_id", "left_semi").orderBy("h", "doc_id").select("y", "found").toArrow()  # whatever order tasks end in
    y = got.column("y").to_numpy().astype(np.int64)
    if not len(y):
        return fit_rows([], y)
    column = got.column("found").combine_chunks().cast(pa.large_binary())
    del got
    # The features of all rows lie in one buffer; each row is a view of it.
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    flat = np.frombuffer(column.buffers()[2] or b"", "<i4", offset=0)
    return fit_rows([flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], y)


def scored(docs: DataFrame, model: Model, modulus: int, held_out: int, threshold: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = np.array([shared.value.score(t) for t in text_bytes(batch)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    own = F.coalesce(remainder(modulus) == held_out, F.lit(False))
    return rows.select("doc_id", own.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, accept) -> DataFrame:
    """The rows of ``docs`` whose text ``accept`` takes, with all their columns."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([accept(t) for t in text_bytes(batch, at)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return kept(docs, lambda text: shared.value.score(text) >= threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, 5, 0, 0.3)


QUERIES = {"op3_quality": op3_quality}

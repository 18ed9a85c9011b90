"""Toxicity by maximum-scoring segments.

Tokens are maximal runs without white space, lower-cased, with ASCII punctuation stripped at both ends.  Each stands for
itself and for its prefixes of 4 to 8 characters, hashed into 2**20 buckets; a bucket's log-odds between toxic and clean
labelled documents are computed from the documents that hold it, under a Dirichlet prior with the proportions of both
together.  A token's score is the largest significant log-odds among its buckets; tokens without any weigh a little
against toxicity.  One linear pass over a text finds all maximal scoring segments.  Segment scores are calibrated by
extreme-value statistics of all documents: lambda solves sum p(token) exp(lambda score) = 1 over all their tokens, K comes
from the upper quartile of the documents' best segments (which the few toxic ones hardly move), and a segment of score S in
a text of n tokens has E-value K n exp(-lambda S).  A document's evidence is that of its best segment and the sum over its
significant segments; a logistic curve, fitted on labelled rows that gave no log-odds, turns it into a score from 0 to 1.

The texts are read twice: once for the labelled rows, which are stored, and once for scores and segments, which are stored
without the texts.  The fit is on at most ``MAX_TRAINING`` labelled rows (those with the smallest hash of doc_id, one row a
doc_id; a quarter of them is for the curve): a stated bound, so that the labels can meet the documents without moving texts.
Tables gathered on the driver have at most 2**20 rows.  Scoring covers every row and every whole text.
Defined cases: a null text counts as empty; a text without tokens has no evidence; rows of ``labels`` with nulls are
ignored, of repeated ones the majority counts (ties: 1); without both classes every score is the share of label 1 (0.5
without labels); repeated rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm.common import slices, store, text_bytes
from windloom.llm.quality import kept, logistic, remainder, sampled_labels

#: Hash buckets; weight of the prior in documents; significance (standard errors); the least log-odds and toxic documents
#: of a telling bucket; what other tokens weigh against; E-value of a significant segment; labelled rows at most, and the
#: share of them kept for the curve; quantile of best segments for K; remembered words.
BUCKETS, PRIOR, SIGNIFICANT, LEAST, MIN_DOCUMENTS, DRIFT, E_VALUE, MAX_TRAINING, APART, QUANTILE, MAX_WORDS = 1 << 20, 50.0, 2.5, 1.5, 3, 0.1, 0.05, 40_000, 4, 0.75, 300_000

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PREFIXES = range(4, 9)


def tokens(text: bytes) -> list[str]:
    return [w for x in text.decode("utf-8", "replace").lower().split() if (w := x.strip(PUNCTUATION))]


def buckets(word: str) -> list[int]:
    """The word's own bucket and those of its proper prefixes (marked, so that a word and a prefix differ)."""
    parts = [word, *("\x00" + word[:k] for k in PREFIXES if len(word) > k)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, end exclusive (linear time).

    Candidates are kept with the sums before and after them; only tokens with positive scores are visited.
    """
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    after = np.cumsum(score)
    right = after[at]
    left = right - score[at]
    found: list[list] = []  # start, end, sum before, sum after, index of the nearest candidate with a smaller sum before
    for start, low, high in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
        now = [start, start + 1, low, high, 0]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= now[3]:
                now[4] = j
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], 0]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    weight: np.ndarray  # by bucket: significant log-odds, else 0
    rate: float  # lambda
    constant: float  # K
    curve: np.ndarray

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        at = np.flatnonzero(self.weight)
        return {"at": at, "weight": self.weight[at], "rate": self.rate, "constant": self.constant, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        weight = np.zeros(BUCKETS)
        weight[state["at"]] = state["weight"]
        self.__init__(weight, state["rate"], state["constant"], state["curve"])

    def word_score(self, raw: str) -> float:
        """The score of a run of characters without white space; not a number if it is punctuation only."""
        v = self.known.get(raw)
        if v is None:
            word = raw.strip(PUNCTUATION)
            v = (float(self.weight[buckets(word)].max()) or -DRIFT) if word else float("nan")
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[raw] = v
        return v

    def token_scores(self, text: bytes) -> np.ndarray:
        words = text.decode("utf-8", "replace").lower().split()
        found = np.fromiter(map(self.word_score, words), np.float64, len(words))
        return found[~np.isnan(found)]

    def e_value(self, score: float, n: int) -> float:
        return float(self.constant * n * np.exp(-self.rate * score))

    def passages(self, text: bytes) -> list[tuple[int, int, float, float]]:
        """Significant passages: first and last token (exclusive), score and E-value."""
        s = self.token_scores(text)
        return [(a, b, v, e) for a, b, v in segments(s) if (e := self.e_value(v, len(s))) <= E_VALUE]

    def measure(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tokens and of the maximal segments."""
        s = self.token_scores(text)
        return s, np.array([v for _, _, v in segments(s)])

    def evidence(self, n: int, found: np.ndarray) -> tuple[float, float, int]:
        """Negative log10 of the best segment's p-value, log of the summed scores of significant segments, and their
        number, for ``n`` tokens and the segments' scores."""
        if not len(found):
            return 0.0, 0.0, 0
        e = self.constant * n * np.exp(-self.rate * found)
        telling = found[e <= E_VALUE]
        return float(-np.log10(max(-np.expm1(-e.min()), 1e-12))), float(np.log1p(self.rate * telling.sum())), len(telling)

    def judge(self, n: int, found: np.ndarray) -> tuple[float, int]:
        """The score and the number of significant passages."""
        a, b, passages = self.evidence(n, found)
        z = self.curve[0] * a + self.curve[1] * b + self.curve[2]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), passages

    def score(self, text: bytes) -> float:
        s, found = self.measure(text)
        return self.judge(len(s), found)[0]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Significant log-odds by bucket from the numbers of documents that hold it; 0 for the other buckets."""
    n = max(1, n_toxic + n_clean)
    prior = PRIOR * (toxic + clean + 0.01) / n
    a, b = toxic + prior, clean + prior
    odds = np.log(a / np.maximum(n_toxic + PRIOR - a, 0.5)) - np.log(b / np.maximum(n_clean + PRIOR - b, 0.5))
    telling = (odds / np.sqrt(1 / a + 1 / b) >= SIGNIFICANT) & (odds >= LEAST) & (toxic >= MIN_DOCUMENTS)
    return np.where(telling, odds, 0.0)


def decay_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """lambda: the positive root of sum p exp(lambda score) = 1, where ``counts`` clean tokens have each of ``scores``."""
    total = counts.sum()
    if not total or not (scores[counts > 0] > 0).any() or scores @ counts >= 0:
        return 1.0
    p = counts / total
    low, high = 1e-6, 1.0
    while p @ np.exp(np.minimum(high * scores, 600)) < 1 and high < 1000:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(np.minimum(mid * scores, 600)) < 1 else (low, mid)
    return (low + high) / 2


def count_buckets(rows: DataFrame, among: np.ndarray | None) -> np.ndarray:
    """Documents of ``rows(doc_id, text, ..)`` by bucket, and in all at the place ``BUCKETS``; with ``among`` (a flag for each
    bucket) only those buckets, else those with at least ``MIN_DOCUMENTS``."""
    shared = None if among is None else rows.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in slices(batches):
            for text in text_bytes(batch, 1):
                own = {k for w in set(tokens(text)) for k in buckets(w)}
                total[np.fromiter(own, np.int64, len(own))] += 1
            total[BUCKETS] += batch.num_rows
        if shared is not None:
            total[:-1][~shared.value] = 0
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    if among is None:
        sums = sums.where((F.col("n") >= MIN_DOCUMENTS) | (F.col("bucket") == BUCKETS))
    got = sums.toArrow()
    counts = np.zeros(BUCKETS + 1)
    counts[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return counts


def count_documents(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Toxic and clean documents of ``rows(doc_id, text, y)`` by bucket and in all.  Buckets that too few toxic documents
    hold can't be significant: clean documents are only counted for the others."""
    both = []
    among = None
    for y in (1, 0):
        counts = count_buckets(rows.where(F.col("y") == y).select("doc_id", "text"), among)
        among = counts[:-1] >= MIN_DOCUMENTS if among is None else among
        both.append(counts)
    return both[0][:-1] * among, both[1][:-1], int(both[0][-1]), int(both[1][-1])


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n, counts, found)`` per row: tokens, how many of them have each score (to a quarter), and the scores of the
    maximal segments."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, counts, found = [], [], []
            for text in text_bytes(batch):
                s, own = shared.value.measure(text)
                values, times = np.unique(np.rint(s * 4).astype(np.int32), return_counts=True)
                n.append(len(s))
                counts.append([{"quarters": v, "times": t} for v, t in zip(values.tolist(), times.tolist(), strict=True)])
                found.append(own)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(counts, _COUNTS), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "counts", "found"])

    schema = "doc_id long, n long, counts array<struct<quarters: int, times: long>>, found array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_COUNTS = pa.list_(pa.struct([("quarters", pa.int32()), ("times", pa.int64())]))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", modulus: int = 4, held_out: int = 2) -> Model:
    return fit_measured(docs, labels, target, modulus, held_out)[0]


def fit_measured(docs: DataFrame, labels: DataFrame, target: str = "toxic", modulus: int = 4, held_out: int = 2) -> tuple[Model, DataFrame]:
    """The model, and the stored measures of all rows of ``docs`` that it was calibrated on."""
    chosen = sampled_labels(labels, target, modulus, held_out, MAX_TRAINING)
    apart = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(APART)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most MAX_TRAINING rows
    rows = store(rows.withColumn("apart", apart), "labelled")
    model = Model(log_odds(*count_documents(rows.where("not apart"))), 1.0, 1.0, np.zeros(3))
    seen = store(measured(docs, model), "measured")
    model.rate = decay_rate(*token_counts(seen))
    at = F.lit(model.rate) * F.array_max("found") - F.log("n")
    x = seen.where("size(found) > 0").agg(F.percentile_approx(at, QUANTILE, 10_000).alias("x"), F.count(F.lit(1)).alias("n")).first()
    if x["n"]:
        # P(lambda S - ln n <= x) = exp(-K exp(-x)); texts without a segment lie below.
        share = 1 - (1 - QUANTILE) * x["n"] / seen.where("n > 0").count()
        model.constant = float(np.exp(np.clip(x["x"] + np.log(-np.log(share)), -20, 5)))
    shown = rows.where("apart").select("doc_id", "text", "y")
    got = judged_evidence(shown, model).toArrow()  # at most MAX_TRAINING rows of four numbers
    table = np.column_stack([got.column(c).to_numpy().astype(np.float64) for c in ("doc_id", "y", "a", "b")])
    table = table[np.lexsort(table.T[::-1])]
    y = table[:, 1]
    if not len(y) or y.min() == y.max():
        share = rows.agg(F.avg("y").alias("p")).first()["p"]
        p = float(np.clip(share, 1e-3, 1 - 1e-3)) if share is not None else 0.5
        model.curve = np.array([0.0, 0.0, np.log(p / (1 - p))])
    else:
        model.curve = rising_curve(table[:, 2:4], y)
    return model, seen


def rising_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression in which more evidence never speaks against toxicity: while a slope is negative, the feature with the
    smallest is left out (its slope is 0)."""
    keep = list(range(x.shape[1]))
    while True:
        fitted = logistic(x[:, keep], y)
        if len(keep) == 1 or (fitted[:-1] >= 0).all():
            break
        keep.pop(int(np.argmin(fitted[:-1])))
    out = np.zeros(x.shape[1] + 1)
    out[keep], out[-1] = np.maximum(fitted[:-1], 0), fitted[-1]
    return out


def judged_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, y, a, b)``: the evidence of each of ``rows(doc_id, text, y)``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shared.value.evidence(len(s), found)[:2] for s, found in map(shared.value.measure, text_bytes(batch, 1))]
            made = np.array(made, np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], ["doc_id", "y", "a", "b"])

    return rows.mapInArrow(run, "doc_id long, y int, a double, b double")


def token_counts(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token scores (to a quarter) and how many tokens of all documents have them: some dozen rows."""
    got = seen.select(F.explode("counts").alias("c")).groupBy("c.quarters").agg(F.sum("c.times").alias("n")).orderBy("quarters").toArrow()
    score, n = got.column("quarters").to_numpy().astype(np.float64) / 4, got.column("n").to_numpy().astype(np.float64)
    return np.where(score <= 0, -DRIFT, score), n


def judged(seen: DataFrame, model: Model, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted, passages)`` per row of ``seen``; ``passages`` counts significant segments."""
    small = Model(np.zeros(0), model.rate, model.constant, model.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column(2), batch.column(1).to_pylist()
            per, flat = np.cumsum(np.r_[0, found.value_lengths().to_numpy()]), found.flatten().to_numpy()
            made = [small.judge(k, flat[a:b]) for k, a, b in zip(n, per, per[1:], strict=False)]
            score, passages = pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score, passages], ["doc_id", "score", "passages"])

    rows = seen.select("doc_id", "n", "found").mapInArrow(run, "doc_id long, score double, passages long")
    own = F.coalesce(remainder(modulus) == held_out, F.lit(False))
    return rows.select("doc_id", own.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def scored(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """``judged`` of any documents."""
    return judged(measured(docs, model), model, modulus, held_out, threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    model, seen = fit_measured(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(seen, model)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return kept(docs, lambda text: shared.value.score(text) < threshold)


QUERIES = {"op8_toxicity": op8_toxicity}

"""Target-distribution importance resampling: documents drawn by how much their n-grams look like a target's.

Words and their runs are hashed into buckets; a bucket's gain is the rounded-down log of its share among the target's
features over its share among the corpus's.  A document's weight is the mean gain of its features, its score the weight plus
Gumbel noise that depends on the seed and doc_id alone, and the highest scores are drawn: sampling without
replacement in proportion to the exponentials of the weights.

The buckets of every document are stored once as an array of 16- or 32-bit numbers.  Counts are summed per task before they are
shuffled; the table of gains, as long as ``buckets``, scores those arrays.  Scores are whole numbers, so ranks need no sort of
the documents: a histogram of scores is summed from the top, which gives the number of documents above each score and the
score where the drawing ends; only within the scores that survive are rows numbered by doc_id.

Defined cases: a null text has no words; a document without features has weight 0; one with fewer than ``least_words`` words
has a score and is never drawn; a null doc_id hashes as the empty string and stands behind others of its score; repeated rows
are documents of their own, in the order of their storage; nulls in the target count as empty; empty tables give an empty
result, an empty target gives gains from the corpus alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.llm.common import slices, store, text_bytes

#: Hash buckets; the longest run of words; per cent drawn; seed of the noise; words that a document needs to be drawn.
BUCKETS, LONGEST_RUN, PER_CENT, SEED, LEAST_WORDS = 10_000, 1, 10, 2024, 20
#: Scores in one step of the two-step sums over the histogram.
SCORE_STEP = 256


def _word_bytes() -> bytes:
    """What each byte of a text becomes: letters (A-Z in lower case), digits and bytes from 0x80 on stay, others part words."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[b] = b
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[b] = b + 32
    return bytes(table)


_KEPT = _word_bytes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def run_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` consecutive words, repeats included."""
    hashes = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    for n in range(2, min(longest, len(words)) + 1):
        hashes.append(np.fromiter((zlib.crc32(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)), np.uint32, len(words) - n + 1))
    return np.concatenate(hashes) % np.uint32(buckets)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Noise in thousandths, from the first 32 bits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``(doc_id, n_words, n_features, found)`` of ``texts(doc_id, text)``; ``found``: the features' buckets."""
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, found = [], []
            for text in text_bytes(batch):
                words = words_of(text)
                n_words.append(len(words))
                found.append(run_buckets(words, longest, buckets).astype(width).tobytes())
            n = [len(x) // int(width[2]) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_words", "n_features", "found"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, found binary")


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, n)`` of the features in ``found``; a task adds its own up first."""
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    return found.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket from ``(bucket, n)`` of the corpus and of the target: tables no longer than ``buckets``."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.collect():
            into[r.bucket] = r.n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def scored(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every row of ``hashed``."""
    width = _width(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            weight = []
            for x in batch.column(3).to_pylist():
                own = np.frombuffer(x, width)
                weight.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            score = [w + gumbel(d, seed) for w, d in zip(weight, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return found.select("doc_id", "n_words", "n_features", "found").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def score_offsets(scores: DataFrame) -> DataFrame:
    """``(score, above, held)``: how many of ``scores(score)`` lie above each score that occurs, and how many have it.

    Whole scores are logarithms in thousandths: at most some 120,000 of them can occur, whatever the number of rows.
    """
    held = scores.groupBy("score").agg(F.count("*").alias("held")).withColumn("step", F.expr(f"score div {SCORE_STEP}"))
    steps = held.groupBy("step").agg(F.sum("held").alias("in_step"))
    higher = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("step", F.coalesce(F.sum("in_step").over(higher), F.lit(0)).alias("over"))
    inside = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    own = held.withColumn("own", F.coalesce(F.sum("held").over(inside), F.lit(0)))
    return own.join(steps, "step").select("score", (F.col("over") + F.col("own")).alias("above"), "held")


def resample(
    docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED, least_words: int = LEAST_WORDS
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs(doc_id, text)``: rank 1, 2, 3... of the drawn
    ``per_cent`` of the documents with ``least_words`` words, by likeness to ``target(text)``; null for the others."""
    if buckets < 1 or longest < 1 or not 0 <= per_cent <= 100:
        raise ValueError("buckets and runs start at 1, the share drawn lies between 0 and 100 per cent")
    found = store(hashed(docs, buckets, longest), "buckets")
    wanted = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)
    rows = store(scored(found, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    offsets = store(score_offsets(rows.where(able).select("score")), "offsets")
    drawn = offsets.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n")).first().n * per_cent // 100
    survive = offsets.where(F.col("above") < drawn).select("score", "above")  # the scores from the cutoff on
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    high = rows.where(able).join(F.broadcast(survive), "score").withColumn("rank", (F.col("above") + F.row_number().over(within)).cast("long"))
    high = high.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    low = rows.join(F.broadcast(survive.withColumn("high", F.lit(True))), "score", "left").where(F.col("high").isNull() | ~able).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return high.select(*names).unionByName(low.select(*names))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by likeness to the benchmark's texts."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_resampling": op11_resampling}

ORACLES = {
    "op11_resampling": r"""
with recursive step(i, c, k) as (
  select range, range, 0 from range(256)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8
),
crc as (select list(c order by i) as entries from step where k = 8),
doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
),
wanted as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark
),
held as (select doc_id, unnest(words) as w from doc),
counted as (
  select w, sum(s)::bigint as s, sum(t)::bigint as t
  from (select w, count(*) as s, 0 as t from held group by w union all select w, 0, count(*) from wanted group by w) group by w
),
bucketed as (
  select w, s, t, xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::int, 2))::bigint)),
      lambda c, b: xor(c >> 8, crc.entries[(xor(c, b) & 255) + 1]))) % 10000 as bucket
  from counted, crc
),
of_bucket as (select bucket, sum(s)::bigint as s, sum(t)::bigint as t from bucketed group by bucket),
whole as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from of_bucket),
gain as (
  select bucket, floor(1000 * ln((b.t + 1)::double * (whole.s + 10000) / ((b.s + 1)::double * (whole.t + 10000))))::bigint as gain from of_bucket b, whole
),
of_doc as (
  select doc_id, count(*)::bigint as n, sum(gain)::bigint as g from held join bucketed using (w) join gain using (bucket) group by doc_id
),
weighed as (
  select d.doc_id, coalesce(n, 0) as n_features, case when n > 0 then (g - ((g % n) + n) % n) // n else 0 end as weight,
    ('0x' || substr(sha256('2024:' || d.doc_id::varchar), 1, 8))::bigint as h
  from doc d left join of_doc using (doc_id)
),
final as (
  select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from weighed
),
able as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from final where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * able.n // 100 then rank end as rank from final left join able using (doc_id)
""",
}

"""Sharding by minimax contiguous partition, in DataFrame operations only.

Groups of equal texts are atomic.  They are ordered by the SHA-256 of their text, and the smallest capacity with which a
greedy pass over that order needs no more than ``shards`` shards is found by binary search; the greedy cuts at that
capacity are the shards.

The order is never brought to one place.  The driver holds exact prefix sums at a bounded set of points: first the sums
of 65,536 ranges of the hash, then, in a few rounds, those of finer ranges around the places where a cut may still
fall.  On such a table a greedy pass that may cut anywhere gives a lower bound of the capacity, and one that cuts only
between ranges an upper bound; both are found by binary search, and ranges between them are refined until the bounds
meet and every cut falls between two groups.  A range of one group counts as indivisible.

Law ``bytes``: no shard is heavier than the smallest possible maximum for this order.  Defined cases: a null text has
size 1 and the CRC of no bytes, and groups with empty texts; repeated rows each keep a place; a group heavier than a
fair share stands alone or with what fits beside it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.llm.common import store

#: Hex digits of the hash in the first table of ranges, and those added in each round.
FIRST_DIGITS, MORE_DIGITS, MOST_DIGITS = 4, 2, 64
#: Rows that a part of a shard should have, and parts at most: slots are numbered within parts.
PART_ROWS, MOST_PARTS = 100_000, 4096


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, h)`` per row; ``h`` is the SHA-256 of the text in hex."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("h"),
    )


class _Ranges:
    """Ranges of the hash in order: lowest prefix, bytes, and whether more than one group is inside."""

    def __init__(self, rows: list[tuple[str, int, bool]]) -> None:
        rows = sorted(rows)
        self.first = [r[0] for r in rows]
        self.many = [r[2] for r in rows]
        self.end = [0]
        for r in rows:
            self.end.append(self.end[-1] + r[1])

    def cut(self, start: float, capacity: int, anywhere: bool) -> tuple[float, int]:
        """The furthest end of a shard that begins at ``start``, and the range in which it lies."""
        target = start + capacity
        if target >= self.end[-1]:
            return self.end[-1], len(self.first)
        k = bisect_right(self.end, target) - 1
        return (target if anywhere and self.many[k] else self.end[k]), k

    def feasible(self, capacity: int, shards: int, anywhere: bool) -> bool:
        at = 0
        for _ in range(shards):
            new, _k = self.cut(at, capacity, anywhere)
            if new == self.end[-1]:
                return True
            if new <= at:
                return False
            at = new
        return False

    def least(self, shards: int, anywhere: bool) -> int:
        low, high = -(-self.end[-1] // shards), self.end[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, shards, anywhere) else (mid + 1, high)
        return low

    def open_ranges(self, low: int, high: int, shards: int) -> set[int]:
        """Ranges of several groups in which a cut may fall for a capacity between the bounds."""
        near, far, found = 0, 0, set()
        for _ in range(shards):
            new, j = self.cut(near, low, False)
            far, k = self.cut(far, high, True)
            near = max(near, new)
            found |= {i for i in range(j, min(k, len(self.first) - 1) + 1) if self.many[i]}
        return found


def minimax_cuts(rows: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity and the first hashes of shards 1, 2, ... for ``rows(size, h)``; fewer cuts if fewer shards
    are needed."""

    def ranges(part: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
        sums = part.groupBy(F.substring("h", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), (F.min("h") != F.max("h")).alias("many"))
        return [(r["prefix"], r["size"], r["many"]) for r in sums.collect()]

    known, digits = ranges(rows, FIRST_DIGITS), FIRST_DIGITS
    if not known:
        return 0, []
    while True:
        table = _Ranges(known)
        low, high = table.least(shards, True), table.least(shards, False)
        finer = [table.first[k] for k in sorted(table.open_ranges(low, high, shards)) if len(table.first[k]) < MOST_DIGITS]
        if not finer:
            break
        width = min(len(p) for p in finer)
        finer = [p for p in finer if len(p) == width]
        digits = width + MORE_DIGITS
        inner = rows.where(F.substring("h", 1, width).isin(finer))
        known = [r for r in known if r[0] not in set(finer)] + ranges(inner, digits)
    cuts, at = [], 0
    for _ in range(shards):
        at, k = table.cut(at, high, False)
        if k >= len(table.first):
            break
        cuts.append(table.first[k])
    return high, cuts


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs(doc_id, text)``.

    Slots number the rows of a shard from 0 without gaps: rows fall into parts of a shard by a hash of their own, are numbered
    within the part, and move up by the rows of the parts before; there are more parts the more rows there are, and that table
    has at most ``MOST_PARTS`` rows a shard.
    """
    rows = store(sized(docs), "sized")
    parts = min(MOST_PARTS, max(1, -(-rows.count() // (shards * PART_ROWS))))
    _, cuts = minimax_cuts(rows, shards)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("h") >= F.lit(cut)).cast("int")
    part = F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", number.alias("shard"), part.alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("k", within).join(F.broadcast(offsets), ["shard", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards, law ``bytes``."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_minimax_shards": op4_minimax_shards}

"""Status intervals: unions, causes and alarm statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(events: DataFrame, groups: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Disjoint intervals per group; overlapping and touching ones are merged, those without an end are left out."""
    w = Window.partitionBy(*groups).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.withColumn("__new", F.coalesce(F.col(start) > seen, F.lit(True)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*groups, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("events")).drop("__island")


def downtime(events: DataFrame, groups: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Hours per group, overlaps counted once, with events and outages."""
    return merged(events, groups, start, end).groupBy(*groups).agg((F.sum(F.col(end) - F.col(start)) / 3600).alias("hours"), F.sum("events").alias("events"), F.count(F.lit(1)).alias("outages"))


def top_causes(events: DataFrame, groups: list[str], k: int = 3, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Per group the k messages with the most hours: count, sum and longest."""
    # Whole seconds are summed, so that equal sums are equal in any order of the rows.
    seconds = F.col(end) - F.col(start)
    causes = events.groupBy(*groups, "message").agg(F.count(F.lit(1)).alias("n"), (F.sum(seconds) / 3600).alias("hours"), (F.max(seconds) / 3600).alias("longest"))
    w = Window.partitionBy(*groups).orderBy(F.desc("hours"), "message")
    return causes.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def latest(events: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """The last row of each group (one row a group is kept before the shuffle)."""
    row = F.struct(*order, *[c for c in events.columns if c not in [*order, *groups]])
    return events.groupBy(*groups).agg(F.max(row).alias("__r")).select(*groups, "__r.*")


def significant(events: DataFrame, statuses: list[str], least_s: int = 3600, k: int = 60) -> DataFrame:
    """The k longest events of the given statuses that last at least ``least_s``."""
    d = F.col("end_s") - F.col("start_s")
    return events.withColumn("duration_s", d).where(F.col("message").isin(statuses) & (d >= least_s)).orderBy(F.desc("duration_s"), "event_id").limit(k)


def in_windows(rows: DataFrame, windows: DataFrame, key: str, at: str, width: int = 86_400) -> DataFrame:
    """Rows whose ``at`` lies within a window of the same key (both ends included).

    Windows are laid out over slots of ``width``, and rows meet only the windows of their own slot: a key with many rows and many
    windows isn't joined each with each.
    """
    slot = lambda c: F.floor(F.col(c) / width)
    laid = windows.withColumn("__slot", F.explode(F.sequence(slot("window_start"), F.greatest(slot("window_start"), slot("window_end")))))
    joined = rows.withColumn("__slot", slot(at)).join(laid, [key, "__slot"]).drop("__slot")
    return joined.where(F.col(at).between(F.col("window_start"), F.col("window_end")))

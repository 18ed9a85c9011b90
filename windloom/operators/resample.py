"""Calendar resampling with coverage gates, spines, gap filling and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.functions.wind import clip_low


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Left edge of the ``minutes``-long slot."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / (60 * minutes)) * (60 * minutes))


def turbine_hourly(readings: DataFrame, both_channels: bool = False) -> DataFrame:
    """Hourly mean per turbine of ``readings(turbine, ts, wind, power)``; ``both_channels``: only rows with both."""
    if both_channels:
        readings = readings.na.drop(subset=["wind", "power"])
    hour = F.date_trunc("HOUR", F.col("ts").cast("timestamp"))
    return readings.groupBy("turbine", hour.alias("hour")).agg(F.avg("wind").alias("wind"), F.avg("power").alias("power"), F.count(F.lit(1)).alias("n"))


def farm_hourly(readings: DataFrame, turbines: int, least: int = 1, scale: str = "sum", clip_first: bool = False, least_rows: int = 1) -> DataFrame:
    """Farm output per hour from the turbines' hourly means.

    ``scale``: ``sum`` of the turbines, or ``mean`` of them times ``turbines`` (for farms where some may not report); an
    hour counts if at least ``least`` turbines report.  ``clip_first`` clips negative power before averaging, else after;
    ``least_rows``: readings that a turbine needs in the hour.
    """
    power = clip_low(F.col("power")) if clip_first else F.col("power")
    hour = F.date_trunc("HOUR", F.col("ts").cast("timestamp"))
    means = readings.groupBy("turbine", hour.alias("hour")).agg(F.avg(power).alias("power"), F.count("power").alias("n")).where(F.col("n") >= least_rows)
    farm = means.groupBy("hour").agg(F.sum("power").alias("total"), F.avg("power").alias("mean"), F.count("power").alias("reporting"))
    output = F.col("total") if scale == "sum" else F.col("mean") * turbines
    return farm.where(F.col("reporting") >= least).select("hour", "reporting", (clip_low(output) / 1000).alias("output_mw"))


def spine(first: Column, last: Column, step: int = 1) -> Column:
    return F.explode(F.sequence(first, last, F.lit(step).cast("long")))


def on_spine(series: DataFrame, key: str, step: int = 1) -> DataFrame:
    """``series`` on the complete calendar from its first to its last integer ``key``; missing rows are NULL."""
    ends = series.agg(F.min(key).alias("first"), F.max(key).alias("last"))
    return ends.select(spine(F.col("first"), F.col("last"), step).alias(key)).join(series, key, "left")


#: Keys of a part of a series without groups.
PART_KEYS = 100_000


def fill_gaps(series: DataFrame, key: str, value: str, limit: int, groups: list[str] | None = None) -> DataFrame:
    """Linear interpolation inside gaps of a series on a complete calendar: of each gap the first ``limit`` rows.

    A series without groups is cut into parts of its integer key; a part's first and last known values are handed to its
    neighbours (one row a part), so no task sorts the whole series.
    """
    rows = series.withColumn("__part", F.lit(0) if groups else F.floor(F.col(key) / PART_KEYS))
    keys = [*(groups or []), "__part"]
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(key).alias("k"), F.col(value).alias("v")))
    past = Window.partitionBy(*keys).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(key).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"__past": F.last(at, True).over(past), "__ahead": F.first(at, True).over(ahead)})
    if not groups:
        ends = series.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(key) / PART_KEYS).alias("__part")).agg(F.min(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).alias("__lo"), F.max(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).alias("__hi"))
        every = rows.select("__part").distinct().join(ends, "__part", "left")  # one row a part
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
        every = every.select("__part", F.last("__hi", True).over(before).alias("__before"), F.first("__lo", True).over(after).alias("__after"))
        rows = rows.join(every, "__part").withColumns({"__past": F.coalesce("__past", "__before"), "__ahead": F.coalesce("__ahead", "__after")}).drop("__before", "__after")
    inside = F.col("__past").isNotNull() & F.col("__ahead").isNotNull() & (F.col(key) - F.col("__past.k") <= limit)
    slope = F.try_divide(F.col("__ahead.v") - F.col("__past.v"), (F.col("__ahead.k") - F.col("__past.k")).cast("double"))
    made = F.col("__past.v") + slope * (F.col(key) - F.col("__past.k"))
    return rows.withColumn(f"{value}_filled", F.coalesce(F.col(value), F.when(inside, made))).select(*series.columns, f"{value}_filled")


def counter_increments(series: DataFrame, key: str, value: str, most: float, groups: list[str] | None = None) -> DataFrame:
    """Increments of a cumulative counter; resets (negative) and jumps above ``most`` are NULL."""
    from windloom.operators.forecasting import lag_features

    step = F.col(value) - F.col("lag_1")
    return lag_features(series, key, value, (1,), groups).withColumn("increment", F.when(step.between(0, most), step)).drop("lag_1")


def missing_hours(series: DataFrame, key: str) -> DataFrame:
    """Expected less present keys between the first and the last."""
    return on_spine(series.select(key), key).join(series.select(key), key, "left_anti")


def air_density_on(rows: DataFrame, weather: DataFrame) -> DataFrame:
    """Rows with the hour's air density where the weather has it."""
    from windloom.functions.wind import air_density

    density = weather.select(F.col("hour"), air_density(F.col("temperature_c"), F.col("pressure_hpa")).alias("density"))
    return rows.join(density, "hour", "left")

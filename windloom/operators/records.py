"""Production records: peaks and best periods with a coverage gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE = 0.95


def farm_steps(readings: DataFrame) -> DataFrame:
    """Farm sum, reporting turbines and energy per ten-minute step of ``readings(turbine, ts, power)``."""
    return readings.where("power is not null").groupBy("ts").agg(F.sum("power").alias("total"), F.count(F.lit(1)).alias("reporting")).withColumn("mwh", F.col("total") / 6000)


def peaks(readings: DataFrame) -> DataFrame:
    """The largest farm output and when (ties: the earliest), the largest single reading and whose."""
    farm = farm_steps(readings).agg(F.max(F.struct("total", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "ts", "reporting")).alias("m"))
    one = readings.where("power is not null").agg(F.max(F.struct("power", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), F.col("turbine"))).alias("o"))
    return farm.join(one).select(F.col("m.total").alias("farm_kw"), F.col("m.ts").alias("farm_at"), F.col("m.reporting").alias("reporting"), F.col("o.power").alias("turbine_kw"), F.col("o.turbine").alias("turbine"))


def periods(readings: DataFrame, unit: str, turbines: int) -> DataFrame:
    """Energy and coverage of every calendar ``unit`` (DAY, MONTH, YEAR): readings against those of the full calendar."""
    start = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    sums = farm_steps(readings).groupBy(start.alias("start")).agg(F.sum("mwh").alias("mwh"), F.sum("reporting").alias("readings"))
    length = {"DAY": F.expr("start + interval 1 day"), "MONTH": F.expr("start + interval 1 month"), "YEAR": F.expr("start + interval 1 year")}[unit]
    expected = (F.unix_timestamp(length) - F.unix_timestamp("start")) / 600 * turbines
    return sums.withColumn("coverage", F.col("readings") / expected)


def best_period(readings: DataFrame, unit: str, turbines: int, coverage: float = MIN_COVERAGE) -> DataFrame:
    """The fully covered period with the most energy (none: no row; ties: the earliest)."""
    return periods(readings, unit, turbines).where(F.col("coverage") >= coverage).orderBy(F.desc("mwh"), "start").limit(1)

"""The driver's tables seen as sensor data: projections that the queries run on, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.session import table

#: Rated power (kW) and rotor diameter (m) that the projections stand for.
RATED_KW, ROTOR_M = 2050.0, 82.0


def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute readings: turbine = user, wind = value / 10, power and direction from props.k."""
    return reading_of(table(spark, sf_dir, "events"))


def reading_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        "event_id", F.col("user_id").alias("turbine"), "ts", (F.col("value") / 10).alias("wind"), (k * 20.5).alias("power"), (k * 3.6).alias("direction"), "event_type", "value"
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered signals: turbine = supplier, wind = quantity / 2, power = price / 50."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("turbine"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_quantity") / 2).alias("wind"), (F.col("l_extendedprice") / 50).alias("power"),
    )


#: Full order of a turbine's signal rows (rows that tie in all of them are the same).
SIGNAL_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "wind", "power"]


def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status intervals: start = ts in whole seconds, length = value minutes in whole seconds."""
    seconds = F.round(F.col("value") * 60).cast("long")
    start = F.date_trunc("SECOND", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("turbine"), F.unix_timestamp(start).alias("start_s"), (F.unix_timestamp(start) + seconds).alias("end_s"), F.col("event_type").alias("message")
    )


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("turbine"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 400.0).alias("y"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of all events: (hour number since 1970, output)."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, sf_dir, "events").groupBy(hour.alias("h")).agg(F.avg("value").alias("output"))


#: Common table expressions of the same projections.
SQL = {
    "v_reading": """v_reading as (select event_id, user_id as turbine, ts, value / 10 as wind, cast(props->>'$.k' as double) * 20.5 as power,
  cast(props->>'$.k' as double) * 3.6 as direction, event_type, value from events)""",
    "v_signal": """v_signal as (select l_suppkey as turbine, l_shipdate as ts, l_orderkey, l_linenumber, l_partkey, l_quantity / 2 as wind,
  l_extendedprice / 50 as power from lineitem)""",
    "v_interval": """v_interval as (select event_id, user_id as turbine, epoch(date_trunc('second', ts))::bigint as start_s,
  epoch(date_trunc('second', ts))::bigint + round(value * 60)::bigint as end_s, event_type as message from events)""",
    "v_layout": "v_layout as (select s_suppkey as turbine, s_acctbal as x, s_nationkey * 400.0::double as y from supplier)",
    "v_hourly": "v_hourly as (select floor(epoch(date_trunc('second', ts)) / 3600)::bigint as h, avg(value) as output from events group by 1)",
}


def ctes(*names: str) -> str:
    return "with recursive " + ",\n".join(SQL[n] for n in names)

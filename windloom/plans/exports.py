"""The tables written as the exports that farms deliver, and read back by the readers of those exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.resample import floor_minutes
from windloom.plans.relational import rounded
from windloom.plans.views import ctes, reading
from windloom.session import shared_folder, table
from windloom.sources import scada, zipped


def _second() -> Column:
    return F.date_trunc("SECOND", F.col("ts").cast("timestamp")).cast("timestamp_ntz")


def _written(rows: DataFrame, name: str, **options) -> str:
    path = shared_folder(rows.sparkSession, name)
    rows.write.options(header=True, **options).csv(path)
    return path


def zipped_turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as zipped exports with comment lines above the header, read as a data source: a member each part of a turbine."""
    path = zipped.write_exports(reading(spark, sf_dir).select("turbine", _second().alias("ts"), "wind", "power"), "zips")
    rows = zipped.zipped_exports(spark, f"{path}/*.zip", {"ts": "Date and time", "wind": "Wind speed (m/s)", "power": "Power (kW)"})
    out = rows.groupBy("turbine").agg(F.count(F.lit(1)).alias("n"), F.avg("wind").alias("wind"), F.avg("power").alias("power"), F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last"))
    return rounded(out, wind=6, power=5)


def exported_historian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a signal with station numbers and times in two formats; stations without a turbine fall out."""
    rows = reading(spark, sf_dir).select("event_id", F.col("turbine").alias("StationId"), floor_minutes(F.col("ts"), 1).cast("timestamp").alias("t"), "wind", "power")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("t", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("t", "dd/MM/yyyy HH:mm"))
    path = _written(rows.select(text.alias("TimeStamp"), "StationId", "wind", "power"), "historian")
    stations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("StationId"), F.col("s_name").alias("turbine"))
    back = scada.historian(spark, path, stations)
    return rounded(back.groupBy("turbine", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("minute")).agg(F.avg("wind").alias("wind"), F.sum("power").alias("power"), F.count(F.lit(1)).alias("n")), wind=6, power=5)


def exported_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped tables with a column for each turbine and channel: event types as turbines, ten-minute means."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = reading(spark, sf_dir).groupBy(floor_minutes(F.col("ts"), 10).alias("t"))
    one = lambda k, c: F.avg(F.when(F.col("event_type") == k, F.col(c)))
    wide = rows.agg(*[one(k, c).alias(f"{form}{k}") for k in kinds for form, c in (("p", "power"), ("w", "wind"))])
    path = _written(wide.withColumn("timestamp", F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).drop("t"), "wide", compression="gzip")
    head = spark.read.csv(path, header=True).columns  # the readers' schema stands in the order of the file
    channels = [c for c in head if c != "timestamp"]
    raw = spark.read.schema(", ".join(f"`{c}` {'string' if c == 'timestamp' else 'double'}" for c in head)).csv(path, header=True)
    out = scada.long_form(raw.select("timestamp", *channels), kinds, "p{}", "w{}", F.try_to_timestamp("timestamp").cast("timestamp_ntz"))
    return rounded(out.where("power is not null").select("turbine", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("slot"), "wind", "power"), wind=6, power=5)


def exported_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled case, semicolons and a column a sensor, in long form."""
    rows = table(spark, sf_dir, "events").select(
        F.date_format(_second().cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("time_stamp"), F.col("user_id").alias("asset_id"), F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 5 < 4, "train").otherwise("prediction").alias("train_test"), (F.col("event_id") % 3).alias("status_type_id"),
        F.col("value").alias("sensor_1_avg"), F.when(F.col("event_id") % 7 > 0, F.get_json_object("props", "$.k")).alias("sensor_2_avg"),
    )
    out = scada.fault_case(spark, _written(rows, "case", sep=";"))
    own = out.groupBy("part", "status_type_id", "sensor").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("there"), F.avg("value").alias("mean"), F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last"))
    return rounded(own, mean=3)


def exported_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export without times: sequence numbers, and lines that are empty."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Sequence No."), F.col("l_quantity").alias("V"), F.col("l_extendedprice").alias("D"), F.col("l_discount").alias("air density"), F.col("l_tax").alias("S_a"),
        F.col("l_partkey").cast("double").alias("y"),
    )
    blank = rows.where("`Sequence No.` % 3 = 0").select([F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    return scada.untimed_export(spark, _written(rows.unionByName(blank), "untimed"))


def exported_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static data of turbines with two date formats and lines without a title."""
    s = table(spark, sf_dir, "supplier")
    day = F.date_add(F.lit("2016-01-01").cast("date"), (F.col("s_suppkey") % 700).cast("int"))
    date = F.when(F.col("s_suppkey") % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    title = F.when(F.col("s_suppkey") % 10 > 0, F.replace("s_name", F.lit("#"), F.lit(" ")))
    text = F.lit(None).cast("string")
    rows = s.select(
        F.lit("F").alias("Wind Farm"), title.alias("Title"), text.alias("a"), F.col("s_suppkey").cast("string").alias("Identity"), text.alias("m"), F.lit("MM82").alias("Model"), F.lit(2050.0).alias("r"),
        (F.col("s_nationkey") + 60.0).alias("h"), F.lit(82.0).alias("d"), (50 + F.col("s_acctbal") / 1e5).alias("lat"), (F.col("s_nationkey") / 10).alias("lon"), F.lit(None).cast("double").alias("e"), text.alias("c"), date.alias("Commercial Operations Date"),
    )
    out = scada.static_turbines(spark, _written(rows, "static"))
    return rounded(out.select("turbine", "identity", "hub_height_m", "latitude", "longitude", F.datediff("commercial_operations_date", F.lit("2016-01-01").cast("date")).alias("days")), latitude=7, longitude=7)


_NAMES = (zipped_turbines, exported_historian, exported_wide, exported_case, exported_untimed, exported_static)
QUERIES = {f.__name__: f for f in _NAMES}

ORACLES = {
    "zipped_turbines": f"{ctes('v_reading')} select turbine::varchar as turbine, count(*) as n, round(avg(wind), 6) as wind, round(avg(power), 5) as power, max(epoch(date_trunc('second', ts)))::bigint as last from v_reading group by turbine",
    "exported_historian": f"""{ctes('v_reading')} select s_name as turbine, epoch(date_trunc('minute', ts))::bigint as minute, round(avg(wind), 6) as wind, round(sum(power), 5) as power, count(*) as n
from v_reading join supplier on s_suppkey = turbine group by 1, 2""",
    "exported_wide": f"{ctes('v_reading')} select event_type as turbine, epoch(time_bucket(interval 10 minute, ts))::bigint as slot, round(avg(wind), 6) as wind, round(avg(power), 5) as power from v_reading group by 1, 2 having avg(power) is not null",
    "exported_case": """with r as (select case when event_id % 5 < 4 then 'train' else 'prediction' end as part, (event_id % 3)::int as status_type_id, ts, value::float::double as a, case when event_id % 7 > 0 then (props->>'$.k')::float::double end as b from events),
l as (select part, status_type_id, ts, 'sensor_1_avg' as sensor, a as value from r union all select part, status_type_id, ts, 'sensor_2_avg', b from r)
select part, status_type_id, sensor, count(*) as n, count(value) as there, round(avg(value), 3) as mean, max(epoch(date_trunc('second', ts)))::bigint as last from l group by 1, 2, 3""",
    "exported_untimed": "select (l_orderkey * 10 + l_linenumber)::bigint as sequence, l_quantity::double as wind, l_extendedprice::double as direction, l_discount::double as density, l_tax::double as humidity, l_partkey::double as power from lineitem",
    "exported_static": "select replace(replace(s_name, '#', ' '), ' ', '_') as turbine, s_suppkey::varchar as identity, s_nationkey + 60.0::double as hub_height_m, round(50 + s_acctbal / 1e5::double, 7) as latitude, round(s_nationkey / 10, 7) as longitude, (s_suppkey % 700)::int as days from supplier where s_suppkey % 10 > 0",
}

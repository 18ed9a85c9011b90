"""Readers that bring differently shaped exports into one schema, and sinks.

Every reader declares its schema; nothing is inferred.  Members of zipped exports are the unit of work: archives are listed
in tasks, and each member is then read in a task of its own as a stream, some thousand lines at a time, so neither an archive
nor a member is ever held whole and archives may be of any size.  Archives are opened through Arrow's file systems (local,
hdfs, s3 and the like).  Zips can't be split inside a member: store what is read as Parquet once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.text import any_timestamp

#: Lines of a member that a task holds at once.
CHUNK_LINES = 50_000
TURBINE_SCHEMA = "turbine string, ts timestamp_ntz, wind double, power double"
STATUS_SCHEMA = "turbine string, start timestamp_ntz, end timestamp_ntz, duration_s double, status string, code string, message string, iec_category string"
STATIC_SCHEMA = "farm string, title string, alternative_title string, identity string, manufacturer string, model string, rated_power_kw double, hub_height_m double, rotor_diameter_m double, latitude double, longitude double, elevation_m double, country string, commercial_operations_date string"


def _archive(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if ":" in path else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(files.open_input_file(name))


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(archive, member)`` of the zips' members whose name matches, one partition a member as far as there are cores."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for archive in pdf["path"]:
                with _archive(archive) as z:
                    names = sorted(n for n in z.namelist() if re.search(pattern, n))
                yield pd.DataFrame({"archive": archive, "member": names}, columns=["archive", "member"], dtype=str)

    files = spark.read.format("binaryFile").load(path).select("path")
    listed = files.mapInPandas(run, "archive string, member string")
    return listed.repartition(max(1, spark.sparkContext.defaultParallelism), "archive", "member")


def _read_members(members: DataFrame, frames, schema: str) -> DataFrame:
    """``frames(member, lines)`` of every member: data frames made from a text stream."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for archive, member in zip(pdf["archive"], pdf["member"], strict=True):
                with _archive(archive) as z, z.open(member) as raw:
                    yield from frames(member, io.TextIOWrapper(raw, "utf-8-sig", "replace", newline=""))

    return members.mapInPandas(run, schema)


def turbine_exports(spark: SparkSession, path: str, columns: dict[str, str], pattern: str = r"Turbine_Data_.*\.csv$", comment: str = "#") -> DataFrame:
    """Ten-minute turbine exports from zips.  Lines above the header are comments; the header is the last comment line,
    which begins with ``# Date and time``, however far down.  ``columns`` maps canonical names (ts, wind, power) to header
    names; the turbine is the number in the member's name.  A member without a header is an error."""
    own = {v: k for k, v in columns.items()}

    def frames(member: str, lines) -> Iterator[pd.DataFrame]:
        found = re.search(r"(\d+)_\d{4}|_(\d+)_", member)
        turbine = str(int(next(g for g in found.groups() if g))) if found else member
        header = first = None
        for line in lines:
            if line.startswith(comment):
                header = line if line.startswith(f"{comment} Date and time") else header
            elif line.strip():
                first = line
                break
        if header is None:
            raise ValueError(f"{member}: no header line that begins with '{comment} Date and time'")
        if first is None:
            return
        names = [" ".join(str(c).split()) for c in pd.read_csv(io.StringIO(header.lstrip(f"{comment} ")), nrows=0).columns]
        for frame in pd.read_csv(_Joined(first, lines), names=names, usecols=list(own), dtype=str, chunksize=CHUNK_LINES):
            yield frame.rename(columns=own).assign(turbine=turbine)[["turbine", "ts", "wind", "power"]]

    rows = _read_members(zip_members(spark, path, pattern), frames, "turbine string, ts string, wind string, power string")
    return rows.select("turbine", F.try_to_timestamp("ts").cast("timestamp_ntz").alias("ts"), F.col("wind").try_cast("double").alias("wind"), F.col("power").try_cast("double").alias("power")).where("ts is not null")


class _Joined(io.TextIOBase):
    """A text stream behind a line that was read from it already."""

    def __init__(self, first: str, rest) -> None:
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> str:
        if self.first:
            out, self.first = self.first, ""
            return out
        return self.rest.read(size)

    def __iter__(self):
        if self.first:
            out, self.first = self.first, ""
            yield out
        yield from self.rest


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """Status events from CSV files whose names hold the turbine's number; an end that doesn't parse is NULL."""
    from windloom.functions.text import duration_seconds

    raw = spark.read.schema("start string, end string, duration string, status string, code string, message string, iec_category string").csv(path, header=True, comment="#")
    return raw.select(
        F.regexp_extract(F.input_file_name(), r"([0-9]+)[^0-9/]*$", 1).alias("turbine"), F.try_to_timestamp("start").cast("timestamp_ntz").alias("start"),
        F.try_to_timestamp("end").cast("timestamp_ntz").alias("end"), duration_seconds(F.col("duration")).alias("duration_s"), "status", "code", "message", "iec_category",
    )


def alarm_codes(spark: SparkSession, path: str) -> DataFrame:
    """``(code, description, stopping)`` of an alarm lookup file."""
    raw = spark.read.schema("code int, description string, stopping int").csv(path, header=True, encoding="UTF-8")
    return raw.where("code is not null").select("code", F.trim("description").alias("description"), (F.col("stopping") == 1).alias("stopping"))


def untimed_export(spark: SparkSession, path: str) -> DataFrame:
    """An export without times, ``(sequence, inland or offshore columns as numbers)``: its rows in file order have no meaning
    beyond the sequence number of the file."""
    raw = spark.read.schema("sequence long, wind double, direction double, density double, humidity double, power double").csv(path, header=True)
    return raw.where("sequence is not null")


def payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested result trees, one JSON document a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def historian(spark: SparkSession, path: str, station_to_turbine: DataFrame) -> DataFrame:
    """Monthly signal tables with station numbers and mixed time formats, turbines by lookup (an equi-join; the lookup has a
    row a station, and Spark broadcasts it by its size)."""
    raw = spark.read.schema("TimeStamp string, StationId int, wind double, power double").csv(path, header=True)
    ts = any_timestamp(F.col("TimeStamp"), ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm"])
    return raw.join(station_to_turbine, "StationId").select("turbine", ts.cast("timestamp_ntz").alias("ts"), "wind", "power").where("ts is not null")


def wide_export(spark: SparkSession, path: str, turbines: list[str], power: str = "p{}", wind: str = "w{}", ts: str = "timestamp") -> DataFrame:
    """One column a turbine and channel, as CSV, to one row a turbine and time."""
    fields = ", ".join([f"{ts} string", *(f"`{form.format(t)}` double" for t in turbines for form in (power, wind))])
    raw = spark.read.schema(fields).csv(path, header=True, enforceSchema=False)
    return long_form(raw, turbines, power, wind, F.try_to_timestamp(ts).cast("timestamp_ntz"))


def long_form(raw: DataFrame, turbines: list[str], power: str, wind: str, ts: Column) -> DataFrame:
    items = F.array(*[F.struct(F.lit(t).alias("turbine"), F.col(wind.format(t)).alias("wind"), F.col(power.format(t)).alias("power")) for t in turbines])
    return raw.select(ts.alias("ts"), F.explode(items).alias("r")).select("r.turbine", "ts", "r.wind", "r.power")


def minute_to_ten(rows: DataFrame, control: DataFrame, least: int = 8) -> DataFrame:
    """One-minute rows joined with a control log, to ten-minute means; directions as vector means; at least 8 of 10 rows."""
    from windloom.functions.angles import vector_mean
    from windloom.operators.resample import floor_minutes

    joined = rows.join(control, ["turbine", "ts"], "left").withColumn("slot", floor_minutes(F.col("ts"), 10))
    out = joined.groupBy("turbine", "slot").agg(F.avg("wind").alias("wind"), F.avg("power").alias("power"), vector_mean(F.col("direction")).alias("direction"), F.avg("derate").alias("derate"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least)


def static_turbines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(STATIC_SCHEMA).csv(path, header=True, encoding="UTF-8")
    return raw.where("title is not null").select(F.replace("title", F.lit(" "), F.lit("_")).alias("turbine"), *[c for c in raw.columns if c not in ("farm", "commercial_operations_date")], any_timestamp(F.col("commercial_operations_date"), ["dd/MM/yyyy", "yyyy-MM-dd"]).cast("date").alias("commercial_operations_date"))


_FIXED = ["time_stamp", "asset_id", "id", "train_test", "status_type_id"]


def _long_case(rows: DataFrame, sensors: list[str], keys: list[str]) -> DataFrame:
    out = rows.unpivot(keys, sensors, "sensor", "value") if sensors else rows
    return out.withColumn("value", F.col("value").try_cast("float").cast("double"))


def fault_case(spark: SparkSession, path: str) -> DataFrame:
    """A labelled case (semicolons, one column a sensor) in long form: ``row_id, ts, part, status_type_id, sensor, value``."""
    with_header = spark.read.csv(path, sep=";", header=True)  # all strings: values are cast below
    sensors = [c for c in with_header.columns if c not in _FIXED]
    own = with_header.select(F.col("id").cast("long").alias("row_id"), F.try_to_timestamp("time_stamp").cast("timestamp_ntz").alias("ts"), F.col("train_test").alias("part"), F.col("status_type_id").cast("int").alias("status_type_id"), *sensors)
    return _long_case(own, sensors, ["row_id", "ts", "part", "status_type_id"])


def fault_archive(spark: SparkSession, path: str, pattern: str = r"datasets/(\d+)\.csv$") -> DataFrame:
    """All cases of a zipped archive of any size in the same long form, with ``event_id`` from the member's name."""
    names = ["event_id", "row_id", "ts", "part", "status_type_id", "sensor", "value"]

    def frames(member: str, lines) -> Iterator[pd.DataFrame]:
        event = int(re.search(pattern, member).group(1))
        for frame in pd.read_csv(lines, sep=";", dtype=str, chunksize=max(1, CHUNK_LINES // 50)):
            long = frame.melt(id_vars=_FIXED, var_name="sensor", value_name="value").rename(columns={"id": "row_id", "time_stamp": "ts", "train_test": "part"})
            yield long.assign(event_id=event).astype({"row_id": "int64"})[names]

    rows = _read_members(zip_members(spark, path, pattern), frames, "event_id long, row_id long, ts string, part string, status_type_id string, sensor string, value string")
    value, ts = F.col("value").try_cast("float").cast("double"), F.try_to_timestamp("ts").cast("timestamp_ntz")
    return rows.select("event_id", "row_id", ts.alias("ts"), "part", F.col("status_type_id").cast("int").alias("status_type_id"), "sensor", value.alias("value"))


def monitored_sensors(dictionary: DataFrame) -> DataFrame:
    """Sensors that are neither a minimum, maximum or deviation channel nor a counter, units repaired."""
    unit = F.translate("unit", "\ufffd", "°")
    return dictionary.where(~F.col("sensor_name").rlike("_(min|max|std)$") & ~F.coalesce(F.col("is_counter"), F.lit(False))).withColumn("unit", unit)


def plant_scada(*frames: DataFrame) -> DataFrame:
    """Years of plant data as one table, the first row of a (time, asset) kept (by source order, then values)."""
    tagged = [f.withColumn("__source", F.lit(k)) for k, f in enumerate(frames)]
    rows = tagged[0]
    for f in tagged[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in ("time", "asset_id", "__source")]
    first = rows.groupBy("time", "asset_id").agg(F.min(F.struct("__source", *others)).alias("r"))
    return first.select("time", "asset_id", *[F.col(f"r.{c}").alias(c) for c in others])


def empty_status(spark: SparkSession) -> DataFrame:
    """The status relation of a farm without a log: unknown, not zero."""
    return spark.createDataFrame([], STATUS_SCHEMA)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df`` (per-farm results merged into one table)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` with other keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, NaN as null."""
    from windloom.session import nan_to_null

    clean = nan_to_null(df)
    return clean.select(F.to_json(F.struct(*clean.columns)).alias("json"))

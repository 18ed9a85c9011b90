"""Zipped exports through the data source: pruning by member names, and round trips."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from windloom.sources import zipped

COLUMNS = {"ts": "Date and time", "power": "Power (kW)"}


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for turbine in (1, 2):
            for year in (2020, 2021):
                rows = "".join(f"{year}-0{m}-01 00:00:00,{m}.5,{turbine * 100 + m}\n" for m in range(1, 4)) + "nonsense,1,1\n"
                z.writestr(f"Turbine_Data_Farm_{turbine}_{year}-01-01_-_{year + 1}-01-01_9.csv", "# x\n# Date and time,Wind speed (m/s),Power (kW)\n" + rows)
        z.writestr("Turbine_Data_Farm_3_2020-01-01_-_2021-01-01_9.csv", "# no header\n1,2,3\n")
        z.writestr("Status_1.csv", "x")
    return str(path)


def test_members_that_cannot_match_are_left_alone(archive):
    def members(*wanted):
        reader = zipped.Reader([f"{archive}/a.zip"], COLUMNS, r"Turbine_Data_.*\.csv$", zipped.Wanted(*wanted))
        return {(m.turbine, m.first[:4]) for m in reader.partitions()}

    assert len(members()) == 5
    assert members(["1"]) == {("1", "2020"), ("1", "2021")}
    assert members(["1", "2"], "2021-01-01T00:00:00") == {("1", "2021"), ("2", "2021")}
    assert members(["2"], None, "2020-06-01T00:00:00") == {("2", "2020")}
    assert members([]) == set()
    assert members(["1", "2"], "2021-02-01T00:00:00", "2021-02-01T00:00:00") == {("1", "2021"), ("2", "2021")}


def test_wanted_rows(spark, archive):
    # The member of turbine 3 has no header: reading it is an error, so it isn't opened here.
    rows = zipped.zipped_exports(spark, f"{archive}/*.zip", COLUMNS, turbines=["1", "2"], since=dt.datetime(2020, 2, 1, 0, 0, 1), until=dt.datetime(2021, 2, 1))
    assert rows.columns == ["turbine", "ts", "power"]
    want = sorted((str(t), f"{y}-0{m}-01T00:00:00", t * 100.0 + m) for t in (1, 2) for y, m in ((2020, 3), (2021, 1), (2021, 2)))
    assert sorted((r.turbine, r.ts.isoformat(), r.power) for r in rows.collect()) == want
    assert rows.where("turbine = '2'").count() == 3
    assert rows.count() == 6
    with pytest.raises(Exception, match="no header line"):
        zipped.zipped_exports(spark, f"{archive}/*.zip", COLUMNS).count()


def test_written_archives_are_read_back(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select(F.col("user_id").alias("turbine"), F.date_trunc("SECOND", F.col("ts").cast("timestamp")).alias("ts"), (F.col("value") / 10).alias("wind"), "value").withColumnRenamed("value", "power")
    path = zipped.write_exports(rows, "exports")
    back = zipped.zipped_exports(spark, f"{path}/*.zip", {"ts": "Date and time", "wind": "Wind speed (m/s)", "power": "Power (kW)"})
    key = lambda df: sorted((str(r.turbine), str(r.ts), round(r.wind, 9), round(r.power, 9)) for r in df.collect())
    assert key(back) == key(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    one = str(rows.first().turbine)
    assert back.where(F.col("turbine") == one).count() == rows.where(F.col("turbine") == one).count()


def test_many_members_share_partitions(spark, archive, monkeypatch):
    monkeypatch.setattr(zipped, "MAX_PARTITIONS", 2)
    reader = zipped.Reader([f"{archive}/a.zip"], COLUMNS, r"Turbine_Data_.*\.csv$", zipped.Wanted(["1", "2"]))
    parts = reader.partitions()
    assert len(parts) == 2 and {(m.turbine, m.first[:4]) for p in parts for m in (p, *p.more)} == {(t, y) for t in ("1", "2") for y in ("2020", "2021")}
    assert sorted(v for p in parts for b in reader.read(p) for v in b.column("power").to_pylist()) == [t * 100.0 + m for t in (1, 2) for m in (1, 1, 2, 2, 3, 3)]

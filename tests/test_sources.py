"""Readers on written exports, against pandas and the values that were written; sinks by round trips."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windloom.sources import scada


def _export(turbine: int, year: int, n: int, comments: int) -> tuple[str, str, pd.DataFrame]:
    rng = np.random.default_rng(turbine * 10_000 + year)
    own = pd.DataFrame({"Date and time": pd.date_range(f"{year}-01-01", periods=n, freq="10min").strftime("%Y-%m-%d %H:%M:%S"), "Wind speed (m/s)": rng.uniform(0, 25, n).round(3), "Rotor speed\n(RPM)": rng.uniform(0, 20, n).round(2), "Power (kW)": rng.uniform(-20, 2050, n).round(2)})
    buffer = io.StringIO()
    own.to_csv(buffer, index=False)
    lines = buffer.getvalue()
    cut = lines.index("Power (kW)") + len("Power (kW)")
    head = lines[:cut].replace('"Rotor speed\n(RPM)"', "Rotor speed (RPM)")
    text = "".join(f"# note {k}\n" for k in range(comments)) + "# " + head + lines[cut:]
    return f"Turbine_Data_Farm_{turbine}_{year}-01-01_-_{year + 1}-01-01_22{turbine}.csv", text, own


@pytest.fixture()
def archive(tmp_path):
    made = {}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as a, zipfile.ZipFile(tmp_path / "b.zip", "w") as b:
        for turbine, year, n, comments, z in ((1, 2020, 700, 9, a), (2, 2020, 300, 500, a), (1, 2021, 50, 0, b)):
            name, text, own = _export(turbine, year, n, comments)
            z.writestr(name, "\ufeff" + text)
            made[name] = (turbine, own)
        a.writestr("Status_Farm_1_2020.csv", "not a turbine export")
    return str(tmp_path), made


def test_turbine_exports_from_zips(spark, archive, monkeypatch):
    """Headers at any depth (500 comment lines too), members in chunks, other members left alone."""
    path, made = archive
    members = scada.zip_members(spark, f"{path}/*.zip", r"Turbine_Data_.*\.csv$").collect()
    assert sorted(r["member"] for r in members) == sorted(made)
    columns = {"ts": "Date and time", "wind": "Wind speed (m/s)", "power": "Power (kW)"}
    got = scada.turbine_exports(spark, f"{path}/*.zip", columns).toPandas().sort_values(["turbine", "ts"]).reset_index(drop=True)
    want = pd.concat([own.assign(turbine="1" if t == 1 and "2021" in name else str(t)) for name, (t, own) in made.items()])
    assert len(got) == len(want) == 1050
    assert np.isclose(np.sort(got["power"]), np.sort(want["Power (kW)"])).all() and np.isclose(np.sort(got["wind"]), np.sort(want["Wind speed (m/s)"])).all()
    assert str(got["ts"].min()) == "2020-01-01 00:00:00"


def test_export_without_header_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("Turbine_Data_Farm_1_2020.csv", "# note\n1,2,3\n")
    with pytest.raises(Exception, match="no header line"):
        scada.turbine_exports(spark, f"{tmp_path}/x.zip", {"ts": "Date and time", "wind": "w", "power": "p"}).collect()


def test_status_log(spark, tmp_path):
    text = "# log\nTimestamp start,Timestamp end,Duration,Status,Code,Message,IEC category\n2020-01-01 10:00:00,2020-01-01 11:30:00,1:30:00,Stop,12,Pitch,Forced outage\n2020-01-02 10:00:00,-,bad,Warning,13,Oil,Full Performance\n"
    (tmp_path / "Status_Farm_07.csv").write_text(text)
    got = scada.status_log(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r["turbine"], r["code"], r["duration_s"], r["end"] is None) for r in got] == [("07", "12", 5400.0, False), ("07", "13", 0.0, True)]
    assert scada.empty_status(spark).columns == ["turbine", "start", "end", "duration_s", "status", "code", "message", "iec_category"]


def test_static_turbines_and_alarm_codes(spark, tmp_path):
    head = "Wind Farm,Title,Alternative Title,Identity,Manufacturer,Model,Rated power (kW),Hub Height (m),Rotor Diameter (m),Latitude,Longitude,Elevation (m),Country,Commercial Operations Date\n"
    (tmp_path / "static.csv").write_text(head + "K,K 1,1,a,S,MM92,2050,78.5,92,52.4,-0.9,130,UK,31/12/2016\n,,,,,,,,,,,,,\nK,K 2,2,b,S,MM92,2050,68.5,92,52.5,-0.8,131,UK,2016-04-15\n")
    got = scada.static_turbines(spark, f"{tmp_path}/static.csv").orderBy("turbine").collect()
    assert [(r["turbine"], r["rated_power_kw"], str(r["commercial_operations_date"])) for r in got] == [("K_1", 2050.0, "2016-12-31"), ("K_2", 2050.0, "2016-04-15")]
    (tmp_path / "codes.csv").write_text("Alarm Code,Description,Stopping\n3, Emergency stop ,1\n9,Info,0\n")
    assert [tuple(r) for r in scada.alarm_codes(spark, f"{tmp_path}/codes.csv").orderBy("code").collect()] == [(3, "Emergency stop", True), (9, "Info", False)]


def test_historian_months(spark, tmp_path):
    (tmp_path / "tbl_2020_01.csv").write_text("TimeStamp,StationId,wind,power\n2020-01-01 00:10:00,77,5.5,100\n2020-01-02,78,6.5,200\n")
    (tmp_path / "tbl_2020_02.csv").write_text("TimeStamp,StationId,wind,power\n01/02/2020 13:20,77,7.5,300\nnonsense,77,1,1\n01/02/2020 13:20,99,7.5,300\n")
    stations = spark.createDataFrame([(77, "T01"), (78, "T02")], "StationId int, turbine string")
    got = [(r["turbine"], str(r["ts"]), r["power"]) for r in scada.historian(spark, str(tmp_path), stations).orderBy("ts").collect()]
    assert got == [("T01", "2020-01-01 00:10:00", 100.0), ("T02", "2020-01-02 00:00:00", 200.0), ("T01", "2020-02-01 13:20:00", 300.0)]


def test_wide_export_from_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "wide.csv.gz", "wt") as f:
        f.write("timestamp,p1,w1,p2,w2\n2020-01-01 00:00:00,10,5,,6\n2020-01-01 00:10:00,20,7,30,8\n")
    got = sorted((r["turbine"], str(r["ts"])[11:16], r["wind"], r["power"]) for r in scada.wide_export(spark, f"{tmp_path}/wide.csv.gz", ["1", "2"]).collect())
    assert got == [("1", "00:00", 5.0, 10.0), ("1", "00:10", 7.0, 20.0), ("2", "00:00", 6.0, None), ("2", "00:10", 8.0, 30.0)]


def test_minutes_to_ten(spark):
    rows = [(1, f"2020-01-01 00:{m:02d}:00", 5.0 + m, 100.0, 359.0 if m % 2 else 1.0) for m in range(19) if m not in (11, 12, 13)]
    frame = spark.createDataFrame(rows, "turbine int, ts string, wind double, power double, direction double").withColumn("ts", F.to_timestamp_ntz("ts"))
    control = frame.where("wind < 10").select("turbine", "ts", F.lit(0.4).alias("derate"))
    got = scada.minute_to_ten(frame, control).collect()
    assert len(got) == 1 and got[0]["n"] == 10 and got[0]["wind"] == pytest.approx(9.5) and got[0]["derate"] == pytest.approx(0.4)
    assert min(got[0]["direction"], 360 - got[0]["direction"]) < 1e-6


def test_fault_cases_plain_and_zipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scada, "CHUNK_LINES", 100)
    text = "time_stamp;asset_id;id;train_test;status_type_id;sensor_0_avg;power_1\n" + "".join(f"2020-01-01 00:{k:02d}:00;5;{k};train;0;{k / 3:.6f};{'' if k == 2 else k}\n" for k in range(7))
    (tmp_path / "40.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "cases.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Farm A/datasets/40.csv", text)
        z.writestr("Farm B/datasets/41.csv", text)
        z.writestr("Farm B/event_info.csv", "x")
    plain = sorted(map(tuple, scada.fault_case(spark, f"{tmp_path}/40.csv").collect()), key=str)
    zipped = scada.fault_archive(spark, f"{tmp_path}/cases.zip")
    assert sorted((tuple(r)[1:] for r in zipped.where("event_id = 40").collect()), key=str) == plain and zipped.where("event_id = 41").count() == 14
    by = {(r["sensor"], r["row_id"]): r["value"] for r in zipped.where("event_id = 41").collect()}
    assert by["power_1", 2] is None and by["sensor_0_avg", 1] == pytest.approx(1 / 3, abs=1e-6)


def test_dictionary_untimed_and_payload(spark, tmp_path):
    rows = [("wind_avg", "m/s", False), ("temp_std", "\ufffdC", False), ("temp", "\ufffdC", None), ("count", "1", True), ("t_min", "x", False)]
    got = scada.monitored_sensors(spark.createDataFrame(rows, "sensor_name string, unit string, is_counter boolean")).collect()
    assert sorted((r["sensor_name"], r["unit"]) for r in got) == [("temp", "°C"), ("wind_avg", "m/s")]
    (tmp_path / "inland.csv").write_text("Sequence No.,V,D,air density,S_a,y (% relative to rated power)\n1,5.5,200,1.2,0.1,33\n,,,,,\n2,6.5,210,1.21,0.2,44\n")
    assert [(r["sequence"], r["wind"], r["power"]) for r in scada.untimed_export(spark, f"{tmp_path}/inland.csv").orderBy("sequence").collect()] == [(1, 5.5, 33.0), (2, 6.5, 44.0)]
    (tmp_path / "payload.json").write_text(json.dumps({"farms": {"a": {"loss": 1.5}}, "runs": [{"id": 1}, {"id": 2}]}, indent=1))
    tree = scada.payload(spark, f"{tmp_path}/payload.json", "farms map<string, struct<loss: double>>, runs array<struct<id: int>>").first()
    assert tree["farms"]["a"]["loss"] == 1.5 and [r["id"] for r in tree["runs"]] == [1, 2]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/merged"
    scada.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "farm string, v int"), path, ["farm"])
    scada.write_partitioned(spark.createDataFrame([("b", 3), ("c", 4)], "farm string, v int"), path, ["farm"])
    assert sorted((r["farm"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]

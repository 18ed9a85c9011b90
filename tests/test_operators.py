"""Hand-computed cases for the sensor operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windloom.functions import angles, text, wind
from windloom.operators import drift, forecasting, geometry, intervals, models, power_curve, qc, records, resample, retrieval, rules, scoring, sequence


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_curve_bin_edges(spark):
    cases = {0.0: 0.25, 0.5: 0.25, 0.50001: 0.75, 20.0: 19.75, 20.0001: 21.0, 22.0: 21.0, 28.0: 27.0, 28.0001: None, -1.0: None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v double").select(wind.curve_bin(F.col("v")).alias("b"))
    assert values(df, "b") == list(cases.values())


def test_angles(spark):
    df = spark.createDataFrame([(359.0, 1.0), (10.0, 350.0), (180.0, 0.0), (-10.0, 0.0)], "a double, b double")
    assert values(df.select(angles.difference(F.col("a"), F.col("b")).alias("d")), "d") == [-2.0, 20.0, -180.0, -10.0]
    assert values(df.select(angles.wrap360(F.col("a")).alias("d")), "d") == [359.0, 10.0, 180.0, 350.0]
    mean = spark.createDataFrame([(359.0,), (1.0,)], "a double").agg(angles.vector_mean(F.col("a")).alias("m")).first()["m"]
    assert min(mean, 360 - mean) < 1e-9


def test_utm_against_known_point(spark):
    # 9 degrees east on the equator's central meridian of zone 32, and a point on 57 degrees north.
    df = spark.createDataFrame([(500000.0, 0.0), (500000.0, 6317972.0)], "e double, n double")
    lat, lon = angles.utm_to_degrees(F.col("e"), F.col("n"), 32)
    got = [tuple(r) for r in df.select(lat, lon).collect()]
    assert got[0] == pytest.approx((0.0, 9.0), abs=1e-9)
    assert got[1][1] == pytest.approx(9.0, abs=1e-9) and 56.9 < got[1][0] < 57.1


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (3.0,)], "v double")
    assert values(df.select(wind.clip_low(F.col("v")).alias("c")), "c") == [None, 0.0, 3.0]


def test_yaw_status(spark):
    rows = [(5.0, 1.0, 9.0, 2.0), (1.0, -1.0, 3.0, 2.0), (None, 1.0, 2.0, 2.0), (5.0, 1.0, 9.0, 20.0)]
    df = spark.createDataFrame(rows, "m double, lo double, hi double, s double")
    assert values(df.select(wind.yaw_status(*(F.col(c) for c in ("m", "lo", "hi", "s"))).alias("y")), "y") == ["flag", "ok", "inconclusive", "inconclusive"]


def test_frozen_run_of_three(spark):
    xs = [1.0, 2.0, 5.0, 5.0, 5.0, 3.0, 3.0, None, None, None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "turbine int, i int, x double")
    flags = [r["frozen"] for r in qc.frozen_flags(df, ["turbine"], ["i"], "x").orderBy("i").collect()]
    assert flags == [False, False, True, True, True, False, False, False, False, False]


def test_frozen_matches_pandas(spark):
    rng = np.random.default_rng(3)
    x = pd.Series(rng.integers(0, 2, 500).astype(float)).where(rng.random(500) > 0.1)
    run = (x != x.shift()).cumsum()
    expected = (x.groupby(run).transform("size") >= 3) & x.notna()
    df = spark.createDataFrame([(1, i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)], "turbine int, i int, x double")
    assert [r["frozen"] for r in qc.frozen_flags(df, ["turbine"], ["i"], "x").orderBy("i").collect()] == expected.tolist()


def test_bin_outlier(spark):
    df = spark.createDataFrame([(1, i, 500.0, 15.0 if i == 7 else 8.0 + 0.01 * (i % 3)) for i in range(20)], "turbine int, i int, power double, wind double")
    out = qc.bin_outliers(df, ["turbine"], "power", "wind", 100.0, 0.0, 1000.0)
    assert sorted(r["i"] for r in out.where("outlier").collect()) == [7]


def _reference_checks(x: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
    """The five checks in plain Python loops."""
    n = len(x)
    known = [v for v, r in zip(x, ref, strict=True) if r and not math.isnan(v)]
    same = [i > 0 and x[i] == x[i - 1] for i in range(n)]

    def runs(mask):
        out, i = [], 0
        while i < n:
            j = i
            while j < n and mask[j]:
                j += 1
            if j > i:
                out.append((i, j))
            i = max(j, i + 1)
        return out

    lengths = [b - a for a, b in runs([s and r for s, r in zip(same, ref, strict=True)])]
    limit = max(5, math.ceil(3 * (np.quantile(lengths, 0.999) if lengths else 0)))
    stale = np.zeros(n, bool)
    for a, b in runs(same):
        if b - a >= limit:
            stale[max(a - 1, 0) : b] = True
    common = {v for v in set(known) if known.count(v) > 0.01 * len(known)}
    stale &= np.array([v not in common for v in x])
    lo, hi = np.quantile(known, [0.001, 0.999])
    out_of_range = (x < lo - 2 * (hi - lo)) | (x > hi + 2 * (hi - lo))
    d = np.diff(x, prepend=np.nan)
    big = np.abs(d) > 3 * np.quantile([abs(v) for v, r in zip(d, ref, strict=True) if r and not math.isnan(v)], 0.999)
    scatter = pd.Series(d).rolling(6, min_periods=6).std().to_numpy()
    erratic = scatter > 4 * np.quantile([v for v, r in zip(scatter, ref, strict=True) if r and not math.isnan(v)], 0.99)
    return {"gap": np.isnan(x), "stale": stale, "out_of_range": out_of_range, "step": big | np.r_[big[1:], False], "erratic": erratic}


def test_sensor_checks_find_planted_faults(spark):
    rng = np.random.default_rng(11)
    n, fit = 2500, 1500
    x = 40 + 5 * np.sin(np.arange(n) / 144 * 2 * np.pi) + rng.normal(0, 0.3, n)
    x[1600:1620] = x[1600]
    x[1700] += 60
    x[1800] = 900
    x[1900:1930] += rng.normal(0, 6, 30)
    x[2000:2010] = np.nan
    ref = np.arange(n) < fit
    expected = _reference_checks(x, ref)
    df = spark.createDataFrame([(1, i, None if math.isnan(v) else float(v), i < fit) for i, v in enumerate(x)], "s int, i int, v double, r boolean")
    got = qc.sensor_checks(df, "s", ["i"], "v", "r").orderBy("i").toPandas()
    for name, want in expected.items():
        assert got[name].tolist() == want.tolist(), name
    assert got["stale"][1605] and got["step"][1700] and got["out_of_range"][1800] and got["gap"][2005] and got["erratic"][1910:1930].any()
    assert not got["bad"][:fit].any()


def test_interval_union(spark):
    rows = [("a", 0, 7200), ("a", 3600, 5400), ("a", 7200, 10800), ("a", 18000, 21600), ("a", 30000, None), ("b", 5, 5)]
    df = spark.createDataFrame(rows, "turbine string, start_s long, end_s long")
    got = {r["turbine"]: (r["hours"], r["outages"]) for r in intervals.downtime(df, ["turbine"]).collect()}
    assert got == {"a": (4.0, 2), "b": (0.0, 1)}


def test_cusum_closed_form(spark):
    rng = np.random.default_rng(2)
    steps = rng.normal(-0.1, 1, 300)
    s, expected = 0.0, []
    for v in steps:
        s = max(0.0, s + v)
        expected.append(s)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(steps)], "k int, i int, v double")
    got = [r["cusum"] for r in sequence.cusum(df, ["k"], ["i"], F.col("v")).orderBy("i").collect()]
    assert got == pytest.approx(expected, abs=1e-9)


def test_poisson_cusum_trickle(spark):
    rows = [(s, d, e, 144, 0.2 / 144) for s, e in ((1, 2), (2, 0)) for d in range(20)]
    df = spark.createDataFrame(rows, "event_id int, day int, episodes int, monitored int, base_rate double")
    out = sequence.poisson_cusum(df, ["event_id"], ["day"]).where("warn").groupBy("event_id").agg(F.min("day").alias("first")).collect()
    assert [(r["event_id"], r["first"]) for r in out] == [(1, 3)]


def test_count_rule(spark):
    df = spark.createDataFrame([(1, d, e) for d, e in enumerate([3, 0, 3, 3, 0, 0, 0, 3])], "event_id int, day int, episodes int")
    out = sequence.count_rule(df, ["event_id"], ["day"], 3, 2).orderBy("day")
    assert values(out, "warn") == [False, False, True, True, False, False, False, False]


def test_criticality_and_clamp(spark):
    flags = [True] * 1200 + [False] * 3 + [True]
    df = spark.createDataFrame([(1, i, f, i != 1201) for i, f in enumerate(flags)], "k int, i int, flag boolean, normal boolean")
    got = [r["criticality"] for r in sequence.criticality(df, ["k"], ["i"], "flag", "normal").orderBy("i").collect()]
    assert got[71] == 72 and max(got) == 1000 and got[-4:] == [999, 999, 998, 999]


def test_exponential_mean(spark):
    xs = [None, 1.0, None, 4.0, 2.0, 8.0, None, 3.0, 5.0]
    expected = pd.Series(xs, dtype=float).ewm(span=9, ignore_na=True, min_periods=3).mean()
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, i int, x double")
    got = [r["x_ewm9"] for r in sequence.exponential_mean(df, ["k"], ["i"], "x", 9).orderBy("i").collect()]
    for a, b in zip(got, expected, strict=True):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b)


def test_sensor_faults(spark):
    days = spark.createDataFrame([(1, s, d, s == "a" or (s == "c" and d == 0), 0.5 if (s, d) == ("b", 1) else 0.0) for s in "abc" for d in (0, 1)], "event_id int, sensor string, day int, warn boolean, bad_share double")
    peers = spark.createDataFrame([(1, "a", "b", 0.99), (1, "a", "c", 0.5), (1, "c", "a", 0.6)], "event_id int, sensor string, peer string, r double")
    out = {(r["sensor"], r["day"]): (r["fault"], r["check"]) for r in sequence.sensor_faults(days, peers).collect()}
    assert out == {("a", 0): (True, False), ("a", 1): (True, False), ("b", 0): (False, False), ("b", 1): (True, False), ("c", 0): (False, False), ("c", 1): (False, False)}


def test_f_beta_and_earliness(spark):
    truth, flag = [True, True, True, False, False], [True, False, True, True, False]
    df = spark.createDataFrame(list(zip(truth, flag, strict=True)), "t boolean, f boolean")
    tp, fp, fn = 2, 1, 1
    assert df.agg(scoring.f_beta(F.col("t"), F.col("f")).alias("b")).first()["b"] == pytest.approx(1.25 * tp / (1.25 * tp + 0.25 * fn + fp))
    assert df.where("false").agg(scoring.f_beta(F.col("t"), F.col("f")).alias("b")).first()["b"] == 0.0
    w = spark.range(1, 6).select(scoring.earliness_weight(F.col("id"), F.lit(5)).alias("w"))
    assert values(w, "w") == pytest.approx([1, 1, 2 / 3, 1 / 3, 0])


def test_event_scores_threshold(spark):
    rows = [(e, "anomaly", i, 100 <= i < 100 + n, True, 100, 199) for e, n in ((1, 71), (2, 72)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, label string, id long, flag boolean, normal boolean, start_id long, end_id long")
    got = {r["event_id"]: r for r in scoring.evaluate_events(df).collect()}
    assert not got[1]["detected"] and got[2]["detected"]
    assert got[2]["first_id"] == 171 and got[2]["lead_rows"] == 28 and got[1]["first_id"] is None
    b = [((1.25 * n) / (1.25 * n + 0.25 * (100 - n))) for n in (71, 72)]
    assert [got[1]["coverage"], got[2]["coverage"]] == pytest.approx(b)


def test_care_special_cases(spark):
    schema = "label string, detected boolean, coverage double, accuracy double, earliness double"
    nothing = spark.createDataFrame([("anomaly", False, 0.5, 0.9, 0.1), ("normal", False, None, 0.9, None)], schema)
    poor = spark.createDataFrame([("anomaly", True, 0.5, 0.9, 0.1), ("normal", False, None, 0.4, None)], schema)
    usual = spark.createDataFrame([("anomaly", True, 0.5, 0.9, 0.1), ("normal", False, None, 0.8, None)], schema)
    alone = usual.where("label = 'normal'")
    assert [scoring.care_score(x).first()["care"] for x in (nothing, poor, usual, alone)] == [0.0, 0.4, pytest.approx((0.5 + 1.6 + 1 + 0.1) / 5), None]


def test_freestream_on_a_line(spark):
    df = spark.createDataFrame([(i, 0.0, 300.0 * i) for i in range(7)], "turbine int, x double, y double")
    sets = {r["degree"]: sorted(r["t"]) for r in geometry.freestream(df, 2000.0).groupBy("degree").agg(F.collect_list("turbine").alias("t")).collect()}
    assert sets[0] == [6] and sets[180] == [0] and sets[90] == list(range(7)) and sets[20] == [6] and sets[21] == list(range(7)) and sets[340] == [6]


def test_line_bearing(spark):
    df = spark.createDataFrame([(i, 100.0 * i, 100.0 * i) for i in range(5)], "turbine int, x double, y double")
    assert geometry.line_bearing(df).first()["bearing"] == pytest.approx(45.0)


def test_layout_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(geometry, "MAX_LAYOUT", 3)
    df = spark.createDataFrame([(i, 1.0 * i, 0.0) for i in range(5)], "turbine int, x double, y double")
    with pytest.raises(Exception, match="layout too large"):
        geometry.turbine_pairs(df).collect()


def test_gap_fill_first_six(spark):
    xs = [0.0] + [None] * 8 + [9.0, None, 11.0, None]
    df = spark.createDataFrame(list(enumerate(xs)), "h long, x double")
    got = values(resample.fill_gaps(df, "h", "x", 6).orderBy("h"), "x_filled")
    assert got == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, 9.0, 10.0, 11.0, None]


def test_counter_reset(spark):
    df = spark.createDataFrame(list(enumerate([10.0, 12.0, 1.0, 500.0, 501.0])), "h long, x double")
    assert values(resample.counter_increments(df, "h", "x", 100.0).orderBy("h"), "increment") == [None, 2.0, None, None, 1.0]


def test_farm_gate_and_clip(spark):
    t = dt.datetime(2024, 1, 1, 0, 10)
    df = spark.createDataFrame([(1, t, 100.0, 5.0), (2, t, -40.0, 5.0), (3, t, None, 5.0)], "turbine int, ts timestamp_ntz, power double, wind double")
    assert resample.farm_hourly(df, 3).first()["output_mw"] == pytest.approx(0.06)
    assert resample.farm_hourly(df, 3, clip_first=True).first()["output_mw"] == pytest.approx(0.1)
    assert resample.farm_hourly(df, 3, least=3).count() == 0
    assert resample.farm_hourly(df, 3, scale="mean").first()["output_mw"] == pytest.approx(0.09)


def test_weibull_against_known_shape(spark):
    rng = np.random.default_rng(5)
    v = 8 * rng.weibull(2.1, 20000)
    df = spark.createDataFrame([(1, float(x)) for x in v], "turbine int, wind double")
    r = power_curve.weibull_fit(df, ["turbine"]).first()
    assert r["shape"] == pytest.approx(2.1, abs=0.04) and r["scale"] == pytest.approx(8, abs=0.1)


def test_kernel_curve_twin(spark):
    rng = np.random.default_rng(6)
    v = rng.uniform(0, 25, 2000)
    p = 80 * v + rng.normal(0, 10, 2000)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(v, p, strict=True)], "turbine int, wind double, power double")
    got = {r["centre"]: r["power"] for r in power_curve.kernel_curve(df, ["turbine"]).collect()}
    for c in (5.25, 12.75, 20.25):
        w = np.exp(-0.5 * ((v - c) / 0.5) ** 2)
        assert got[c] == pytest.approx((w * p).sum() / w.sum(), rel=0.01)


def test_displacement_recovers_shift(spark):
    curve = spark.createDataFrame([(float(v), float(min(2000, 2 * v**3))) for v in range(0, 20)], "wind_bin double, mean_power double")
    v = np.linspace(3, 9, 400)
    p = np.interp(v + 0.4, np.arange(20.0), np.minimum(2000, 2 * np.arange(20.0) ** 3))
    df = spark.createDataFrame([(7, float(a), float(b)) for a, b in zip(v, p, strict=True)], "turbine int, wind double, power double")
    assert power_curve.curve_displacement(df, curve).first()["displacement"] == pytest.approx(0.4, abs=0.01)


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, [1, 5], (400, 2))
    y = 3 + x @ [2, -0.3] + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(1, i, float(a), float(b), float(c), i < 300) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "s int, i int, a double, b double, y double, train boolean")
    got = [r["fitted"] for r in models.ridge_residuals(df, "s", "i", ["a", "b"], "y", "train").orderBy("i").collect()]
    m, sd = x[:300].mean(0), x[:300].std(0)
    z = (x - m) / sd
    w = np.linalg.solve(z[:300].T @ z[:300] + np.eye(2), z[:300].T @ (y[:300] - y[:300].mean()))
    assert got == pytest.approx((z @ w + y[:300].mean()).tolist(), abs=1e-8)


def test_pca_error_against_numpy(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (300, 2))
    x = np.c_[base, base @ [1, 1] + rng.normal(0, 0.01, 300)]
    x[-1, 2] += 3
    df = spark.createDataFrame([(1, i, *map(float, r), i < 250) for i, r in enumerate(x)], "s int, i int, a double, b double, c double, train boolean")
    got = np.array([r["error"] for r in models.pca_error(df, "s", ["a", "b", "c"], "train").orderBy("i").collect()])
    z = (x - x[:250].mean(0)) / x[:250].std(0)
    u, s, v = np.linalg.svd(z[:250], full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.95) + 1)
    rest = z - z @ v[:k].T @ v[:k]
    assert got == pytest.approx((rest**2).sum(1), abs=1e-8) and got.argmax() == 299


def test_numbering_across_parts(spark):
    df = spark.createDataFrame([(int(k),) for k in (5, 25_000, 3, 9_999, 10_000)], "h long")
    assert [(r["h"], r["i"]) for r in forecasting.numbered(df, "h").orderBy("h").collect()] == [(3, 0), (5, 1), (9999, 2), (10000, 3), (25000, 4)]


def test_allocation_total(spark):
    df = spark.createDataFrame([(1, "a", 100.0), (1, "b", 50.0), (2, "a", 10.0), (2, "b", 5.0)], "hour int, farm string, available double")
    got = {(r["hour"], r["farm"]): r["allocated"] for r in forecasting.allocation(df, 120.0).collect()}
    assert got[1, "a"] + got[1, "b"] == pytest.approx(120) and got[1, "a"] >= 60 and got[1, "b"] >= 30 and got[2, "a"] == 10


def test_best_period_needs_coverage(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=10 * k), 100.0) for k in range(144)] + [(1, t0 + dt.timedelta(days=1, minutes=10 * k), 900.0) for k in range(20)]
    df = spark.createDataFrame(rows, "turbine int, ts timestamp_ntz, power double")
    best = records.best_period(df, "DAY", 1).collect()
    assert [r["start"].day for r in best] == [1] and best[0]["mwh"] == pytest.approx(2.4)


def test_psi_of_equal_samples_is_small(spark):
    df = spark.range(2000).select((F.col("id") % 1000).cast("double").alias("v"), (F.col("id") < 1000).alias("r"))
    assert drift.psi(df, "v", "r").first()["psi"] == pytest.approx(0, abs=1e-9)
    assert drift.ks_distance(df, "v", "r").first()["ks"] == pytest.approx(0, abs=1e-9)


def test_chunks_overlap_and_sentence_end(spark):
    page = " ".join(f"Sentence number {i} is here." for i in range(200))
    got = list(retrieval.chunk_bounds(page, 500, 60, 20))
    assert len(got) > 5 and all(len(c) <= 500 for _, c in got) and all(c.endswith(".") for _, c in got)
    assert all(page[s : s + 1] for s, _ in got) and all(a < b for (a, _), (b, _) in zip(got, got[1:], strict=False))
    assert list(retrieval.chunk_bounds("short", 500, 60, 20)) == []


def test_verified_specs(spark):
    pages = spark.createDataFrame([("d", 1, "Rated power 2.05 MW"), ("d", 2, "Rotor 82 m, 1,500 rpm")], "doc_id string, page int, text string")
    specs = spark.createDataFrame([("d", "rated_power_kw", "2050", 1), ("d", "rotor", "82", 1), ("d", "hub", "99", 1), ("d", "speed", "1500", 2)], "doc_id string, field string, value string, page int")
    got = {r["field"]: (r["page"], r["verified"]) for r in retrieval.verified_specs(specs, pages).collect()}
    assert got == {"rated_power_kw": (1, True), "rotor": (2, True), "hub": (None, False), "speed": (2, True)}


def test_text_functions(spark):
    df = spark.createDataFrame([("1:02:03",), ("bad",), (None,)], "t string")
    assert values(df.select(text.duration_seconds(F.col("t")).alias("s")), "s") == [3723.0, 0.0, 0.0]
    c = spark.createDataFrame([("Oil temp gearbox",), ("Yaw brake",), ("nothing",), (None,)], "t string")
    assert values(c.select(text.component(F.col("t")).alias("c")), "c") == ["gearbox", "yaw system", "other", None]


def test_resolution(spark):
    turbines = spark.createDataFrame([("A1",), ("B1",), ("T07",)], "turbine string")
    asked = spark.createDataFrame([("A1",), ("b 1",), ("turbine 7",), ("x1",)], "asked string")
    assert {r["asked"]: r["turbine"] for r in rules.resolve_turbine(turbines, asked).collect()} == {"A1": "A1", "b 1": "B1", "turbine 7": "T07", "x1": None}


def test_recommend_skips_noted(spark):
    eff = spark.createDataFrame([(1, 0.2), (2, 0.3), (3, 0.4)], "turbine int, capacity_factor double")
    noted = spark.createDataFrame([(1,)], "turbine int")
    assert rules.recommend(eff, noted).first()["turbine"] == 2


def test_long_documents_are_chunks_too(spark, tmp_path):
    from windloom.plans import texts

    rows = [(1, "word " * 7000 + "42", "en", "src1", 35002), (8, "short 43", "en", "src1", 8), (9, "x" * 50 + ".\nsecond", "it", "src2", 58)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 42), (21, 43), (41, 44)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(values(texts.scoped_chunks(spark, str(tmp_path)), "chunk")) == [1, 8]
    assert values(texts.best_pages(spark, str(tmp_path)), "doc_id", "page", "chunk", "distance") == [("src1", 1, 1, 2)]
    assert values(texts.whole_documents(spark, str(tmp_path)), "doc_id", "characters", "chunks") == [(9, 56, 2)]
    got = {r["value"]: (r["page"], r["verified"]) for r in texts.verified_specs(spark, str(tmp_path)).collect()}
    assert got == {"42": (1, True), "43": (1, True), "44": (None, False)}


def test_verified_specs_puts_no_page_together(spark):
    from windloom.plans import texts

    plan = texts.verified_specs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    specs = spark.createDataFrame([("a", "f", "7", 1), ("a", "f", "8", 1), ("a", "f", "9", 1), ("b", "f", "7", 1)], "doc_id string, field string, value string, page int")
    pages = spark.createDataFrame([("a", 1, "x 7"), ("a", 1, "70 7.0"), ("a", 3, "8"), ("a", 2, "8 7"), ("c", 1, "7")], "doc_id string, page int, text string")
    got = {(r["doc_id"], r["value"]): (r["page"], r["verified"]) for r in retrieval.verified_numbers(specs, pages).collect()}
    assert got == {("a", "7"): (1, True), ("a", "8"): (2, True), ("a", "9"): (None, False), ("b", "7"): (None, False)}


def test_bootstrap_draws_all_days(spark, tmp_path):
    from windloom.plans import wake

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    late = source.withColumn("ts", F.col("ts") + F.expr("interval 400 days"))
    late.write.parquet(f"{tmp_path}/late/events.parquet")
    source.unionByName(late).write.parquet(f"{tmp_path}/both/events.parquet")
    given = sorted(values(wake.day_block_bootstrap(spark, "/root/testdata/sf0.001"), "draw", "ratio"))
    assert len(given) == 300 and sorted(values(wake.day_block_bootstrap(spark, f"{tmp_path}/late"), "draw", "ratio")) == given
    assert sorted(values(wake.day_block_bootstrap(spark, f"{tmp_path}/both"), "draw", "ratio")) != given
    daily = spark.createDataFrame([(d, float(d), 1.0) for d in range(50, 150, 2)] + [(None, 1e9, 1.0)], "day int, a double, b double")
    seen = values(geometry.block_bootstrap(daily, 40, "a", "b"), "ratio")
    assert len(seen) == 40 and np.mean(seen) == pytest.approx(99, abs=4)
    assert geometry.block_bootstrap(daily.where("false"), 40, "a", "b").count() == 0


def test_forecast_is_of_the_default_model(spark, monkeypatch):
    from windloom.plans import forecasts

    asked = {}
    monkeypatch.setattr(models, "boosted", lambda *a, **k: asked.update(k) or None)
    monkeypatch.setattr(models, "predict", lambda model, rows: rows.withColumn("prediction", F.lit(0.0)))
    forecasts.gbt_forecast(spark, "/root/testdata/sf0.001")
    assert "trees" not in asked


def test_rules_are_checked_not_cut(spark, monkeypatch):
    from windloom.operators import watch

    monkeypatch.setattr(watch, "MAX_RULES", 3)
    days = spark.createDataFrame([(1, d, d) for d in range(4)], "event_id int, day int, episodes int")
    rules_ = lambda n: spark.createDataFrame([(k, k, 1) for k in range(n)], "rule_id int, least int, persist int")
    assert scoring.rule_grid(days, rules_(3)).count() == 3
    with pytest.raises(ValueError, match="more than 3 rules"):
        scoring.rule_grid(days, rules_(4))


def test_search_is_exact_and_bounded(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (200, 4)).astype(float)  # many ties
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["position"]): (r["vec_id"], r["distance"]) for r in retrieval.search(queries, vectors, 7, batch_rows=33).collect()}
    for q in range(20):
        d = ((x - x[q]) ** 2).sum(axis=1)
        for p, k in enumerate(np.lexsort((np.arange(200), d))[:7], 1):
            assert got[q, p] == (k, d[k])
    assert retrieval.search(queries.where("false"), vectors, 3).count() == 0
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 10)
    with pytest.raises(ValueError, match="more than 10 queries"):
        retrieval.search(queries, vectors, 3)


def test_series_in_parts(spark, monkeypatch):
    """Windows over a whole series, cut into parts of a few rows, are those of one window."""
    monkeypatch.setattr(forecasting, "PART_ROWS", 20)
    monkeypatch.setattr(resample, "PART_KEYS", 7)
    rng = np.random.default_rng(3)
    y = pd.Series(rng.normal(10, 3, 200)).where(rng.random(200) > 0.3)
    frame = spark.createDataFrame([(k, None if math.isnan(v) else float(v), float(k)) for k, v in enumerate(y)], "h long, x double, k double")
    got = forecasting.lag_features(frame, "h", "x", (1, 5, 12)).orderBy("h").toPandas()
    for k in (1, 5, 12):
        assert np.allclose(got[f"lag_{k}"].astype(float), y.shift(k), equal_nan=True)
    errors = frame.select("h", F.col("x").alias("predicted"), F.col("k").alias("actual"))
    got = forecasting.rolling_error(errors, "h", 15, 4).orderBy("h").toPandas()["rolling_mape"].astype(float)
    ape = 100 * ((y - np.arange(200)) / np.arange(200)).abs().replace([np.inf], np.nan)
    assert np.allclose(got, ape.rolling(15, min_periods=4).mean(), equal_nan=True)
    got = resample.fill_gaps(frame, "h", "x", 3).orderBy("h").toPandas()["x_filled"].astype(float)
    assert np.allclose(got, y.interpolate(limit=3, limit_area="inside"), equal_nan=True)
    history = {r["h"]: r["history"] for r in forecasting.look_back(frame, "h", "k", 10).collect()}
    assert history[8] is None and history[150] == [float(v) for v in range(141, 151)]


def test_state_of_one_hot_key_in_parts(spark):
    """A key with nearly all rows is spread over parts; the counter and the mean are those of one loop."""
    rng = np.random.default_rng(4)
    n = 4000
    flags, live, x = rng.random(n) < 0.6, rng.random(n) < 0.9, rng.normal(0, 1, n)
    x[rng.random(n) < 0.1] = np.nan
    rows = [(1, i, bool(flags[i]), bool(live[i]), None if np.isnan(x[i]) else float(x[i])) for i in range(n)] + [(2, 0, True, True, 1.0)]
    frame = spark.createDataFrame(rows, "k int, i int, flag boolean, normal boolean, x double")
    c, want = 0, []
    for f, live_ in zip(flags, live, strict=True):
        c = min(50, c + 1) if live_ and f else max(0, c - 1) if live_ else c
        want.append(c)
    got = sequence.criticality(frame, ["k"], ["i"], "flag", "normal", 50)
    assert [r["criticality"] for r in got.where("k = 1").orderBy("i").collect()] == want and got.where("k = 2").first()["criticality"] == 1
    mean = sequence.exponential_mean(frame, ["k"], ["i"], "x", 18).where("k = 1").orderBy("i").toPandas()["x_ewm18"].astype(float)
    assert np.allclose(mean, pd.Series(x).ewm(span=18, ignore_na=True, min_periods=6).mean(), equal_nan=True)
    assert sequence.criticality(frame.where("false"), ["k"], ["i"], "flag", "normal").count() == 0


def test_citations_are_checked_on_their_pages(spark):
    pages = [
        (1, 0, "hk", "Tender October 2017", 14, "depths of 17.1 to 27.2 m"), (1, 1, "hk", "Tender October 2017", 20, "page twenty, 5 km"), (1, 2, "zz", "Other sheet", 20, "a depth of 99 m"), (2, 0, "a", "A", 3, "x"),
    ]
    context = spark.createDataFrame(pages, "answer_id int, place long, doc_id string, title string, page long, text string")
    answers = [
        (1, "Tender October 2017: depths of 17.1 to 27.2 m (p.20). It is 5 km wide (p. 20), and Other sheet says 99 m, p.20."), (2, "No numbers here p.3 and none p.77"), (3, "no citation"), (4, "cites p.5 without pages"),
    ]
    got = {r["answer_id"]: (r["text"], [tuple(c) for c in r["cited"] or []]) for r in retrieval.checked_citations(spark.createDataFrame(answers, "answer_id int, answer string"), context).collect()}
    assert got[1][0] == "Tender October 2017: depths of 17.1 to 27.2 m (p.14). It is 5 km wide (p.20), and Other sheet says 99 m, p.20."
    assert got[1][1] == [("Tender October 2017", 14), ("Tender October 2017", 20), ("Other sheet", 20)]
    assert got[2] == ("No numbers here p.3 and none p.77", [("A", 3)]) and got[3] == ("no citation", []) and got[4][0] == "cites p.5 without pages"


def test_order_along_a_line(spark):
    from windloom.operators import layouts

    orders = {"x": [3, 1, 4, 2, 5], "y": [(7 * k) % 40 for k in range(40)]}
    pairs = []
    for farm, order in orders.items():
        place = {t: k for k, t in enumerate(order)}
        pairs += [(farm, a, b, 1 - (0.3 if farm == "x" else 0.12) * abs(place[a] - place[b])) for a in order for b in order if a < b]
    got = layouts.along_line(spark.createDataFrame(pairs, "farm string, a int, b int, r double")).collect()
    for farm, order in orders.items():
        own = [r.turbine for r in sorted((r for r in got if r.farm == farm), key=lambda r: r["rank"])]
        assert own in (order, order[::-1])
        assert np.corrcoef(own, range(len(own)))[0, 1] >= 0


def test_correlations_with_gaps_and_the_layout(spark):
    from windloom.operators import layouts

    rng = np.random.default_rng(2)
    n, turbines = 400, [5, 2, 8, 1, 9, 3, 7]  # in order along the line
    waves = np.cumsum(rng.normal(0, 1, (n, len(turbines) + 3)), axis=1)[:, 2:] + rng.normal(0, 0.2, (n, len(turbines) + 1))
    table = pd.DataFrame(np.array([waves[:, max(0, k - 1) : k + 2].mean(1) - waves.mean(1) for k in range(len(turbines))]).T, columns=turbines)
    table = table.mask(rng.random(table.shape) < 0.1)
    rows = [("f", t, i, None if np.isnan(v) else float(v), 1) for t in turbines for i, v in enumerate(table[t])]
    df = spark.createDataFrame(rows, "farm string, turbine int, ts int, power double, n int")
    got = {(r.a, r.b): r.r for r in layouts.correlations(df, "power").collect()}
    want = table.corr()
    assert got == pytest.approx({(a, b): want.loc[a, b] for a in turbines for b in turbines if a < b}, abs=1e-9)
    spots = spark.createDataFrame([("f", f"P{k}", 50 - 0.002 * k, 8 + 0.004 * k) for k in range(len(turbines))], "farm string, spot string, lat double, lon double")
    found = [r.turbine for r in layouts.inferred_layout(df, spots).orderBy("spot").collect()]
    assert found in (turbines, turbines[::-1])


def test_recursive_forecast_is_one_plan(spark):
    """A model that adds one to the last value, twelve steps ahead."""

    class PlusOne:
        def transform(self, rows):
            return rows.withColumns({"features": F.lit(0), "prediction": F.col("lag_1") + 1 + 0 * F.col("lag_2")})

    origins = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 10.0])], "origin int, history array<double>")
    got = sorted(map(tuple, models.recursive(PlusOne(), origins, [1, 2], 12).collect()))
    assert got == sorted((o, k, base + k) for o, base in ((1, 3.0), (2, 10.0)) for k in range(1, 13))


def test_holt_winters_on_a_season(spark):
    y = [10 + 5 * math.sin(2 * math.pi * k / 24) + 0.01 * k for k in range(24 * 20)]
    frame = spark.createDataFrame([("a", k, v) for k, v in enumerate(y)] + [("short", 0, 1.0)], "g string, h int, x double")
    got = {(r["g"], r["lead"]): r["prediction"] for r in models.holt_winters(frame, "g", "h", "x").collect()}
    assert len(got) == 24
    for k in range(1, 25):
        assert got["a", k] == pytest.approx(10 + 5 * math.sin(2 * math.pi * (479 + k) / 24) + 0.01 * (479 + k), abs=0.3)


def test_vector_autoregression_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.zeros((300, 2))
    for k in range(2, 300):
        x[k] = 1 + np.array([[0.5, 0.2], [-0.1, 0.6]]) @ x[k - 1] + np.array([[0.1, 0], [0, 0.05]]) @ x[k - 2] + rng.normal(0, 0.1, 2)
    frame = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "h long, a double, b double")
    got = np.array([(r["a"], r["b"]) for r in models.vector_autoregression(frame, "h", ["a", "b"], 2, 5).orderBy("lead").collect()])
    design = np.c_[np.ones(298), x[1:-1], x[:-2]]
    w = np.linalg.lstsq(design, x[2:], rcond=None)[0]
    last = [x[-1], x[-2]]
    for row in got:
        new = np.r_[1.0, last[0], last[1]] @ w
        assert row == pytest.approx(new, abs=1e-6)
        last = [new, last[0]]
    assert models.vector_autoregression(frame.where("h < 2"), "h", ["a", "b"], 2).count() == 0


def test_boosted_trees_learn_a_step(spark):
    frame = spark.createDataFrame([(float(k % 10), 5.0 if k % 10 > 4 else 1.0, float(k % 7)) for k in range(200)], "a double, y double, z double")
    model = models.boosted(frame, ["a", "z"], "y", trees=5, rate=0.5)
    assert [r["feature"] for r in models.importances(model, ["a", "z"], spark).orderBy("position").collect()] == ["a", "z"]
    got = {r["a"]: r["prediction"] for r in models.predict(model, frame).collect()}
    assert got[0.0] == pytest.approx(1, abs=0.2) and got[9.0] == pytest.approx(5, abs=0.2)


def test_sessions_and_model_versions(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from windloom.sources import stores

    path = f"{tmp_path}/sessions"
    for key, payload in (("a", '{"n": 1}'), ("b", '{"n": 2}'), ("a", '{"n": 3}')):
        stores.put_session(spark, path, key, payload)
    assert stores.get_session(spark, path, "a") == '{"n": 3}' and stores.get_session(spark, path, "zz") is None and stores.sessions(spark, path).count() == 2
    frame = spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(10)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(frame)
    assert stores.export_model(model, f"{tmp_path}/models", "v1") and not stores.export_model(model, f"{tmp_path}/models", "v1")
    assert stores.load_model(f"{tmp_path}/models", "v1").transform(frame).where("abs(prediction - y) < 0.001").count() == 10


def test_queries_are_listed_without_a_session():
    """The entry point is imported, and its queries and SQL are listed, before any session exists."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 150, done.stderr[-500:]


@pytest.mark.parametrize("horizon", [10, 24, 30, 48])
def test_live_forecasts_at_any_horizon(spark, horizon):
    from windloom.operators import studies

    rows = [(f, k, float(k % 24 + (f == "b"))) for f in "ab" for k in range(72)]
    got = studies.live_forecasts(spark.createDataFrame(rows, "farm string, h int, v double"), "farm", "h", "v", horizon).collect()
    for technique in ("seasonal", "holt-winters"):
        for f in "ab":
            assert sorted(r.lead for r in got if (r.farm, r.technique) == (f, technique)) == list(range(1, horizon + 1))
    assert all(r.prediction == (r.lead - 1) % 24 + (r.farm == "b") for r in got if r.technique == "seasonal")


def test_recurrences_with_many_keys_and_null_keys_a_part(spark):
    rng, rows = np.random.default_rng(8), []
    for key in [*range(40), None]:
        rows += [(key, "x" if key is None or key % 2 else None, i, bool(rng.integers(0, 2)), bool(rng.integers(0, 4))) for i in range(int(rng.integers(1, 30)))]
    rows += [(99, "hot", i, bool(rng.integers(0, 2)), True) for i in range(900)]
    got = sequence.criticality(spark.createDataFrame(rows, "k int, g string, i int, f boolean, n boolean"), ["k", "g"], ["i"], "f", "n", 5).collect()
    want, state = {}, {}
    for k, g, i, f, n in rows:
        c = state.get((k, g), 0)
        state[k, g] = want[k, g, i] = min(5, max(0, c + (1 if f else -1))) if n else c
    assert {(r.k, r.g, r.i): r.criticality for r in got} == want


def test_yaw_behind_the_vane_gate(spark):
    rng, rows = np.random.default_rng(12), []
    for farm, spread in (("moves", 9.0), ("still", 1.0)):
        for turbine, offset in ((1, 4.0), (2, -3.0)):
            for angle in rng.normal(0, spread, 800):
                rows.append((farm, turbine, float(angle), float(rng.uniform(3, 10)), 5.0, float(100 * np.cos(np.radians(angle - offset)))))
    rows += [("moves", 1, None, 6.0, 5.0, 1e9), ("moves", 1, 0.0, 6.0, -1.0, 1e9), ("moves", 1, 60.0, 6.0, 5.0, 1e9)]
    got = {(r.farm, r.turbine): r for r in models.gated_yaw(spark.createDataFrame(rows, "farm string, turbine int, angle double, wind double, power double, value double")).collect()}
    assert {k: r.status for k, r in got.items()} == {("moves", 1): "fitted", ("moves", 2): "fitted", ("still", 1): "not identifiable", ("still", 2): "not identifiable"}
    assert got["moves", 1].offset_deg == pytest.approx(4.0, abs=1e-6) and got["moves", 2].offset_deg == pytest.approx(-3.0, abs=1e-6)
    assert got["still", 1].offset_deg is None and got["still", 1].vane_std < 4 < got["moves", 1].vane_std

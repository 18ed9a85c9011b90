"""Cause models from one pass against a fit of every sensor by itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windloom.operators import causes, watch


@pytest.fixture(scope="module")
def cases():
    rng, frames = np.random.default_rng(11), []
    for case in (1, 2):
        n = 700
        wind, temperature = rng.uniform(3, 12, n), np.cumsum(rng.normal(0, 0.3, n))
        own = pd.DataFrame({"case": case, "i": np.arange(n), "wind": wind, "temperature": temperature})
        own["power"] = wind**2 * (1 + case / 10) + rng.normal(0, 1, n)
        own["bearing"] = 0.5 * temperature + 0.1 * own["power"] + rng.normal(0, 0.1, n)
        own["noise"] = rng.normal(0, 1, n)
        for c in ("power", "bearing", "temperature"):
            own.loc[rng.random(n) < 0.03, c] = np.nan
        own.loc[(own.i >= 640) & (own.case == 1), "bearing"] += 3.0
        frames.append(own)
    return pd.concat(frames)


def test_models_thresholds_and_warnings(spark, cases):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in cases.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "case int, i int, wind double, temperature double, power double, bearing double, noise double")
    table, inputs = causes.design(df, "case", ["i"], ["wind", "temperature"], ["wind"], (4, 12))
    assert list(inputs) == ["wind", "temperature", "wind_ewm4", "wind_ewm12", "temperature_ewm4", "temperature_ewm12", "wind_sq"]
    targets = ["wind", "power", "bearing", "noise"]
    fitted = causes.fit(table, "case", inputs, targets, F.col("i") < 400, least=100)
    res = causes.residuals(table, "case", ["i"], inputs, targets, fitted, [])
    got = res.toPandas()
    wide = table.toPandas().sort_values(["case", "i"])
    for case in (1, 2):
        own = wide[wide.case == case]
        for t in targets:
            use = [c for c in inputs if inputs[c] != t]
            x, y = own[list(inputs)].to_numpy(float), own[t].to_numpy(float)
            whole = ~np.isnan(x).any(axis=1)
            train = whole & ~np.isnan(y) & (own["i"].to_numpy() < 400)
            x = own[use].to_numpy(float)
            mean, sd = x[train].mean(0), x[train].std(0)
            z = (x - mean) / sd
            w = np.linalg.solve(z[train].T @ z[train] + np.eye(len(use)), z[train].T @ (y[train] - y[train].mean()))
            want = np.where(whole, z @ w + y[train].mean(), np.nan)
            mine = got[(got.case == case) & (got.sensor == t)].sort_values("i")["fitted"].to_numpy(float)
            assert mine == pytest.approx(want, nan_ok=True, abs=1e-8)
    limits = causes.thresholds(res, "case", F.col("i").between(400, 599), (0.9, 0.99))
    by = {(r.case, r.sensor, r.quantile): r for r in limits.collect()}
    assert len(by) == 16
    for (case, sensor, q), r in by.items():
        own = got[(got.case == case) & (got.sensor == sensor) & got.i.between(400, 599)]
        e = (own["y"] - own["fitted"]).abs().dropna()
        assert r.threshold == pytest.approx(np.quantile(e, q))
        assert r.n == len(e)
        assert r.watched == (sensor in ("power", "bearing"))
    days = causes.episode_days(res, "case", ["i"], F.floor(F.col("i") / 10), limits, F.col("i").between(400, 599), F.col("i") >= 600)
    rules = spark.createDataFrame([(1, 0.99, "cusum", 4.0, 0.001, 0.1, 1, 1)], "rule_id int, quantile double, method string, factor double, alpha double, beta double, least int, persist int")
    warned = watch.warnings(days, rules).collect()
    assert {(r.event_id, r.sensor) for r in warned} == {(c, s) for c in (1, 2) for s in ("power", "bearing")}
    first = days.where("event_id = 1 and sensor = 'bearing' and quantile = 0.99").agg(F.sum("episodes"), F.sum("monitored")).first()
    assert first[0] >= 1 and first[1] > 80
    assert causes.fit(table.where("false"), "case", inputs, targets, F.lit(True)).count() == 0
    assert causes.fit(table, "case", inputs, targets, F.col("i") < 400, least=1000).count() == 0

"""State-space models in parts against plain filters and dense smoothers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.operators import statespace as ss


def plain(model, y, k=0):
    """A textbook filter of one parameter set: squares, log determinants, rows, and the last filtered mean."""
    t, q, z, h = model.transition[k], model.noise[k], model.seen, model.error[k]
    mean, cov = np.zeros(len(z)), np.eye(len(z)) * ss.DIFFUSE
    squares = dets = n = 0
    for v in y:
        mean, cov = t @ mean, t @ cov @ t.T + q
        if np.isnan(v):
            continue
        s = z @ cov @ z + h
        gain = cov @ z / s
        e = v - z @ mean
        mean, cov = mean + gain * e, cov - np.outer(gain, z @ cov)
        squares, dets, n = squares + e * e / s, dets + np.log(s), n + 1
    return squares, dets, n, mean


def dense(model, y):
    """Smoothed states and signal by one Gaussian conditioning over all rows at once."""
    t, q, z, h = model.transition[0], model.noise[0], model.seen, model.error[0]
    m, n = len(z), len(y)
    big = np.zeros((n * m, n * m))
    prior = np.eye(m) * ss.DIFFUSE
    for i in range(n):
        prior = t @ prior @ t.T + q
        big[i * m : (i + 1) * m, i * m : (i + 1) * m] = prior
        step = prior
        for k in range(i + 1, n):
            step = t @ step
            big[k * m : (k + 1) * m, i * m : (i + 1) * m] = step
            big[i * m : (i + 1) * m, k * m : (k + 1) * m] = step.T
    see = np.kron(np.eye(n), z)
    own = ~np.isnan(y)
    cov = big @ see[own].T
    weight = np.linalg.solve(see[own] @ cov + h * np.eye(own.sum()), cov.T).T
    states = (weight @ y[own]).reshape(n, m)
    return states, states @ z


@pytest.fixture(scope="module")
def wave():
    rng = np.random.default_rng(1)
    n = 300
    y = 40 + np.cumsum(rng.normal(0, 0.6, n)) + 5 * np.sin(np.arange(n) * 2 * np.pi / 24) + rng.normal(0, 1, n)
    y[[17, 18, 140]] = np.nan
    return y


MODELS = {
    "sarima": ss.sarima(np.array([0.5, -0.3, 0.9]), np.array([-0.4, 0.7, 0.2]), np.array([0.3, 0.0, -0.6])),
    "structural": ss.structural(np.array([0.3, 2.0, 0.01]), None, np.array([0.05, 0.2, 1e-4])),
    "trend": ss.structural(np.array([0.3, 2.0]), np.array([0.01, 0.1]), np.array([0.05, 0.2])),
}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("cuts", [[], [100], [1, 30, 31, 140, 299]])
def test_effects_compose_to_the_plain_filter(wave, name, cuts):
    model, state, total = MODELS[name], MODELS[name].entry, [0, 0, 0]
    for own in np.split(wave, cuts):
        made = ss.effect(model, own)
        state, squares, dets = ss.enter(state, made)
        total = [a + b for a, b in zip(total, (squares, dets, made[-1]), strict=True)]
    for k in range(len(model.error)):
        squares, dets, n, mean = plain(model, wave, k)
        assert total[0][k] == pytest.approx(squares, rel=1e-8)
        assert total[1][k] == pytest.approx(dets, rel=1e-8)
        assert total[2][k] == n
        assert state[0][k] == pytest.approx(mean, rel=1e-6, abs=1e-6)


def test_sarima_is_the_difference_equation():
    """Impulse responses of the state form and of (1 - aB)(1 - sB^4)(1 - B) y = (1 + mB) e."""
    a, m, s, n = 0.6, -0.3, 0.4, 30
    model = ss.sarima(np.array([a]), np.array([m]), np.array([s]), 4)
    e = np.zeros(n)
    e[0] = 1
    poly = np.convolve(np.convolve([1, -a], [1, 0, 0, 0, -s]), [1, -1])
    y = np.zeros(n)
    for i in range(n):
        y[i] = e[i] + (m * e[i - 1] if i else 0) - sum(poly[k] * y[i - k] for k in range(1, len(poly)) if i >= k)
    x, got = np.zeros(6), []
    for i in range(n):
        x = model.transition[0] @ x + (np.array([0, 1, m, 0, 0, 0]) if i == 0 else 0)
        got.append(model.seen @ x)
    assert got == pytest.approx(y)


def test_smoothing_is_holt_winters():
    rng = np.random.default_rng(2)
    y, a, b, g, season = rng.normal(10, 2, 60), 0.3, 0.1, 0.2, 4
    level, trend, s = 9.0, 0.1, [1.0, -1.0, 0.5, -0.5]
    model = ss.smoothing(np.array([a]), np.array([b]), np.array([g]), np.array([level, trend, *s]), season)
    want = []
    for i, v in enumerate(y):
        want.append(level + trend + s[i % season])
        old, k = level, i % season
        level = a * (v - s[k]) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        s[k] = g * (v - level) + (1 - g) * s[k]
    got = [mean @ model.seen for mean, *_ in ss.walk(model, y, model.entry)]
    assert got == pytest.approx(want)
    squares = ss.enter(model.entry, ss.effect(model, y))[1]
    assert squares[0] == pytest.approx(((y - want) ** 2).sum())


structural = lambda params, consts: ss.structural(10 ** params[:, 0], None, 10 ** params[:, 1], 6)


@pytest.fixture(scope="module")
def series(spark):
    rng, rows = np.random.default_rng(3), []
    for g in ("a", "b"):
        y = np.cumsum(rng.normal(0, 0.7, 130)) + 3 * np.sin(np.arange(130) * np.pi / 3) + rng.normal(0, 1, 130)
        rows += [(g, k, None if k in (5, 60) else float(v), "x") for k, v in enumerate(y)]
    rows.append((None, 0, 1.0, "x"))
    return spark.createDataFrame(rows, "farm string, i long, v double, part string")


def of(series, farm):
    pdf = series.where(F.col("farm") == farm).orderBy("i").toPandas()
    return pdf["v"].to_numpy(float)


def test_smoothed_states_equal_dense_conditioning(spark, series):
    parts = ss.parts_of(series, "farm", "i", "v", 40)
    assert parts.groupBy("farm").count().agg(F.min("count")).first()[0] >= 2
    fitted = spark.createDataFrame([("a", [-0.5, -1.0], []), ("b", [0.3, -2.0], [])], "farm string, params array<double>, consts array<double>")
    got = ss.smoothed(parts, "farm", structural, fitted).orderBy("farm", "at").toPandas()
    for farm, params in (("a", [-0.5, -1.0]), ("b", [0.3, -2.0])):
        own = got[got.farm == farm]
        states, signal = dense(structural(np.array([params]), None), of(series, farm))
        assert own["signal"].to_numpy() == pytest.approx(signal, abs=1e-4)
        assert np.array(own["states"].tolist()) == pytest.approx(states, abs=2e-3)


def test_fit_and_expectation_maximisation(spark, series):
    parts = ss.parts_of(series, "farm", "i", "v", 40)
    fitted = ss.fit(parts, "farm", structural, [-3, -4], [2, 1], points=9, rounds=4)
    lattice = [np.linspace(-3, 2, 41), np.linspace(-4, 1, 41)]
    for r in fitted.collect():
        y = of(series, r.farm)
        model = structural(np.array([[a, b] for a in lattice[0] for b in lattice[1]]), None)
        squares, dets = ss.enter(model.entry, ss.effect(model, y))[1:]
        best = ss.log_likelihood(squares, dets, np.full(len(dets), (~np.isnan(y)).sum())).max()
        assert r.loglik > best - 0.05
        s, d, n, _ = plain(structural(np.array([r.params]), None), y)
        assert r.loglik == pytest.approx(ss.log_likelihood(np.array([s]), np.array([d]), np.array([n]))[0], rel=1e-8)
        assert r.scale == pytest.approx(s / n, rel=1e-8)
    poor = spark.createDataFrame([("a", [1.5, 0.5], []), ("b", [-2.0, -3.0], [])], "farm string, params array<double>, consts array<double>")
    before = {r.farm: r.loglik for r in ss.likelihoods(parts, "farm", structural, poor.select("farm", F.array("params").alias("params"), "consts")).collect()}
    once = ss.refit(parts, "farm", structural, poor, [0, 1])
    twice = ss.refit(parts, "farm", structural, once, [0, 1])
    for r, s in zip(once.orderBy("farm").collect(), twice.orderBy("farm").collect(), strict=True):
        assert before[r.farm] < r.loglik < s.loglik


def test_forecasts_use_no_row_after_their_origin(spark, series):
    parts = ss.parts_of(series, "farm", "i", "v", 40)
    make = lambda p, c: ss.sarima(p[:, 0], p[:, 1], p[:, 2], 6)
    fitted = spark.createDataFrame([(f, [0.4, -0.2, 0.3], []) for f in "ab"], "farm string, params array<double>, consts array<double>")
    origins = spark.createDataFrame([(f, k) for f in "ab" for k in (0, 39, 40, 100, 129, 500)], "farm string, origin long")
    got = ss.forecasts(parts, "farm", make, fitted, origins, 5).toPandas()
    assert sorted(set(got["origin"])) == [0, 39, 40, 100, 129]
    model = make(np.array([[0.4, -0.2, 0.3]]), None)
    for (farm, origin), own in got.groupby(["farm", "origin"]):
        x, want = plain(model, of(series, farm)[: origin + 1])[3], []
        for _ in range(5):
            x = model.transition[0] @ x
            want.append(x @ model.seen)
        assert own.sort_values("lead")["predicted"].to_numpy() == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_empty_series(spark, series):
    parts = ss.parts_of(series.where("false"), "farm", "i", "v")
    assert ss.fit(parts, "farm", structural, [-1, -1], [1, 1], points=3, rounds=2).count() == 0


def test_backtest_windows_and_fit_without_scored_rows(spark, series):
    parts = ss.parts_of(series, "farm", "i", "v", 40)
    rows = ss.scored_rows(parts, "farm", 0.8, 8).orderBy("farm", "at").toPandas()
    assert rows[rows.farm == "a"]["at"].tolist() == list(range(104, 128))
    assert rows[rows.farm == "a"]["origin"].tolist() == [103] * 8 + [111] * 8 + [119] * 8
    assert rows[rows.farm == "a"]["lead"].tolist() == [*range(1, 9)] * 3
    known = ss.training(parts, "farm", 0.8)
    other = series.withColumn("v", F.when(F.col("i") >= 104, F.lit(1e6)).otherwise(F.col("v")))
    again = ss.training(ss.parts_of(other, "farm", "i", "v", 40), "farm", 0.8)
    a, b = (ss.fit(x, "farm", ss.structural_maker(6), *ss.STRUCTURAL_BOX, points=3, rounds=3).orderBy("farm").collect() for x in (known, again))
    assert [r.params for r in a] == [r.params for r in b]
    got = ss.backtest(parts, "farm", ss.structural_maker(6), spark.createDataFrame(a, "farm string, params array<double>, loglik double, scale double, consts array<double>"), 0.8, 8)
    assert got.count() == len(rows)
    error = got.where("actual is not null").agg(F.avg(F.abs(F.col("actual") - F.col("predicted")))).first()[0]
    assert error < 4


def test_fitted_smoothing_is_no_worse_than_a_grid(spark, series):
    parts = ss.parts_of(series, "farm", "i", "v", 40)
    consts = ss.smoothing_start(series, "farm", "i", "v", 6)
    fitted = ss.fit(parts, "farm", ss.smoothing_maker(6), *ss.SMOOTHING_BOX, consts=consts, points=3, rounds=9, shrink=0.7)
    values = ss.fitted_values(parts, "farm", ss.smoothing_maker(6), fitted)
    for r in fitted.collect():
        y = of(series, r.farm)
        grid = np.array([[a, b, g] for a in np.linspace(0.01, 0.99, 12) for b in np.linspace(0, 0.5, 8) for g in np.linspace(0, 0.99, 8)])
        model = ss.smoothing_maker(6)(grid, np.array(r.consts))
        best = ss.enter(model.entry, ss.effect(model, y))[1].min()
        own = values.where((F.col("farm") == r.farm) & ~F.isnan("actual")).agg(F.sum(F.pow(F.col("actual") - F.col("predicted"), 2))).first()[0]
        assert own <= best * 1.01
        assert own == pytest.approx(r.scale * (~np.isnan(y)).sum(), rel=1e-6)

"""Boosted trees with vector leaves against a brute-force search."""

from __future__ import annotations

import numpy as np
import pytest

from windloom.operators import boosting


def brute_tree(x, residual, depth, least):
    """Leaf vector of each row by trying every cut between distinct values of every feature."""
    if depth == 0:
        return np.tile(residual.mean(0), (len(x), 1))
    best, choice = 1e-9, None
    square = lambda r: (r.sum(0) ** 2).sum() / len(r)
    for k in range(x.shape[1]):
        for v in np.unique(x[:, k])[:-1]:
            left = x[:, k] <= v
            if min(left.sum(), (~left).sum()) >= least and (gain := square(residual[left]) + square(residual[~left]) - square(residual)) > best * (1 + 1e-12):
                best, choice = gain, left
    if choice is None:
        return np.tile(residual.mean(0), (len(x), 1))
    out = np.zeros_like(residual)
    for side in (choice, ~choice):
        out[side] = brute_tree(x[side], residual[side], depth - 1, least)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    made = {}
    for g, n in (("a", 150), ("b", 90)):
        x = rng.integers(0, 12, (n, 4)).astype(float)
        made[g] = (x, np.stack([np.sin(x[:, 0]) + x[:, 1] * 0.2, x[:, 2] > 5, x[:, 0] * x[:, 3] / 20], 1) + rng.normal(0, 0.1, (n, 3)))
    return made


@pytest.mark.parametrize(("kept", "block", "most"), [(10, 4096, 1000), (10, 4096, 0), (2, 16, 100)])
def test_equal_to_brute_force(spark, data, kept, block, most, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", most)
    monkeypatch.setattr(boosting, "TREES_KEPT", kept)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
    rows = [(g, x.tolist(), y.tolist()) for g, (xs, ys) in data.items() for x, y in zip(xs, ys, strict=True)]
    rows += [("a", [None, 1.0, 1.0, 1.0], [0.0, 0.0, 0.0]), (None, [1.0] * 4, [0.0] * 3), ("c", [1.0] * 4, [0.0] * 3)]
    df = spark.createDataFrame(rows, "farm string, x array<double>, y array<double>")
    model = boosting.boosted(df, "farm", trees=5, depth=3, rate=0.3, least=5)
    assert set(model.trees) == {"a", "b"}
    got = model.predict(df.select("farm", "x")).collect()
    for g, (x, y) in data.items():
        f = np.tile(y.mean(0), (len(y), 1))
        for _ in range(5):
            f = f + 0.3 * brute_tree(x, y - f, 3, 5)
        want = {tuple(a): b for a, b in zip(x.tolist(), f, strict=True)}
        own = [r for r in got if r.farm == g and None not in r.x]
        assert len(own) == len(x)
        for r in own:
            assert r.predicted == pytest.approx(want[tuple(r.x)], abs=1e-9)
    assert [r.predicted for r in got if r.farm not in data or None in r.x] == [None] * 3


def test_more_values_than_bins_and_equal_rows(spark):
    rng = np.random.default_rng(5)
    rows = [("a", [float(v)], [float(v > 0)]) for v in rng.normal(0, 1, 2000)] + [("same", [1.0], [2.0])] * 50
    df = spark.createDataFrame(rows, "farm string, x array<double>, y array<double>")
    model = boosting.boosted(df, "farm", trees=8, depth=1, rate=0.5)
    got = model.predict(df).collect()
    assert np.mean([abs(r.predicted[0] - r.y[0]) for r in got if r.farm == "a"]) < 0.05
    assert {r.predicted[0] for r in got if r.farm == "same"} == {2.0}


def test_recursive_walk_is_round_by_round(spark):
    rng = np.random.default_rng(6)
    series = {g: np.sin(np.arange(160) / (3 + k)) + rng.normal(0, 0.05, 160) for k, g in enumerate("ab")}
    lags = [1, 2, 5]
    rows = [(g, [float(v[i - k]) for k in lags], [float(v[i])]) for g, v in series.items() for i in range(5, 140)]
    model = boosting.boosted(spark.createDataFrame(rows, "farm string, x array<double>, y array<double>"), "farm", trees=12, depth=3)
    origins = [(g, i, v[: i + 1].tolist()) for g, v in series.items() for i in (10, 140, 155)] + [("a", 1, [1.0]), ("a", 2, [None] * 9), ("z", 3, [1.0] * 9)]
    got = boosting.recursive(model, spark.createDataFrame(origins, "farm string, origin int, history array<double>"), lags, 6).collect()
    assert len(got) == 6 * 6
    for g, i, history in origins[:6]:
        past = list(history)
        for lead in range(1, 7):
            past.append(float(model.predict_rows(g, np.array([[past[-k] for k in lags]]))[0, 0]))
            assert next(r.predicted for r in got if (r.farm, r.origin, r.lead) == (g, i, lead)) == pytest.approx(past[-1])

"""Daily additive yield model and long-term wake losses against copied rows in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from windloom.operators import yields


def de_boor(x, low, high, n):
    """Cubic B-splines by the recursion, on even knots that go on beyond the range."""
    width = (high - low) / (n - 3)
    knots = low + width * np.arange(-3, n + 1)
    x = np.clip(x, low, high)
    made = [np.where((x >= a) & (a < high - 1e-9) & ((x < b) | (b > high - 1e-9)), 1.0, 0.0) for a, b in zip(knots, knots[1:])]
    for d in range(1, 4):
        made = [(x - knots[k]) / (d * width) * made[k] + (knots[k + d + 1] - x) / (d * width) * made[k + 1] for k in range(len(made) - 1)]
    return np.array(made).T


def picks(draw, n):
    return [int(hashlib.md5(f"{draw}:{p}".encode()).hexdigest()[:8], 16) % n for p in range(n)]


def test_basis_is_the_recursion():
    x = np.linspace(-1, 11, 200)
    basis = yields.Basis(np.array([0.0, -5.0]), np.array([10.0, 20.0]), (7, 5))
    made = basis.values(np.column_stack([x, 2 * x]))
    assert made[:, :7] == pytest.approx(de_boor(x, 0, 10, 7), abs=1e-12)
    assert made[:, 7:] == pytest.approx(de_boor(2 * x, -5, 20, 5), abs=1e-12)
    assert made.sum(1) == pytest.approx(np.full(200, 2.0))


@pytest.fixture(scope="module")
def days():
    rng = np.random.default_rng(7)
    wind, temperature = rng.uniform(2, 14, 90), rng.normal(8, 5, 90)
    return np.column_stack([np.arange(90) * 3, np.minimum(wind**2, 120) - temperature + rng.normal(0, 4, 90), wind, temperature])


def test_yield_equals_fits_of_copied_days(spark, days):
    rows = [(int(d), float(e), float(w), float(t), "x") for d, e, w, t in days] + [(1000, None, 1.0, 1.0, "x"), (1001, 1.0, None, 1.0, "x")]
    table = spark.createDataFrame(rows, "day int, energy double, wind double, temperature double, n string")
    year = [(float(v), float(v)) for v in np.linspace(1, 16, 40)]
    got = {r.draw: r for r in yields.gam_yield(table, spark.createDataFrame(year, "wind double, temperature double"), 4, (8, 5), 0.0, 0.0).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    low, high = days[:, 2:].min(0), days[:, 2:].max(0)
    design = lambda x: np.concatenate([de_boor(x[:, 0], low[0], high[0], 8), de_boor(x[:, 1], low[1], high[1], 5)], 1)
    d8, d5 = np.diff(np.eye(8), 2, axis=0), np.diff(np.eye(5), 2, axis=0)
    penalty = np.block([[d8.T @ d8, np.zeros((8, 5))], [np.zeros((5, 8)), d5.T @ d5 + yields.APART * np.eye(5)]])
    for draw, r in got.items():
        own = days[picks(draw, 90)]
        x, y = design(own[:, 2:]), own[:, 1]
        best = None
        for weight in yields.PENALTIES:
            g = x.T @ x
            hat = x @ np.linalg.solve(g + weight * np.trace(g) / 13 * penalty, x.T)
            left = ((y - hat @ y) ** 2).sum()
            score = 90 * left / (90 - np.trace(hat)) ** 2
            if best is None or score < best[0]:
                c = np.linalg.solve(g + weight * np.trace(g) / 13 * penalty, x.T @ y)
                best = score, weight, np.trace(hat), design(np.array(year)).mean(0) @ c * yields.YEAR
        assert r.penalty == pytest.approx(best[1])
        assert r.freedom == pytest.approx(best[2], rel=1e-5)
        assert r.aep == pytest.approx(best[3], rel=1e-5)


def test_too_few_days_and_constant_columns(spark):
    schema = "day int, energy double, wind double, temperature double"
    few = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], schema)
    assert yields.gam_yield(few, few, 3).count() == 0
    assert yields.gam_yield(few.where("false"), few, 3).count() == 0
    flat = spark.createDataFrame([(k, 5.0, 3.0, 1.0) for k in range(40)], schema)
    got = yields.gam_yield(flat, flat, 3, (6, 4), 0.0, 0.0).collect()
    assert [r.aep for r in got] == pytest.approx([5.0 * yields.YEAR] * 3, rel=1e-4)


def test_long_term_wake_equals_copied_days(spark):
    rng, rows = np.random.default_rng(8), []
    for day in range(30):
        for d in range(3):
            for s in range(2):
                if rng.random() < 0.7:
                    rows.append((day, d, s, float(rng.uniform(1, 5)), float(rng.uniform(5, 9)), int(rng.integers(1, 9))))
    bins = spark.createDataFrame(rows, "day_no long, direction int, speed int, power double, free double, records long")
    hours = {(d, s): float(rng.uniform(1, 100)) for d in range(3) for s in range(3) if (d, s) != (1, 1)}
    got = yields.long_term_wake(bins, spark.createDataFrame([(*k, v) for k, v in hours.items()], "direction int, speed int, hours double"), 5).collect()
    assert len(got) == 5
    for r in got:
        power, free = {}, {}
        n = {}
        for p in picks(r.draw, 30):
            for day, d, s, a, b, k in rows:
                if day == p:
                    power[d, s], free[d, s], n[d, s] = power.get((d, s), 0) + a, free.get((d, s), 0) + b, n.get((d, s), 0) + k
        assert r.loss_pct == pytest.approx(100 * (1 - sum(power.values()) / sum(free.values())))
        both = [k for k in power if k in hours]
        assert r.loss_lt_pct == pytest.approx(100 * (1 - sum(power[k] / n[k] * hours[k] for k in both) / sum(free[k] / n[k] * hours[k] for k in both)))

"""The classifiers' solvers against slow ones that follow the definitions."""

from __future__ import annotations

import numpy as np
import pytest

from windloom.llm import quality, toxicity


def test_hinge_loss_against_projected_gradient():
    rng = np.random.default_rng(1)
    n, size = 50, 30
    rows = [np.sort(rng.choice(size, 8, replace=False)) for _ in range(n)]
    values = [rng.normal(0, 1, 8) for _ in range(n)]
    values = [v / np.linalg.norm(v) for v in values]
    x = np.zeros((n, size + 1))
    for i in range(n):
        x[i, rows[i]], x[i, size] = values[i], 1.0
    sign = np.where(x[:, :size] @ rng.normal(0, 1, size) + rng.normal(0, 0.3, n) > 0, 1.0, -1.0)
    cost = np.where(sign > 0, 1.5, 0.7)
    z = x * sign[:, None]
    gram, alpha = z @ z.T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    primal = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - z @ w)
    best = z.T @ alpha
    assert primal(best) - (alpha.sum() - 0.5 * best @ best) < 1e-6
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "PASSES", 500)
        w, bias = quality.descend(rows, values, sign, cost, size)
    assert primal(np.r_[w, bias]) == pytest.approx(primal(best), rel=1e-2)
    w, bias = quality.descend(rows, values, sign, cost, size)
    assert primal(np.r_[w, bias]) < 1.05 * primal(best)


def test_log_count_ratios_are_direct_counts():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, int(rng.integers(1, 12)), replace=False)) for _ in range(80)]
    y = (np.arange(80) % 3 == 0).astype(int)
    model = quality.fit_rows(rows, y)
    train = [i for i in range(80) if i % quality.CALIBRATION]
    counts = np.full((2, quality.BUCKETS), quality.SMOOTH)
    for i in train:
        for b in rows[i]:
            counts[y[i], b] += 1
    for b in range(40):
        want = np.log(counts[1, b] / counts[1].sum()) - np.log(counts[0, b] / counts[0].sum())
        assert model.ratio[b] == pytest.approx(want if counts[:, b].sum() > 2 * quality.SMOOTH else 0.0)
    assert not model.ratio[40:].any()


def by_definition(score, start=0):
    """The best segment, and those of what lies left and right of it."""
    if not len(score) or score.max() <= 0:
        return []
    sums = np.r_[0, np.cumsum(score)]
    a, b = max(((i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)), key=lambda p: sums[p[1]] - sums[p[0]])
    return [*by_definition(score[:a], start), (start + a, start + b, sums[b] - sums[a]), *by_definition(score[b:], start + b)]


def test_segments_follow_their_definition():
    rng = np.random.default_rng(3)
    for _ in range(300):
        score = rng.normal(rng.choice([-0.5, 0.0, 0.3]), 1, int(rng.integers(0, 40)))
        got, want = toxicity.segments(score), by_definition(score)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])

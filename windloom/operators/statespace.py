"""Linear state-space models over long series: filtering, likelihood, forecasts and smoothing, in parts.

A model is x' = T x + noise(Q), y = Z x + noise(H).  What a stretch of a series does to the filter, whatever state it is entered
in, is a few small matrices: with the entry state x fixed, the filtered mean after it is A x + b with covariance C, and the stretch's
likelihood as a function of x is exp(-(x'J x - 2 e'x + c) / 2) up to the log determinant d of the innovations' variances.  Such effects
compose, so a series is cut into parts that are worked through side by side; the effects of a series' parts, in order, then give the
likelihood of the whole and the state that each part is entered in.  Backwards, a part takes the smoother's (r, N) at its end
to G'r + r0 and G'N G + N0, and the same is done from the last part to the first.

Several parameter sets are worked through together (the leading axis of all arrays), so a fit is a few passes over the
stored parts: each pass tries a lattice of sets, and the next one a finer lattice around the best.  Variances are relative: the scale of
all of them is the mean squared standardised innovation.  Missing values (null, NaN) are stepped over.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.session import stored

#: Variance of an unknown first state, in units of the model's scale; rows that a part has about.
DIFFUSE, PART_ROWS = 1e6, 4096


@dataclass
class Model:
    """``transition`` (k, m, m), ``noise`` (k, m, m), ``seen`` (m), ``error`` (k): k parameter sets of one form.

    ``gain`` (k, m): innovations form instead, in which a step adds the gain times its innovation and nothing else is random; ``first``
    (k, m) is then the state before the first row."""

    transition: np.ndarray
    noise: np.ndarray
    seen: np.ndarray
    error: np.ndarray
    gain: np.ndarray | None = None
    first: np.ndarray | None = None

    @property
    def entry(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance before the first row."""
        k, m = self.transition.shape[:2]
        mean = np.zeros((k, m)) if self.first is None else self.first
        return mean, np.zeros((k, m, m)) if self.gain is not None else np.tile(np.eye(m) * DIFFUSE, (k, 1, 1))


def sarima(ar: np.ndarray, ma: np.ndarray, seasonal: np.ndarray, season: int = 24) -> Model:
    """SARIMA(1,1,1)(1,0,0): one set for each entry of the three coefficients; the first state is the level."""
    k, m = len(ar), season + 2
    t = np.zeros((k, m, m))
    t[:, 0, 0] = t[:, 0, 1] = 1
    t[:, 1:-1, 2:] = np.eye(m - 2)
    t[:, 1, 1] = ar
    t[:, season, 1] += seasonal
    t[:, season + 1, 1] = -ar * seasonal
    r = np.zeros((k, m))
    r[:, 1], r[:, 2] = 1, ma
    z = np.zeros(m)
    z[:2] = 1
    return Model(t, r[:, :, None] * r[:, None, :], z, np.zeros(k))


def structural(level: np.ndarray, slope: np.ndarray | None, seasonal: np.ndarray, season: int = 24) -> Model:
    """Local level (and slope, unless it is None) plus a season of dummies, variances relative to the measurement's, which is 1."""
    k, own = len(level), 1 if slope is None else 2
    m = own + season - 1
    t, q, z = np.zeros((k, m, m)), np.zeros((k, m, m)), np.zeros(m)
    t[:, 0, 0] = 1
    q[:, 0, 0] = level
    if slope is not None:
        t[:, 0, 1] = t[:, 1, 1] = 1
        q[:, 1, 1] = slope
    t[:, own, own:] = -1
    t[:, own + 1 :, own:-1] = np.eye(season - 2)
    q[:, own, own] = seasonal
    z[0] = z[own] = 1
    return Model(t, q, z, np.ones(k))


def smoothing(alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray, first: np.ndarray, season: int = 24) -> Model:
    """Additive Holt-Winters smoothing as innovations: level, slope, and the season's values, the next one first."""
    k, m = len(alpha), season + 2
    t, z, g = np.zeros((k, m, m)), np.zeros(m), np.zeros((k, m))
    t[:, 0, 0] = t[:, 0, 1] = t[:, 1, 1] = 1
    t[:, 2:-1, 3:] = np.eye(season - 1)
    t[:, -1, 2] = 1
    # A step first moves on, so that the season's value for the row seen stands last.
    z[0] = z[-1] = 1
    g[:, 0], g[:, 1], g[:, -1] = alpha, alpha * beta, gamma * (1 - alpha)
    return Model(t, np.zeros((k, m, m)), z, np.zeros(k), g, np.tile(first, (k, 1)))


#: What a stretch does: (A, b, C, J, e, c, d, n).
Effect = tuple[np.ndarray, ...]


def effect(model: Model, y: np.ndarray) -> Effect:
    """The effect of the rows ``y`` (NaN: missing), for every parameter set."""
    t, z = model.transition, model.seen
    k, m = t.shape[:2]
    a, b, c_state = np.tile(np.eye(m), (k, 1, 1)), np.zeros((k, m)), np.zeros((k, m, m))
    j, e, c, d, n = np.zeros((k, m, m)), np.zeros((k, m)), np.zeros(k), np.zeros(k), 0
    tt = t.transpose(0, 2, 1)
    for value in y:
        a, b = t @ a, (t @ b[:, :, None])[:, :, 0]
        if model.gain is None:
            c_state = t @ c_state @ tt + model.noise
        if value != value:
            continue
        n += 1
        slope = z @ a  # the prediction's dependence on the entry state
        v = value - b @ z
        if model.gain is None:
            cz = c_state @ z
            s = cz @ z + model.error
            gain = cz / s[:, None]
            c_state = c_state - gain[:, :, None] * cz[:, None, :]
        else:
            s, gain = np.ones(k), model.gain
        j += slope[:, :, None] * slope[:, None, :] / s[:, None, None]
        e += slope * (v / s)[:, None]
        c += v * v / s
        d += np.log(s)
        a = a - gain[:, :, None] * slope[:, None, :]
        b = b + gain * v[:, None]
    return a, b, c_state, j, e, c, d, np.full(k, float(n))


def enter(state: tuple[np.ndarray, np.ndarray], made: Effect) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The state after a stretch entered in ``state`` (mean, covariance), its sum of squared standardised innovations and the log
    determinant of their variances."""
    mean, cov = state
    a, b, c_state, j, e, c, d, _ = made
    m = mean.shape[1]
    e0 = e - (j @ mean[:, :, None])[:, :, 0]  # the likelihood's slope at the mean
    seen = np.eye(m) + cov @ j
    weight = np.linalg.solve(seen, cov)
    weight = (weight + weight.transpose(0, 2, 1)) / 2
    told = (weight @ e0[:, :, None])[:, :, 0]
    squares = c - 2 * (e * mean).sum(1) + (mean * (j @ mean[:, :, None])[:, :, 0]).sum(1) - (e0 * told).sum(1)
    after = (a @ (mean + told)[:, :, None])[:, :, 0] + b
    spread = a @ weight @ a.transpose(0, 2, 1) + c_state
    return (after, (spread + spread.transpose(0, 2, 1)) / 2), squares, d + np.linalg.slogdet(seen)[1]


def log_likelihood(squares: np.ndarray, dets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """At the scale that is best for it."""
    n = np.maximum(n, 1)
    return -0.5 * (n * (np.log(2 * np.pi * np.maximum(squares, 1e-300) / n) + 1) + dets)


def walk(model: Model, y: np.ndarray, state: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row by row, for one parameter set: predicted mean and covariance, innovation (NaN: missing), its variance, filtered mean."""
    t, z = model.transition[0], model.seen
    mean, cov = state[0][0], state[1][0]
    for value in y:
        mean, cov = t @ mean, (t @ cov @ t.T + model.noise[0] if model.gain is None else cov)
        before = (mean, cov)
        cz = cov @ z
        s = cz @ z + model.error[0] if model.gain is None else 1.0
        v = value - mean @ z
        if value == value:
            gain = cz / s if model.gain is None else model.gain[0]
            mean = mean + gain * v
            if model.gain is None:
                cov = cov - np.outer(gain, cz)
        yield *before, v, s, mean


def parts_of(series: DataFrame, group: str, order: str, value: str, rows: int = PART_ROWS) -> DataFrame:
    """``(group, part, at, ys)``: the series cut into parts of about ``rows`` rows in order, stored; ``at``: the orders of the rows."""
    own = series.select(group, order, F.col(value).cast("double").alias("__y")).where(F.col(group).isNotNull())
    n = max(1, -(-own.count() // rows))
    cut = own.repartitionByRange(n, group, order).withColumn("part", F.spark_partition_id())
    lists = cut.groupBy(group, "part").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col("__y").alias("y")))).alias("l"))
    return stored(lists.select(group, "part", F.col("l.at").alias("at"), F.col("l.y").alias("ys")), "series")


def _values(ys) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in ys], float)


def _packed(made: Effect) -> list[bytes]:
    return [np.ascontiguousarray(x, "<f8").tobytes() for x in made]


def _unpacked(data: list[bytes], k: int, m: int) -> Effect:
    shapes = [(k, m, m), (k, m), (k, m, m), (k, m, m), (k, m), (k,), (k,), (k,)]
    return tuple(np.frombuffer(x, "<f8").reshape(s) for x, s in zip(data, shapes, strict=True))


#: Makes a model from parameter sets (k, number of parameters) and a group's constants.
Maker = Callable[[np.ndarray, np.ndarray], Model]


def effects(parts: DataFrame, group: str, make: Maker, sets: DataFrame) -> DataFrame:
    """``(group, part, params, consts, made)``: what every part does, for the group's row of ``sets(group, params
    array<array<double>>, consts array<double>)``."""
    kind = dict(parts.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            models = [make(np.array([list(p) for p in ps], float), np.array(cs, float)) for ps, cs in zip(pdf["params"], pdf["consts"], strict=True)]
            made = [_packed(effect(model, _values(ys))) for model, ys in zip(models, pdf["ys"], strict=True)]
            yield pdf[[group, "part", "params", "consts"]].assign(made=made)

    joined = parts.select(group, "part", "ys").join(sets, group)
    return joined.mapInPandas(run, f"`{group}` {kind}, part int, params array<array<double>>, consts array<double>, made array<binary>")


def _in_order(pdf: pd.DataFrame, make: Maker) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """The parts of one series: part, the state it is entered in, and its squares, log determinants and rows."""
    pdf = pdf.sort_values("part")
    model = make(np.array([list(p) for p in pdf["params"].iloc[0]], float), np.array(pdf["consts"].iloc[0], float))
    state = model.entry
    for part, data in zip(pdf["part"], pdf["made"], strict=True):
        made = _unpacked(list(data), *model.transition.shape[:2])
        after, squares, dets = enter(state, made)
        yield part, state, squares, dets, made[-1]
        state = after


def likelihoods(parts: DataFrame, group: str, make: Maker, sets: DataFrame) -> DataFrame:
    """``(group, params, loglik, scale)``: each set's likelihood over the whole series, at its best scale of the variances.

    The parts of a series that meet in a task are its effects, a few matrices each.
    """
    kind = dict(parts.dtypes)[group]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        total = [sum(x) for x in list(zip(*((s, d, n) for _, _, s, d, n in _in_order(pdf, make)), strict=True))]
        sets = [list(p) for p in pdf["params"].iloc[0]]
        scale = total[0] / np.maximum(total[2], 1)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(sets), "params": sets, "loglik": log_likelihood(*total), "scale": scale})

    made = effects(parts, group, make, sets)
    return made.groupBy(group).applyInPandas(compose, f"`{group}` {kind}, params array<double>, loglik double, scale double")


def fit(parts: DataFrame, group: str, make: Maker, low: list[float], high: list[float], consts: DataFrame | None = None, points: int = 5, rounds: int = 5, shrink: float = 0.5) -> DataFrame:
    """``(group, params, loglik, scale, consts)``: the best parameters of every series within the box, by lattices of ``points`` a
    parameter, each round's with ``shrink`` times the spacing of the last, around the best so far; ties go to the smaller parameters.
    ``consts(group, consts array<double>)``: what the model of a series needs besides."""
    spark, lo, hi = parts.sparkSession, np.array(low, float), np.array(high, float)
    steps = (hi - lo) / (points - 1)
    first = [[float(x) for x in p] for p in itertools.product(*(np.linspace(a, b, points) for a, b in zip(lo, hi, strict=True)))]
    groups = parts.select(group).distinct()
    known = groups.join(consts, group) if consts is not None else groups.withColumn("consts", F.array().cast("array<double>"))
    known = stored(known, "consts")
    start = spark.createDataFrame([(first,)], "params array<array<double>>")
    sets = known.join(F.broadcast(start))  # one row on the right
    kind = dict(parts.dtypes)[group]
    best = None
    for k in range(rounds):
        tried = likelihoods(parts, group, make, sets).where(~F.isnan("loglik"))
        tried = tried if best is None else tried.unionByName(best)
        top = F.max_by(F.struct("params", "loglik", "scale"), F.struct("loglik", F.transform("params", lambda x: -x)))
        best = stored(tried.groupBy(group).agg(top.alias("b")).select(group, "b.params", "b.loglik", "b.scale"), "fit")
        if k == rounds - 1:
            break
        width, reach = steps * shrink ** (k + 1), range(-(points // 2), points // 2 + 1)

        def around(batches: Iterator[pd.DataFrame], width=width, reach=reach) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made = [[np.clip(np.array(p, float) + width * np.array(s), lo, hi).tolist() for s in itertools.product(reach, repeat=len(lo)) if any(s)] for p in pdf["params"]]
                yield pdf[[group]].assign(params=made)

        sets = best.mapInPandas(around, f"`{group}` {kind}, params array<array<double>>").join(known, group)
    return best.join(known, group)


def _entered(parts: DataFrame, group: str, make: Maker, fitted: DataFrame) -> DataFrame:
    """``(group, part, params, consts, state)``: the state each part is entered in (mean and covariance as bytes)."""
    kind = dict(parts.dtypes)[group]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(part, [x.tobytes() for x in state]) for part, state, *_ in _in_order(pdf, make)]
        pdf = pdf.sort_values("part")
        return pdf[[group, "part", "params", "consts"]].assign(state=[s for _, s in rows])

    sets = fitted.select(group, F.array("params").alias("params"), "consts")
    return effects(parts, group, make, sets).groupBy(group).applyInPandas(compose, f"`{group}` {kind}, part int, params array<array<double>>, consts array<double>, state array<binary>")


def _model_and_state(make: Maker, params, consts, state) -> tuple[Model, tuple[np.ndarray, np.ndarray]]:
    model = make(np.array([list(p) for p in params], float), np.array(consts, float))
    m = len(model.seen)
    mean, cov = (np.frombuffer(x, "<f8") for x in state)
    return model, (mean.reshape(1, m), cov.reshape(1, m, m))


def forecasts(parts: DataFrame, group: str, make: Maker, fitted: DataFrame, origins: DataFrame, horizon: int = 24) -> DataFrame:
    """``(group, origin, lead, predicted)``: the next ``horizon`` rows from every origin, given all rows up to it (and none after).
    ``origins(group, origin)``: orders of rows of the series, counted from 0 rows after which to forecast."""
    kind, at = dict(parts.dtypes)[group], dict(parts.dtypes)["at"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                wanted = set(r.origins)
                model, state = _model_and_state(make, r.params, r.consts, r.state)
                for place, (*_, mean) in zip(r.at, walk(model, _values(r.ys), state), strict=True):
                    if place in wanted:
                        now = mean
                        for lead in range(1, horizon + 1):
                            now = model.transition[0] @ now
                            made.append((getattr(r, group), place, lead, float(now @ model.seen)))
            yield pd.DataFrame(made, columns=[group, "origin", "lead", "predicted"])

    wanted = parts.select(group, "part", F.explode("at").alias("origin")).join(origins.select(group, "origin").distinct(), [group, "origin"]).groupBy(group, "part").agg(F.collect_list("origin").alias("origins"))
    joined = parts.join(_entered(parts, group, make, fitted), [group, "part"]).join(wanted, [group, "part"])
    return joined.mapInPandas(run, f"`{group}` {kind}, origin {at}, lead int, predicted double")


def fitted_values(parts: DataFrame, group: str, make: Maker, fitted: DataFrame) -> DataFrame:
    """``(group, at, actual, predicted)``: every row and its prediction from the rows before it."""
    kind, at = dict(parts.dtypes)[group], dict(parts.dtypes)["at"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                y = _values(r.ys)
                model, state = _model_and_state(make, r.params, r.consts, r.state)
                predicted = [float(mean @ model.seen) for mean, *_ in walk(model, y, state)]
                yield pd.DataFrame({group: [getattr(r, group)] * len(y), "at": list(r.at), "actual": y, "predicted": predicted})

    joined = parts.join(_entered(parts, group, make, fitted), [group, "part"])
    return joined.mapInPandas(run, f"`{group}` {kind}, at {at}, actual double, predicted double")


def _backwards(model: Model, y: np.ndarray, state: tuple[np.ndarray, np.ndarray]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The forward rows of a part, and what it does to the smoother's (r, N) at its end: (G, r0, N0)."""
    rows = list(walk(model, y, state))
    g, r, n = np.eye(len(model.seen)), np.zeros(len(model.seen)), np.zeros((len(model.seen),) * 2)
    for row in reversed(rows):
        r, n, step = _step_back(model, row, r, n)
        g = g @ step
    return rows, g, r, n


def _step_back(model: Model, row: tuple, r: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, N) before a row's observation from that after its transition onwards, and the matrix between them."""
    mean, cov, v, s, _ = row
    t, z = model.transition[0], model.seen
    if v == v:
        seen = np.eye(len(z)) - np.outer(cov @ z / s, z)
        r, n = seen.T @ r + z * (v / s), seen.T @ n @ seen + np.outer(z, z) / s
        return t.T @ r, t.T @ n @ t, seen @ t
    return t.T @ r, t.T @ n @ t, t


def smoothed(parts: DataFrame, group: str, make: Maker, fitted: DataFrame) -> DataFrame:
    """``(group, at, actual, signal, states array, moments array)`` of every row given the whole series: the signal Z x, the states' means,
    and the expected squares of the disturbances, the states' and, last, the measurement's (for ``refit``).  ``fitted`` may have the
    variances' ``scale`` (else 1), on which these squares depend."""
    kind, at = dict(parts.dtypes)[group], dict(parts.dtypes)["at"].removeprefix("array<").removesuffix(">")
    entered = stored(_entered(parts, group, make, fitted), "entered")
    scale = F.col("scale") if "scale" in fitted.columns else F.lit(1.0)
    rows = parts.join(entered, [group, "part"]).join(fitted.select(group, scale.alias("scale")), group)

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [[np.ascontiguousarray(x).tobytes() for x in _backwards(*_args(r))[1:]] for r in pdf.itertuples(index=False)]
            yield pdf[[group, "part"]].assign(made=made)

    def _args(r) -> tuple:
        model, state = _model_and_state(make, r.params, r.consts, r.state)
        return model, _values(r.ys), state

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ends, now = pdf.sort_values("part", ascending=False), [], None
        for data in pdf["made"]:
            g, r0, n0 = (np.frombuffer(x, "<f8") for x in data)
            m = len(r0)
            g, n0 = g.reshape(m, m), n0.reshape(m, m)
            r, n = now if now is not None else (np.zeros(m), np.zeros((m, m)))
            ends.append([r.tobytes(), n.tobytes()])
            now = g.T @ r + r0, g.T @ n @ g + n0
        return pdf[[group, "part"]].assign(end=ends)

    ends = rows.mapInPandas(back, f"`{group}` {kind}, part int, made array<binary>").groupBy(group).applyInPandas(compose, f"`{group}` {kind}, part int, end array<binary>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                model, y, state = _args(row)
                m = len(model.seen)
                r, n = (np.frombuffer(x, "<f8") for x in row.end)
                n = n.reshape(m, m)
                q, h, made = model.noise[0], model.error[0], []
                for step in reversed(list(walk(model, y, state))):
                    mean, cov, v, s, _ = step
                    seen = v == v
                    k = cov @ model.seen / s
                    u, d = (v / s - k @ r, 1 / s + k @ n @ k) if seen else (0.0, 0.0)
                    # r and N at this row's predicted state, before the transition that led to it.
                    left = np.eye(m) - np.outer(k, model.seen) if seen else np.eye(m)
                    here = left.T @ r + (model.seen * (v / s) if seen else 0)
                    spread = left.T @ n @ left + (np.outer(model.seen, model.seen) / s if seen else 0)
                    states = mean + cov @ here
                    moved = row.scale * (np.diag(q) - np.diag(q @ spread @ q)) + np.square(q @ here)
                    made.append((float(states @ model.seen), states.tolist(), [*moved.tolist(), float(row.scale * (h - h * h * d) + (h * u) ** 2) if seen else float("nan")]))
                    r, n = model.transition[0].T @ here, model.transition[0].T @ spread @ model.transition[0]
                made.reverse()
                yield pd.DataFrame({group: [getattr(row, group)] * len(y), "at": list(row.at), "actual": y, "signal": [x[0] for x in made], "states": [x[1] for x in made], "moments": [x[2] for x in made]})

    return rows.join(ends, [group, "part"]).mapInPandas(run, f"`{group}` {kind}, at {at}, actual double, signal double, states array<double>, moments array<double>")


def refit(parts: DataFrame, group: str, make: Maker, fitted: DataFrame, places: list[int], rounds: int = 1) -> DataFrame:
    """``fitted`` after rounds of expectation maximisation for parameters that are logarithms (to base 10) of state variances relative
    to the measurement's; ``places``: the states that they belong to.  A round never lowers the likelihood of the variances."""
    def scaled(params: DataFrame) -> DataFrame:
        made = likelihoods(parts, group, make, params.select(group, F.array("params").alias("params"), "consts"))
        return stored(made.join(params.select(group, "consts"), group), "fit")

    fitted = scaled(fitted)
    for _ in range(rounds):
        moments = smoothed(parts, group, make, fitted)
        error = F.avg(F.when(~F.isnan(F.element_at("moments", -1)), F.element_at("moments", -1)))
        ratio = F.array(*[F.log10(F.greatest(F.avg(F.col("moments")[p]), F.lit(1e-12)) / error) for p in places])
        fitted = scaled(stored(moments.groupBy(group).agg(ratio.alias("params")).join(fitted.select(group, "consts"), group), "refit"))
    return fitted


def smoothing_start(series: DataFrame, group: str, order: str, value: str, season: int = 24) -> DataFrame:
    """``(group, consts)``: level, slope and season before the first row, from the first two seasons of each series that has them."""
    w = Window.partitionBy(group).orderBy(order)
    first = series.where(F.col(value).isNotNull()).select(group, F.row_number().over(w).alias("k"), F.col(value).cast("double").alias("v")).where(F.col("k") <= 2 * season)
    both = first.groupBy(group).agg(F.avg(F.when(F.col("k") <= season, F.col("v"))).alias("a"), F.avg(F.when(F.col("k") > season, F.col("v"))).alias("b"), F.sort_array(F.collect_list(F.struct("k", "v"))).alias("l"))
    both = both.where(F.size("l") == 2 * season)
    swing = F.transform(F.slice("l", 1, season), lambda x: x["v"] - F.col("a"))
    return both.select(group, F.concat(F.array("a", (F.col("b") - F.col("a")) / season), swing).alias("consts"))


def placed(parts: DataFrame, group: str) -> DataFrame:
    """``(group, part, at, ys, before, n)``: with the number of rows before each part and in the whole series."""
    sizes = parts.select(group, "part", F.size("at").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = sizes.select(group, "part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("before"), F.sum("__n").over(Window.partitionBy(group)).alias("n"))
    return parts.join(sums, [group, "part"])


def training(parts: DataFrame, group: str, share: float = 0.8) -> DataFrame:
    """The parts with nulls in place of what comes after the first ``share`` of each series' rows."""
    known = F.floor(F.col("n") * share)
    ys = F.transform("ys", lambda v, k: F.when(F.col("before") + k < known, v))
    return stored(placed(parts, group).select(group, "part", "at", ys.alias("ys")), "training")


def scored_rows(parts: DataFrame, group: str, share: float = 0.8, length: int = 24) -> DataFrame:
    """``(group, at, actual, w, lead, origin)``: the rows after the first ``share`` in whole windows; ``origin``: the row before the window."""
    rows = placed(parts, group).select(group, "before", "n", F.posexplode(F.arrays_zip("at", "ys")).alias("k", "r"))
    after = F.col("before") + F.col("k") - F.floor(F.col("n") * share)
    rows = rows.select(group, F.col("r.at").alias("at"), F.col("r.ys").alias("actual"), after.alias("after"), (F.col("n") - F.floor(F.col("n") * share)).alias("tests"), F.floor(F.col("n") * share).alias("known"))
    w, lead = F.floor(F.col("after") / length), F.col("after") % length + 1
    firsts = rows.where((F.col("after") >= -1) & ((F.col("after") + 1) % length == 0)).select(group, ((F.col("after") + 1) / length).cast("long").alias("w"), F.col("at").alias("origin"))
    rows = rows.where((F.col("after") >= 0) & ((w + 1) * length <= F.col("tests")) & (F.col("known") > 0))
    return rows.select(group, "at", "actual", w.cast("long").alias("w"), lead.cast("int").alias("lead")).join(firsts, [group, "w"])


def backtest(parts: DataFrame, group: str, make: Maker, fitted: DataFrame, share: float = 0.8, length: int = 24) -> DataFrame:
    """``(group, w, lead, at, actual, predicted)``: every whole window after the first ``share``, forecast from the rows before it.
    ``fitted`` has to come from ``training`` rows."""
    rows = scored_rows(parts, group, share, length)
    made = forecasts(parts, group, make, fitted, rows.select(group, "origin").distinct(), length)
    return rows.join(made, [group, "origin", "lead"]).select(group, "w", "lead", "at", "actual", "predicted")


# Makers: parameters in the order of the boxes below them, which ``fit`` searches.


def sarima_maker(season: int = 24) -> Maker:
    return lambda p, c: sarima(p[:, 0], p[:, 1], p[:, 2], season)


SARIMA_BOX = ([-0.95, -0.95, -0.95], [0.95, 0.95, 0.95])


def structural_maker(season: int = 24, slope: bool = False) -> Maker:
    """Logarithms (to base 10) of the variances of level, season and (with ``slope``) slope, relative to the measurement's."""
    return lambda p, c: structural(10 ** p[:, 0], 10 ** p[:, 2] if slope else None, 10 ** p[:, 1], season)


STRUCTURAL_BOX = ([-4.0, -6.0], [2.0, 1.0])


def smoothing_maker(season: int = 24) -> Maker:
    return lambda p, c: smoothing(p[:, 0], p[:, 1], p[:, 2], c, season)


SMOOTHING_BOX = ([0.01, 0.0, 0.0], [0.99, 0.5, 0.99])

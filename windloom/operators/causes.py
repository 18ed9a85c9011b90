"""Cause models of a case's sensors: what the operating channels, their exponential means and squares say that a sensor should read.

All sensors of a case share one pass: tasks add up, over the training rows whose inputs are all there, the products of inputs and
targets, and take off for each target the rows in which it is missing.  A target's model leaves out the inputs made of itself, which is a
block of the same matrix.  Residuals give, on the rows kept for it, the fit's R2, thresholds at several quantiles and the sensor's own
rate of normal episodes, which is what the warning rules run on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.operators import sequence

#: Spans of the exponential means; the ridge; training rows and R2 that a watched sensor needs; quantiles of the absolute residual.
SPANS, ALPHA, LEAST_ROWS, LEAST_R2, QUANTILES = (18, 72), 1.0, 1000, 0.5, (0.99, 0.995, 0.999)


def design(rows: DataFrame, case: str, order: list[str], operating: list[str], squared: list[str], spans: tuple[int, ...] = SPANS) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with the inputs, and each input's channel: the channels, ``<channel>_ewm<span>`` and ``<channel>_sq``."""
    inputs = {c: c for c in operating}
    for c in operating:
        for span in spans:
            rows = sequence.exponential_mean(rows, [case], order, c, span)
            inputs[f"{c}_ewm{span}"] = c
    for c in squared:
        rows, inputs[f"{c}_sq"] = rows.withColumn(f"{c}_sq", F.col(c) * F.col(c)), c
    return rows, inputs


def fit(rows: DataFrame, case: str, inputs: dict[str, str], targets: list[str], train: Column, alpha: float = ALPHA, least: int = LEAST_ROWS) -> DataFrame:
    """``(case, sensor, weights array, base, n)``: a ridge on standardised inputs for every target with ``least`` rows; weights are 0 for
    the inputs that are left out."""
    names, kind = list(inputs), dict(rows.dtypes)[case]
    k, t = len(names), len(targets)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for g, own in pdf.groupby(case):
                x = np.column_stack([np.ones(len(own)), own[names].to_numpy(float)])
                y = own[targets].to_numpy(float)
                whole = ~np.isnan(x).any(axis=1)
                x, y = x[whole], y[whole]
                there = ~np.isnan(y)
                shared, made = x.T @ x, np.zeros((t, k + 1, k + 2))
                for j in range(t):
                    gone = x[~there[:, j]]
                    made[j, :, : k + 1] = shared - gone.T @ gone
                    made[j, :, k + 1] = x.T @ np.where(there[:, j], y[:, j], 0.0)
                held[g] = held[g] + made if g in held else made
        made = [(g, targets[j], sums[j].ravel().tolist()) for g, sums in held.items() for j in range(t)]
        yield pd.DataFrame(made, columns=[case, "sensor", "sums"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.array(pdf["sums"].tolist()), axis=0).reshape(k + 1, k + 2)
        sensor, n = pdf["sensor"].iloc[0], sums[0, 0]
        use = np.array([i + 1 for i, c in enumerate(names) if inputs[c] != sensor], int)
        out = {case: [pdf[case].iloc[0]], "sensor": sensor, "weights": [[0.0] * k], "base": [np.nan], "n": [int(n)]}
        if n >= max(least, 1) and len(use):
            mean, my = sums[0, use] / n, sums[0, k + 1] / n
            cross = sums[np.ix_(use, use)] - n * np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cross) / n, 0))
            sd[sd < 1e-9] = 1.0
            w = np.linalg.solve(cross / np.outer(sd, sd) + alpha * np.eye(len(use)), (sums[use, k + 1] - n * mean * my) / sd) / sd
            weights = np.zeros(k)
            weights[use - 1] = w
            out["weights"], out["base"] = [weights.tolist()], [float(my - w @ mean)]
        return pd.DataFrame(out)

    sums = rows.where(train).select(case, *dict.fromkeys([*names, *targets])).mapInPandas(gather, f"`{case}` {kind}, sensor string, sums array<double>")
    fitted = sums.groupBy(case, "sensor").applyInPandas(solve, f"`{case}` {kind}, sensor string, weights array<double>, base double, n long")
    return fitted.where(F.col("base").isNotNull() & ~F.isnan("base"))


def residuals(rows: DataFrame, case: str, order: list[str], inputs: dict[str, str], targets: list[str], fitted: DataFrame, keep: list[str]) -> DataFrame:
    """``(case, order, keep, sensor, y, fitted)`` of every row and sensor with a model; nulls where an input or the sensor is missing."""
    values = F.array(*[F.col(c).cast("double") for c in inputs])
    long = rows.select(case, *order, *keep, values.alias("x"), *targets).unpivot([case, *order, *keep, "x"], targets, "sensor", "y")
    used = F.zip_with("x", "weights", lambda x, w: F.when(w != 0, x * w).otherwise(0.0))
    made = F.col("base") + F.aggregate(used, F.lit(0.0), lambda a, v: a + v)
    there = ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    return long.join(fitted.select(case, "sensor", "weights", "base"), [case, "sensor"]).select(case, *order, *keep, "sensor", "y", F.when(there, made).alias("fitted"))


def thresholds(rows: DataFrame, case: str, calibration: Column, quantiles: tuple[float, ...] = QUANTILES, least_r2: float = LEAST_R2) -> DataFrame:
    """``(case, sensor, quantile, threshold, r2, n, watched)`` from the calibration rows of ``residuals``."""
    e = F.abs(F.col("y") - F.col("fitted"))
    own = rows.where(calibration & e.isNotNull()).withColumn("__e", e)
    at = F.array(*[F.lit(q) for q in quantiles])
    out = own.groupBy(case, "sensor").agg((1 - F.avg(F.col("__e") * F.col("__e")) / F.greatest(F.var_pop("y"), F.lit(1e-12))).alias("r2"), F.percentile("__e", list(quantiles)).alias("__t"), F.count(F.lit(1)).alias("n"))
    out = out.select(case, "sensor", F.explode(F.arrays_zip(at.alias("quantile"), F.col("__t").alias("threshold"))).alias("q"), "r2", "n")
    return out.select(case, "sensor", "q.quantile", "q.threshold", "r2", "n", (F.col("r2") >= least_r2).alias("watched"))


def episode_days(rows: DataFrame, case: str, order: list[str], day: Column, limits: DataFrame, calibration: Column, monitored: Column) -> DataFrame:
    """``(event_id, sensor, quantile, day, episodes, monitored, base_rate)`` of watched sensors, as ``watch.warnings`` takes them:
    episodes that start on a day, rows of that day, and the sensor's rate of episodes on the calibration rows."""
    keys = [case, "sensor", "quantile"]
    own = rows.where("y is not null and fitted is not null").withColumns({"__day": day, "__cal": calibration, "__live": monitored})
    own = own.join(limits.where("watched").select(*keys, "threshold"), [case, "sensor"])
    own = own.where("__cal or __live").withColumn("__over", F.abs(F.col("y") - F.col("fitted")) > F.col("threshold"))
    # Runs end where the calibration does: its rows and those watched are sequences of their own.
    found = sequence.episodes(own, [*keys, "__cal"], order, F.col("__over"))
    rates = sequence.episode_rate(found, keys, F.col("__cal"))
    days = found.where("__live").groupBy(*keys, F.col("__day").alias("day")).agg(F.count_if("starts").alias("episodes"), F.count(F.lit(1)).alias("monitored"))
    return days.join(rates, keys).withColumnRenamed(case, "event_id")

"""Models: per-sensor ridge, PCA error, boosted trees, recursive forecasts, Monte-Carlo summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.operators.followups import uniform
from windloom.session import stored


def ridge_residuals(rows: DataFrame, group: str, order: str, features: list[str], target: str, train: str, alpha: float = 1.0, least: int = 100) -> DataFrame:
    """Residual of a ridge regression on standardised features per group, fitted on its ``train`` rows.

    The normal equations are sums over rows: a partial aggregate per group gives a few numbers, and only these are solved
    in Python; rows stay distributed and are scored by a join with the small coefficient table.
    """
    names = [*features, target]
    own = rows.where(F.col(train)).na.drop(subset=names)
    sums = [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    stats = own.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *sums)
    k = len(features)
    kind = dict(rows.dtypes)[group]

    def solve(parts):
        for pdf in parts:
            made = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                mean = np.array([r[f"s{i}"] for i in range(k + 1)]) / n
                cross = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cross)[:k] / n, 0))
                sd[sd < 1e-12] = 1.0
                x = cross[:k, :k] / np.outer(sd, sd)
                w = np.linalg.solve(x + alpha * np.eye(k), cross[:k, k] / sd) / sd if n >= least else np.full(k, np.nan)
                made.append((r[group], w.tolist(), float(mean[k] - w @ mean[:k])))
            yield pd.DataFrame(made, columns=[group, "__w", "__b"])

    fitted = stats.mapInPandas(solve, f"{group} {kind}, __w array<double>, __b double")
    made = F.col("__b") + sum((F.col("__w")[i] * F.col(c) for i, c in enumerate(features)), F.lit(0.0))
    out = rows.join(fitted, group, "left").withColumn("fitted", F.when(~F.isnan(made), made))
    return out.withColumn("residual", F.col(target) - F.col("fitted")).drop("__w", "__b")


def pca_error(rows: DataFrame, group: str, features: list[str], train: str, keep: float = 0.95) -> DataFrame:
    """Squared error of reconstructing standardised features from the components that hold ``keep`` of the variance."""
    clean = [F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features]
    others = [c for c in rows.columns if c not in features]
    own = rows.select(*others, *clean)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(features)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    stats = own.where(F.col(train)).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *sums)
    k, kind = len(features), dict(rows.dtypes)[group]

    def solve(parts):
        for pdf in parts:
            made = []
            for r in pdf.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
                cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / r["n"] - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 0))
                sd[sd < 1e-9] = 1.0
                value, vector = np.linalg.eigh(cov / np.outer(sd, sd))
                value, vector = value[::-1], vector[:, ::-1]
                m = int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-12), keep - 1e-12) + 1)
                rest = np.eye(k) - vector[:, :m] @ vector[:, :m].T
                made.append((r[group], mean.tolist(), sd.tolist(), rest.ravel().tolist(), m))
            yield pd.DataFrame(made, columns=[group, "__mean", "__sd", "__rest", "components"])

    fitted = stats.mapInPandas(solve, f"{group} {kind}, __mean array<double>, __sd array<double>, __rest array<double>, components int")
    z = [(F.col(c) - F.col("__mean")[i]) / F.col("__sd")[i] for i, c in enumerate(features)]
    parts = [F.pow(sum(F.col("__rest")[i * k + j] * z[j] for j in range(k)), F.lit(2.0)) for i in range(k)]
    return own.join(fitted, group, "left").withColumn("error", sum(parts)).drop("__mean", "__sd", "__rest")


def boosted(train: DataFrame, features: list[str], target: str, trees: int = 200, depth: int = 4, rate: float = 0.05, seed: int = 42):
    """Gradient-boosted regression trees as a pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gather = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[gather, GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]).fit(train)


def forest(train: DataFrame, features: list[str], target: str, trees: int = 300, depth: int = 8, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    gather = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[gather, RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)


def predict(model, rows: DataFrame, low: float | None = 0.0) -> DataFrame:
    """Predictions, clipped at ``low`` unless it is None."""
    out = model.transform(rows).drop("features")
    return out if low is None else out.withColumn("prediction", F.greatest(F.col("prediction"), F.lit(low)))


def recursive(model, origins: DataFrame, lags: list[int], steps: int = 24) -> DataFrame:
    """Forecasts 1 to ``steps`` rows ahead of every origin, each made from the ones before it.

    ``origins(origin, history array)``, newest value last; all origins advance together, one prediction a step.  The state is
    written after each step: the next one reads it instead of computing all steps before it again.
    """
    state = origins.select("origin", "history", F.array().cast("array<double>").alias("made"))
    for _ in range(steps):
        state = state.withColumns({f"lag_{k}": F.element_at("history", -k) for k in lags})
        done = predict(model, state, None)
        new = F.array("prediction")
        state = stored(done.select("origin", F.concat(F.slice("history", 2, F.size("history") - 1), new).alias("history"), F.concat("made", new).alias("made")), "forecast")
    return state.select("origin", F.posexplode("made").alias("lead", "prediction")).select("origin", (F.col("lead") + 1).alias("lead"), "prediction")


def holt_winters(series: DataFrame, group: str, order: str, value: str, season: int = 24, horizon: int = 24, alpha: float = 0.3, beta: float = 0.02, gamma: float = 0.2) -> DataFrame:
    """Additive Holt-Winters with fixed smoothing: ``(group, lead, prediction)``; needs two seasons."""
    kind = dict(series.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        if len(y) < 2 * season:
            return pd.DataFrame({group: pdf[group].iloc[:0], "lead": np.zeros(0, np.int32), "prediction": np.zeros(0)})
        level, trend = y[:season].mean(), (y[season : 2 * season].mean() - y[:season].mean()) / season
        s = list(y[:season] - level)
        for i, v in enumerate(y):
            old, k = level, i % season
            level = alpha * (v - s[k]) + (1 - alpha) * (level + trend)
            trend = beta * (level - old) + (1 - beta) * trend
            s[k] = gamma * (v - level) + (1 - gamma) * s[k]
        lead = np.arange(1, horizon + 1)
        return pd.DataFrame({group: pdf[group].iloc[0], "lead": lead, "prediction": level + trend * lead + np.array([s[(len(y) + h - 1) % season] for h in lead])})

    return series.groupBy(group).applyInPandas(run, f"{group} {kind}, lead int, prediction double")


def cosine_yaw(rows: DataFrame, group: str, angle: str, value: str) -> DataFrame:
    """Offset of the peak of value = a cos(angle) + b sin(angle) + c per group, from the 3 x 3 normal equations."""
    r = F.radians(angle)
    own = rows.where(F.col(angle).isNotNull() & F.col(value).isNotNull()).withColumns({"__x": F.cos(r), "__y": F.sin(r), "__v": F.col(value).cast("double")})
    s = own.groupBy(group).agg(*[F.covar_pop(a, b).alias(f"{a[2]}{b[2]}") for a, b in (("__x", "__x"), ("__y", "__y"), ("__x", "__y"), ("__x", "__v"), ("__y", "__v"))], F.count(F.lit(1)).alias("n"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = F.try_divide(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det)
    b = F.try_divide(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det)
    return s.select(group, "n", F.degrees(F.atan2(b, a)).alias("offset_deg"))


#: Fixed values of the yaw study: winds below rated power, the vane's least deviation there, and the angles that are fitted.
BELOW_RATED, LEAST_VANE_STD, WIDEST_ANGLE = (4.5, 8.5), 4.0, 25.0


def gated_yaw(rows: DataFrame, value: str = "value") -> DataFrame:
    """``(farm, turbine, vane_std, n, offset_deg, status)`` of ``rows(farm, turbine, angle, wind, power, value)``: ``cosine_yaw`` over the angles
    within 25 degrees of turbines that produce below rated power, where the farm's vane moves enough to show a curve; elsewhere the
    offset is NULL and the status ``not identifiable``."""
    own = rows.where(F.col("angle").isNotNull() & (F.col("wind") > BELOW_RATED[0]) & (F.col("wind") < BELOW_RATED[1]) & (F.col("power") > 0))
    gates = own.groupBy("farm").agg(F.stddev_samp("angle").alias("vane_std"))
    near = own.where(F.abs("angle") <= WIDEST_ANGLE).withColumn("__key", F.struct("farm", "turbine"))
    fits = cosine_yaw(near, "__key", "angle", value).select("__key.farm", "__key.turbine", "n", "offset_deg")
    moves = F.coalesce(F.col("vane_std") >= LEAST_VANE_STD, F.lit(False))
    offset = F.when(moves, F.col("offset_deg"))
    return fits.join(gates, "farm").select("farm", "turbine", "vane_std", "n", offset.alias("offset_deg"), F.when(moves & F.col("offset_deg").isNotNull(), "fitted").otherwise("not identifiable").alias("status"))


def draws_summary(draws: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean, deviation and percentiles of Monte-Carlo draws."""
    return draws.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), *[F.percentile(value, q).alias(f"p{int(q * 100)}") for q in (0.05, 0.1, 0.5, 0.9, 0.95)], F.count(F.lit(1)).alias("n"))


def electrical_losses(daily: DataFrame, draws: int = 5000, meter_error: float = 0.005, scada_error: float = 0.005) -> DataFrame:
    """Loss 1 - meter / turbines of ``daily(turbine_mwh, meter_mwh)`` over draws of both instruments' errors (uniform within
    the stated relative error); the sums are made once, each draw scales them."""
    total = daily.agg(F.sum("turbine_mwh").alias("t"), F.sum("meter_mwh").alias("m"))
    d = daily.sparkSession.range(draws).withColumnRenamed("id", "draw")
    m = 1 + meter_error * (2 * uniform(F.col("draw"), "meter") - 1)
    t = 1 + scada_error * (2 * uniform(F.col("draw"), "scada") - 1)
    return d.join(F.broadcast(total)).select("draw", (1 - F.try_divide(F.col("m") * m, F.col("t") * t)).alias("loss"))


def vector_autoregression(series: DataFrame, order: str, columns: list[str], p: int = 1, horizon: int = 24) -> DataFrame:
    """``(lead, columns..)``: the next ``horizon`` values of several series by least squares of each on the last ``p`` values of
    all of them.  The normal equations are sums over rows, gathered in one pass; only they (a matrix of 1 + p times the number of
    series) and the last ``p`` rows reach the driver."""
    from windloom.operators.forecasting import lag_features

    rows = series.select(order, *columns)
    for c in columns:
        rows = lag_features(rows, order, c, tuple(range(1, p + 1))).withColumnsRenamed({f"lag_{k}": f"__{c}_{k}" for k in range(1, p + 1)})
    given = [f"__{c}_{k}" for k in range(1, p + 1) for c in columns]
    own = rows.na.drop(subset=[*given, *columns]).withColumn("__one", F.lit(1.0))
    left = ["__one", *given]
    sums = own.agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(left) for j, b in enumerate([*left, *columns])]).first()
    table = np.array([[sums[f"s{i}_{j}"] or 0.0 for j in range(len(left) + len(columns))] for i in range(len(left))])
    last = [[float(r[c]) for c in columns] for r in rows.na.drop(subset=columns).orderBy(F.desc(order)).limit(p).collect()]
    schema = "lead int, " + ", ".join(f"`{c}` double" for c in columns)
    if len(last) < p or table[0, 0] <= len(left):
        return series.sparkSession.createDataFrame([], schema)
    weights, made = np.linalg.lstsq(table[:, : len(left)], table[:, len(left) :], rcond=None)[0], []
    for lead in range(1, horizon + 1):
        new = (np.r_[1.0, np.ravel(last)] @ weights).tolist()
        made.append((lead, *new))
        last = [new, *last][:p]
    return series.sparkSession.createDataFrame(made, schema)


def importances(model, features: list[str], spark) -> DataFrame:
    """``(feature, importance, position)`` of a pipeline whose last stage is a tree ensemble."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, v, k) for k, (f, v) in enumerate(ranked, 1)], "feature string, importance double, position int")

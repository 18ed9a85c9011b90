"""Power curves, efficiency and wind resource."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.functions.angles import difference, sector, vector_mean
from windloom.functions.wind import AIR_DENSITY, BETZ, curve_bin, power_coefficient


def binned_curve(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mean power and count by wind-speed bin (right-closed; 0.5 to 20 m/s, 2 to 28 m/s)."""
    return rows.withColumn("wind_bin", curve_bin(F.col("wind"))).where("wind_bin is not null").groupBy(*groups, "wind_bin").agg(F.avg("power").alias("mean_power"), F.count("power").alias("n"))


def efficiency_summary(rows: DataFrame, rated_kw: float, rotor_m: float, density: float = AIR_DENSITY) -> DataFrame:
    """Capacity factor, 95th-percentile power coefficient, the Betz limit and whether it is exceeded, per turbine."""
    cp = power_coefficient(F.col("power"), F.col("wind"), rotor_m, density)
    out = rows.withColumn("cp", cp).groupBy("turbine").agg((F.avg("power") / rated_kw).alias("capacity_factor"), F.percentile("cp", 0.95).alias("peak_cp"), F.count(F.lit(1)).alias("hours"))
    return out.withColumn("betz_limit", F.lit(BETZ)).withColumn("over_betz", F.coalesce(F.col("peak_cp") > BETZ, F.lit(False)))


def ranked(metrics: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Position by a metric; ties share the better position; NULLs have none."""
    order = F.col(metric).desc() if higher_is_better else F.col(metric).asc()
    # One row per entity: a registry's worth, and only the metric is moved.
    return metrics.where(F.col(metric).isNotNull()).withColumn("position", F.rank().over(Window.orderBy(order)))


def wind_rose(rows: DataFrame, sectors: int = 16) -> DataFrame:
    """Energy by direction sector, sectors without rows as zero."""
    energy = rows.where("direction is not null").groupBy(sector(F.col("direction"), sectors).alias("sector")).agg(F.sum("power").alias("energy"))
    every = rows.sparkSession.range(sectors).select(F.col("id").cast("int").alias("sector"))
    return every.join(energy, "sector", "left").select("sector", (F.col("sector") * (360.0 / sectors)).alias("direction"), F.coalesce("energy", F.lit(0.0)).alias("energy"))


def prevailing(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Vector-mean direction and the share of rows within 30 degrees of it."""
    mean = rows.where("direction is not null").groupBy(*groups).agg(vector_mean(F.col("direction")).alias("prevailing"))
    near = F.abs(difference(F.col("direction"), F.col("prevailing"))) <= 30
    return rows.where("direction is not null").join(mean, groups).groupBy(*groups, "prevailing").agg(F.avg(near.cast("double")).alias("share_within_30"), F.count(F.lit(1)).alias("n"))


def speed_histogram(rows: DataFrame, width: float = 0.5) -> DataFrame:
    """Density over left-closed bins, the last closed on both sides (as histograms have it)."""
    top = rows.agg(F.max("wind").alias("__top"), F.count("wind").alias("__n"))
    bins = F.ceil(F.col("__top") / width)
    number = F.when(F.col("wind") == bins * width, bins - 1).otherwise(F.floor(F.col("wind") / width))
    counted = rows.where("wind is not null").join(F.broadcast(top)).groupBy(number.cast("int").alias("bin"), "__n").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", ((F.col("bin") + 0.5) * width).alias("centre"), "n", (F.col("n") / (F.col("__n") * width)).alias("density"))


def output_share(rows: DataFrame, capacity: float, width: float = 0.5) -> DataFrame:
    """Mean output as a share of capacity over right-closed bins; exactly 0 m/s falls in none."""
    number = (F.ceil(F.col("wind") / width) - 1).cast("int")
    return rows.where("wind > 0").groupBy(number.alias("bin")).agg((F.avg("power") / capacity).alias("share"), F.count(F.lit(1)).alias("n"))


def weibull_fit(rows: DataFrame, groups: list[str], resolution: float = 0.01, rounds: int = 60) -> DataFrame:
    """Maximum-likelihood Weibull shape and scale per group, location 0, from positive speeds.

    Speeds are first counted on a grid of ``resolution``: the likelihood's sums need no more than these counts, of which a
    group has a bounded number whatever its rows.
    """
    g = F.greatest(F.round(F.col("wind") / resolution), F.lit(1.0)) * resolution
    counts = rows.where("wind > 0").groupBy(*groups, g.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields if f.name in groups}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = pdf["v"].to_numpy(float), pdf["n"].to_numpy(float)
        n_all, lv = n.sum(), np.log(v)
        mean = (n * v).sum() / n_all
        spread = np.sqrt((n * (v - mean) ** 2).sum() / n_all)
        shape, scale = float("nan"), float("nan")
        if len(v) > 1:
            k, target = (spread / mean) ** -1.086, (n * lv).sum() / n_all
            for _ in range(rounds):
                p = n * (v / v.max()) ** k
                a, b, c = p.sum(), (p * lv).sum(), (p * lv * lv).sum()
                step = (b / a - 1 / k - target) / (c / a - (b / a) ** 2 + 1 / k**2)
                k = max(k - step, k / 4)
                if abs(step) < 1e-12 * k:
                    break
            shape, scale = k, ((n * v**k).sum() / n_all) ** (1 / k)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in groups}, "n": [int(n_all)], "shape": [shape], "scale": [scale]})

    return counts.groupBy(*groups).applyInPandas(solve, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", n long, shape double, scale double")


def kernel_curve(rows: DataFrame, groups: list[str], width: float = 0.5, reach: float = 4.0, centres: tuple[float, float, float] = (0.25, 25.0, 0.5)) -> DataFrame:
    """Gaussian kernel regression of power on wind at regular centres.

    Rows of one speed are summed first; each speed then meets only the centres within ``reach`` bandwidths, and the weighted
    sums of a centre are partial before the shuffle.
    """
    speeds = rows.where("wind is not null and power is not null").groupBy(*groups, "wind").agg(F.sum("power").alias("sum_p"), F.count(F.lit(1)).alias("n"))
    first, last, step = centres
    low = F.greatest(F.ceil((F.col("wind") - reach * width - first) / step), F.lit(0))
    high = F.least(F.floor((F.col("wind") + reach * width - first) / step), F.lit(int((last - first) / step)))
    pairs = speeds.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    centre = F.lit(first) + F.col("k") * step
    weight = F.exp(-0.5 * F.pow((F.col("wind") - centre) / width, F.lit(2.0)))
    return pairs.groupBy(*groups, centre.alias("centre")).agg((F.sum(weight * F.col("sum_p")) / F.sum(weight * F.col("n"))).alias("power"), F.sum("n").alias("n"))


def curve_displacement(rows: DataFrame, curve: DataFrame, low: float = -5.0, high: float = 5.0, resolution: float = 0.01) -> DataFrame:
    """Shift along the speed axis that brings a turbine's rows onto the reference curve by least squares.

    ``curve(wind_bin, mean_power)`` is one small table.  Squared errors depend on rows only through counts and sums on a
    fine grid of speeds, of which a turbine has a bounded number; those are searched, coarse to fine, in a grouped map.
    """
    points = np.array(sorted(tuple(r) for r in curve.where("mean_power is not null").select("wind_bin", "mean_power").collect()), float).reshape(-1, 2)
    own = rows.where("power > 0 and wind is not null")
    grid = own.groupBy("turbine", F.round(F.col("wind") / resolution).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("power").alias("p"))
    kind = dict(rows.dtypes)["turbine"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n, p = pdf["g"].to_numpy(float) * resolution, pdf["n"].to_numpy(float), pdf["p"].to_numpy(float)
        centre, half = (low + high) / 2, (high - low) / 2
        while len(points) and half > 1e-4:
            shifts = centre + np.linspace(-half, half, 41)
            c = np.interp(v[None, :] + shifts[:, None], points[:, 0], points[:, 1])
            error = (n * c * c - 2 * c * p).sum(axis=1)  # less a constant
            centre, half = float(shifts[error.argmin()]), half / 10
        return pd.DataFrame({"turbine": [pdf["turbine"].iloc[0]], "displacement": [centre if len(points) else float("nan")]})

    return grid.groupBy("turbine").applyInPandas(solve, f"turbine {kind}, displacement double")


def compare_wind(pairs: DataFrame) -> DataFrame:
    """Agreement of two speed columns ``a`` and ``b``: correlation, mean absolute difference, share differing by over 5."""
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.where("a is not null and b is not null").agg(F.corr("a", "b").alias("r"), F.avg(d).alias("mean_abs_diff"), F.avg((d > 5).cast("double")).alias("share_over_5"), F.count(F.lit(1)).alias("n"))


def correlate_predict(mast_mean: float, reference: DataFrame) -> DataFrame:
    """Measure-correlate-predict by the ratio of means: the reference's speeds scaled to the mast's mean."""
    mean = reference.agg(F.avg("wind").alias("__mean"))
    ratio = F.try_divide(F.lit(mast_mean), F.col("__mean"))
    return reference.join(F.broadcast(mean)).select(*reference.columns, ratio.alias("ratio"), (F.col("wind") * ratio).alias("predicted"))

"""Which turbine stands where along a line, when positions and measurements are numbered differently.

Neighbours share gusts: the order of the turbines comes from the correlations of their high-passed power, that of the positions
from the line's principal axis, and equal ranks belong together.  All farms are worked on in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.functions import angles
from windloom.operators.followups import high_passed, rank_aligned

#: Turbines of a farm (an error above): what meets in a task is their matrix of correlations.  Passes of the power iteration.
MOST_TURBINES, PASSES = 2000, 20_000


def correlations(rows: DataFrame, value: str) -> DataFrame:
    """``(farm, a, b, r, n)`` for the turbines a < b of a farm, over the times at which both have a value: ``rows(farm, turbine, ts,
    value)``.  Tasks add up cross products of the times that they have; a time is a row of at most ``MOST_TURBINES`` values."""
    kinds = dict(rows.dtypes)
    times = rows.where(F.col(value).isNotNull()).groupBy("farm", "ts").agg(F.collect_list(F.struct("turbine", F.col(value).cast("double").alias("v"))).alias("l"))
    few = F.when(F.size("l") <= MOST_TURBINES, F.col("l")).otherwise(F.raise_error(F.lit(f"more than {MOST_TURBINES} turbines of a farm at one time")))
    sums = ["n", "sa", "sb", "qa", "qb", "p"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for farm, own in pdf.groupby("farm"):
                names = sorted({t["turbine"] for l in own["l"] for t in l})
                place, x = {t: k for k, t in enumerate(names)}, np.full((len(own), len(names)), np.nan)
                for k, l in enumerate(own["l"]):
                    for t in l:
                        x[k, place[t["turbine"]]] = t["v"]
                seen = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                mean_like = (x.T @ seen, (x * x).T @ seen)
                a, b = np.triu_indices(len(names), 1)
                columns = [(seen.T @ seen)[a, b], mean_like[0][a, b], mean_like[0][b, a], mean_like[1][a, b], mean_like[1][b, a], (x.T @ x)[a, b]]
                named = np.array(names, dtype=object)
                yield pd.DataFrame({"farm": [farm] * len(a), "a": named[a], "b": named[b], **dict(zip(sums, columns, strict=True))})

    schema = f"farm {kinds['farm']}, a {kinds['turbine']}, b {kinds['turbine']}, " + ", ".join(f"{c} double" for c in sums)
    made = times.select("farm", few.alias("l")).mapInPandas(run, schema).groupBy("farm", "a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    spread = lambda q, s: F.col("n") * F.col(q) - F.col(s) * F.col(s)
    r = F.try_divide(F.col("n") * F.col("p") - F.col("sa") * F.col("sb"), F.sqrt(F.greatest(spread("qa", "sa") * spread("qb", "sb"), F.lit(0.0))))
    return made.select("farm", "a", "b", r.alias("r"), F.col("n").cast("long").alias("n"))


def second_vector(weights: np.ndarray) -> np.ndarray:
    """Coordinates of a graph's nodes on a line: the slowest mode but the constant one of a random walk that takes edges by their
    weights and rests half of the time.  By power iteration, what lies along the constant mode being taken out of every step."""
    degree = np.maximum(weights.sum(1), 1e-12)
    root = np.sqrt(degree)
    step = weights / np.outer(root, root)
    still = root / np.linalg.norm(root)
    v = np.linspace(-1, 1, len(weights)) + 1e-3 * np.cos(np.arange(len(weights)))
    for _ in range(PASSES):
        old, v = v, v + step @ v
        v = v - still * (still @ v)
        size = np.linalg.norm(v)
        if size == 0:
            break
        v = v / size
        if np.abs(v - old).max() < 1e-13:
            break
    return v / root


def along_line(pairs: DataFrame) -> DataFrame:
    """``(farm, turbine, rank)`` from ``pairs(farm, a, b, r)``: the order in which neighbours are most alike (negative correlations
    count as none), from the end that gives low numbers low ranks; turbines are numbers.  Farms with one pair or more."""
    kinds = dict(pairs.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted({*pdf["a"], *pdf["b"]}))
        if len(names) > MOST_TURBINES:
            raise ValueError(f"more than {MOST_TURBINES} turbines of a farm")
        w = np.zeros((len(names), len(names)))
        a, b = np.searchsorted(names, pdf["a"]), np.searchsorted(names, pdf["b"])
        w[a, b] = w[b, a] = np.maximum(np.nan_to_num(pdf["r"].to_numpy(float)), 0)
        at = second_vector(w)
        if ((at - at.mean()) * (names - names.mean())).sum() < 0:
            at = -at
        order = np.lexsort([names, at])
        return pd.DataFrame({"farm": [pdf["farm"].iloc[0]] * len(names), "turbine": names[order], "rank": np.arange(1, len(names) + 1)})

    return pairs.where("a <> b").groupBy("farm").applyInPandas(run, f"farm {kinds['farm']}, turbine {kinds['a']}, rank int")


def along_axis(positions: DataFrame) -> DataFrame:
    """``positions(farm, lat, lon, ..)`` with ``along``, metres from the middle along the farm's principal axis, eastwards."""
    centre = positions.groupBy("farm").agg(F.avg("lat").alias("__lat"), F.avg("lon").alias("__lon"))
    x, y = angles.local_metres(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    rows = positions.join(centre, "farm").withColumns({"__x": x, "__y": y})
    turn = rows.groupBy("farm").agg((F.atan2(2 * F.covar_pop("__x", "__y"), F.var_pop("__x") - F.var_pop("__y")) / 2).alias("__turn"))
    along = F.col("__x") * F.cos("__turn") + F.col("__y") * F.sin("__turn")
    return rows.join(turn, "farm").withColumn("along", along).drop("__lat", "__lon", "__x", "__y", "__turn")


def inferred_layout(power: DataFrame, positions: DataFrame, rows: int = 6) -> DataFrame:
    """The columns of ``positions(farm, lat, lon, ..)`` with the ``turbine`` of ``power(farm, turbine, ts, power)`` that stands there,
    both in order along the line; gusts are what is left without the centred mean of ``rows`` rows."""
    gusts = high_passed(power, ["farm", "turbine"], ["ts"], "power", rows)
    turbines = along_line(correlations(gusts, "high_pass")).select("farm", "turbine", F.col("rank").alias("__number"))
    return rank_aligned(along_axis(positions), "along", turbines, "__number").drop("__number")

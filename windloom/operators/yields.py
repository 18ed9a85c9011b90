"""Long-term yield by a daily additive model: penalised splines of wind and temperature, refitted for every bootstrap draw.

A draw resamples days; what its fit needs of them are weighted sums of products of spline values, so each day is one row with
its number of times drawn, never copied, and tasks add up the normal equations of the draws that they have.  Cubic B-splines on even
knots are penalised by squared second differences of their coefficients; the penalty's weight is the one of a list with the least
generalised cross-validation, which the same sums give.  The long-term days enter as one vector, the sum of their spline values, as
the model is linear in them.  Values beyond the fitted days' range count as its ends.  Days with nulls are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.operators.followups import LOSS_ERROR, METER_ERROR, uniform
from windloom.operators.forecasting import numbered
from windloom.session import stored

#: Splines of wind and of temperature; weights of the penalty that are tried, relative to the mean diagonal of the products; days of a
#: year; what keeps the second set of splines apart from the first one's constant.
SPLINES, PENALTIES, YEAR, APART = (12, 6), tuple(10.0 ** (k / 2) for k in range(-10, 7)), 365.25, 1e-6


@dataclass
class Basis:
    """Cubic B-splines on even knots over each column's range."""

    low: np.ndarray
    high: np.ndarray
    sizes: tuple[int, ...]

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, splines of all columns)."""
        parts = []
        for k, n in enumerate(self.sizes):
            pieces = n - 3
            width = (self.high[k] - self.low[k]) or 1.0
            t = np.clip((x[:, k] - self.low[k]) / width, 0, 1) * pieces
            first = np.minimum(t.astype(int), pieces - 1)
            u = t - first
            out = np.zeros((len(x), n))
            weights = ((1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3)
            for j, w in enumerate(weights):
                out[np.arange(len(x)), first + j] = w / 6
            parts.append(out)
        return np.concatenate(parts, 1)

    def penalty(self) -> np.ndarray:
        total = np.zeros((sum(self.sizes),) * 2)
        at = 0
        for k, n in enumerate(self.sizes):
            d = np.diff(np.eye(n), 2, axis=0)
            total[at : at + n, at : at + n] = d.T @ d + (APART * np.eye(n) if k else 0)
            at += n
        return total


@dataclass
class Fit:
    coefficients: np.ndarray
    penalty: float
    freedom: float
    score: float


def solve(g: np.ndarray, b: np.ndarray, yy: float, n: float, penalty: np.ndarray, tried: tuple[float, ...] = PENALTIES) -> Fit:
    """From the sums of products: of splines (g), of splines and energy (b), of energy squared (yy) and of weights (n)."""
    best = None
    unit = np.trace(g) / len(g)
    for weight in tried:
        whole = g + weight * unit * penalty
        solved = np.linalg.lstsq(whole, np.column_stack([b, g]), rcond=None)[0]
        c, freedom = solved[:, 0], float(np.trace(solved[:, 1:]))
        left = max(yy - 2 * c @ b + c @ g @ c, 0.0)
        score = n * left / max(n - freedom, 1e-9) ** 2
        if best is None or score < best.score:
            best = Fit(c, weight, freedom, score)
    return best


def day_weights(days: DataFrame, draws: int, key: str = "day") -> DataFrame:
    """``(draw, day_no, weight)``: how often a day is drawn when as many as there are are drawn with replacement, by the MD5 of draw and
    place; days are numbered from 0 in order of ``key``."""
    n = days.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    places = days.sparkSession.range(draws).select(F.col("id").alias("draw")).join(F.broadcast(n))  # one row on the right
    places = places.withColumn("place", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("place").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    return places.groupBy("draw", pick.alias("day_no")).agg(F.count(F.lit(1)).alias("weight"))


def gam_yield(days: DataFrame, long_term: DataFrame, draws: int, sizes: tuple[int, int] = SPLINES, meter: float = METER_ERROR, losses: float = LOSS_ERROR) -> DataFrame:
    """``(draw, aep, freedom, penalty)``: a year's energy by each draw's fit of ``days(day, energy, wind, temperature)``, applied to the
    ``long_term(wind, temperature)`` days, times its errors of meter and losses.  Fewer days than splines give no rows."""
    own = days.na.drop(subset=["energy", "wind", "temperature"])
    ends = own.agg(F.count(F.lit(1)).alias("n"), *[f(c).cast("double").alias(f"{k}_{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in ("wind", "temperature")]).first()
    spark, schema = days.sparkSession, "draw long, aep double, freedom double, penalty double"
    if ends.n < sum(sizes):
        return spark.createDataFrame([], schema)
    basis = Basis(np.array([ends.lo_wind, ends.lo_temperature]), np.array([ends.hi_wind, ends.hi_temperature]), sizes)
    p = sum(sizes)

    def columns(pdf: pd.DataFrame) -> np.ndarray:
        return basis.values(pdf[["wind", "temperature"]].to_numpy(float))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            x, y = columns(pdf), pdf["energy"].to_numpy(float)
            for draw, at in pdf.groupby("draw").indices.items():
                w = pdf["weight"].to_numpy(float)[at]
                wx = x[at] * w[:, None]
                made = np.concatenate([(x[at].T @ wx).ravel(), wx.T @ y[at], [w @ y[at] ** 2, w.sum()]])
                held[draw] = held[draw] + made if draw in held else made
        yield pd.DataFrame({"draw": list(held), "sums": [x.tolist() for x in held.values()]})

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sum(np.array(pdf["sums"].tolist()), axis=0)
        fit = solve(s[: p * p].reshape(p, p), s[p * p : p * p + p], s[-2], s[-1], basis.penalty())
        return pd.DataFrame({"draw": [pdf["draw"].iloc[0]], "c": [fit.coefficients.tolist()], "freedom": fit.freedom, "penalty": fit.penalty})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": range(p), "s": columns(pdf).sum(0), "days": float(len(pdf))})

    rows = stored(numbered(own.select(F.col("day").cast("long").alias("day"), *[F.col(c).cast("double").alias(c) for c in ("energy", "wind", "temperature")]), "day").withColumnRenamed("i", "day_no"), "days")
    weighted = day_weights(rows, draws).join(rows, "day_no").select("draw", "weight", "energy", "wind", "temperature")
    fits = weighted.mapInPandas(gather, "draw long, sums array<double>").groupBy("draw").applyInPandas(fitted, "draw long, c array<double>, freedom double, penalty double")
    year = long_term.na.drop(subset=["wind", "temperature"]).select(F.col("wind").cast("double").alias("wind"), F.col("temperature").cast("double").alias("temperature"))
    year = year.mapInPandas(summed, "k int, s double, days double").groupBy("k").agg((F.sum("s") / F.sum("days") * YEAR).alias("s"))
    year = year.agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("year"))  # one row of as many numbers as splines
    scale = (1 + meter * (2 * uniform(F.col("draw"), "meter") - 1)) * (1 + losses * (2 * uniform(F.col("draw"), "losses") - 1))
    product = F.aggregate(F.zip_with("c", "year", lambda c, y: c * y["s"]), F.lit(0.0), lambda a, b: a + b)
    return fits.join(F.broadcast(year)).where(F.size("year") == p).select("draw", (product * scale).alias("aep"), "freedom", "penalty")


def long_term_wake(bins: DataFrame, long_term: DataFrame, draws: int) -> DataFrame:
    """``(draw, loss_pct, loss_lt_pct)`` of ``bins(day_no, direction, speed, power, free)``, sums of power and of what it were in free
    flow per day and bin: the loss over the drawn days, and with each bin's share replaced by its hours in the ``long_term(direction,
    speed, hours)`` distribution.  Bins that a draw's days or the long term don't have count in neither.

    Draws weight the days' sums; no record is copied."""
    days = bins.select("day_no").distinct()
    picked = day_weights(days, draws)
    drawn = picked.join(bins, "day_no").groupBy("draw", "direction", "speed").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("power", "free", "records")])
    lost = 100 * (1 - F.try_divide(F.sum("power"), F.sum("free")))
    plain = drawn.groupBy("draw").agg(lost.alias("loss_pct"))
    both = drawn.join(long_term, ["direction", "speed"]).where("records > 0")
    mean = lambda c: F.sum(F.col(c) / F.col("records") * F.col("hours"))
    lt = both.groupBy("draw").agg((100 * (1 - F.try_divide(mean("power"), mean("free")))).alias("loss_lt_pct"))
    return plain.join(lt, "draw", "left")

"""Forecast baselines, backtests, metrics and grading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
#: Rows of a part of a series without groups.
PART_ROWS = 100_000


def metrics(rows: DataFrame, groups: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, R2, MAPE (without zero actuals) and bias per group."""
    e, a = F.col(predicted) - F.col(actual), F.col(actual)
    own = rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return own.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"),
        (100 * F.avg(F.abs(F.try_divide(e, a)))).alias("mape"), F.avg(e).alias("bias"),
    )


def numbered(series: DataFrame, key: str) -> DataFrame:
    """``i``: place of each row in time, from 0.  Parts of 10,000 keys are counted first, so no task sorts the whole
    series; the table of parts has one row for each."""
    part = F.floor(F.col(key) / 10_000)
    rows = series.withColumn("__part", part)
    sums = rows.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return rows.withColumn("__k", inside).join(offsets, "__part").withColumn("i", (F.col("__before") + F.col("__k")).cast("long")).drop("__part", "__k", "__before")


def split_chronological(series: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """Rows numbered in time with ``train`` for the first ``share`` of them."""
    n = series.agg(F.count(F.lit(1)).alias("__n"))
    return numbered(series, key).join(F.broadcast(n)).withColumn("train", F.col("i") < F.floor(F.col("__n") * share)).drop("__n")


def windows(series: DataFrame, length: int = 24) -> DataFrame:
    """Whole tumbling windows over the rows after the split: ``w`` and ``lead`` (from 1)."""
    test = series.where(~F.col("train"))
    first = test.agg(F.min("i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    at = F.col("i") - F.col("__first")
    rows = test.join(F.broadcast(first)).withColumns({"w": F.floor(at / length), "lead": (at % length + 1)})
    return rows.where((F.col("w") + 1) * length <= F.col("__n")).drop("__first", "__n")


def naive_forecasts(series: DataFrame, value: str, length: int = 24, group: str | None = None) -> DataFrame:
    """Persistence, the same row of the last window, and the last window's mean, for every row of every window, from rows
    before it only.  ``series`` is numbered and split."""
    w = windows(series, length)
    origin = F.col("i") - F.col("lead")
    past = series.select(F.col("i").alias("j"), F.col(value).alias("v"))
    last = w.withColumn("o", origin).join(past.withColumnsRenamed({"j": "o", "v": "persistence"}), "o", "left")
    season = last.withColumn("s", F.col("i") - length).join(past.withColumnsRenamed({"j": "s", "v": "seasonal"}), "s", "left")
    origins = w.select("w", origin.alias("o")).distinct().withColumn("j", F.explode(F.sequence(F.col("o") - (length - 1), F.col("o"))))
    mean = origins.join(past, "j").groupBy("w").agg(F.avg("v").alias("mean"))
    rows = season.join(mean, "w").select("w", "lead", F.col(value).alias("actual"), "persistence", "seasonal", "mean")
    return rows.unpivot(["w", "lead", "actual"], ["persistence", "seasonal", "mean"], "method", "predicted")


def _with_rows_before(series: DataFrame, order: str, n: int, groups: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The series and the columns to partition it by so that each row's partition holds the n rows before it.

    With groups those are the partitions.  Without, rows are numbered and cut into parts of ``PART_ROWS``, each with the last n
    rows of the part before (``__own`` false): no task sorts the whole series.
    """
    if groups:
        return series.withColumn("__own", F.lit(True)), groups
    rows = numbered(series.withColumn("__key", F.col(order)), "__key").drop("__key").withColumnRenamed("i", "__i") if "i" not in series.columns else series.withColumn("__i", F.col("i"))
    part, near = F.floor(F.col("__i") / PART_ROWS), F.col("__i") % PART_ROWS >= PART_ROWS - n
    own = F.struct(part.alias("p"), F.lit(True).alias("own"))
    both = F.when(near, F.array(own, F.struct((part + 1).alias("p"), F.lit(False).alias("own")))).otherwise(F.array(own))
    rows = rows.withColumn("__p", F.explode(both))
    return rows.select(*series.columns, F.col("__p.p").alias("__p"), F.col("__p.own").alias("__own")), ["__p"]


def lag_features(series: DataFrame, order: str, value: str, lags=LAGS, groups: list[str] | None = None) -> DataFrame:
    rows, keys = _with_rows_before(series, order, max(lags), groups)
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags}).where("__own").drop("__own", "__p")


def look_back(series: DataFrame, order: str, value: str, n: int = 72, groups: list[str] | None = None) -> DataFrame:
    """The last n values up to each row as an array; rows without n have NULL."""
    rows, keys = _with_rows_before(series, order, n - 1, groups)
    seen = F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0))
    return rows.withColumn("history", F.when(F.size(seen) == n, seen)).where("__own").drop("__own", "__p")


def rolling_error(rows: DataFrame, order: str, n: int = 168, least: int = 24, groups: list[str] | None = None) -> DataFrame:
    """Rolling MAPE over the last n rows, NULL under ``least`` errors."""
    rows, keys = _with_rows_before(rows, order, n - 1, groups)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    ape = 100 * F.abs(F.try_divide(F.col("predicted") - F.col("actual"), F.col("actual")))
    rows = rows.withColumn("__a", ape).withColumn("rolling_mape", F.when(F.count("__a").over(w) >= least, F.avg("__a").over(w)))
    return rows.where("__own").drop("__a", "__own", "__p")


def actual_vs_predicted(actual: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Rows with both, the residual, and the ratio (NULL for a prediction of 0)."""
    return actual.join(predicted, key).where("actual is not null and predicted is not null").withColumns({"residual": F.col("actual") - F.col("predicted"), "ratio": F.try_divide("actual", "predicted")})


def out_of_band(rows: DataFrame, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """Rows whose ratio lies outside the band, and their share of all rows (NULL ratios count in the denominator)."""
    bad = F.coalesce((F.col("ratio") < low) | (F.col("ratio") > high), F.lit(False))
    return rows.agg(F.count_if(bad).alias("n_bad"), F.avg(bad.cast("double")).alias("share_bad"), F.count(F.lit(1)).alias("n"))


def recent_against_all(rows: DataFrame, key: str, recent: int = 168) -> DataFrame:
    """MAPE over all rows and over the last ``recent``."""
    ape = 100 * F.abs(F.try_divide(F.col("actual") - F.col("predicted"), F.col("actual")))
    last = rows.orderBy(F.desc(key)).limit(recent)
    return rows.agg(F.avg(ape).alias("mape")).join(last.agg(F.avg(ape).alias("recent_mape")))


def grade(log: DataFrame, actuals: DataFrame, lag_h: int = 30, coverage: float = 0.9) -> DataFrame:
    """Mean absolute error of logged forecasts whose last target is ``lag_h`` hours past and of whose targets at least
    ``coverage`` have actuals.  ``log(run_id, technique, target, predicted)``, ``actuals(target, actual)``; hours."""
    now = actuals.agg(F.max("target").alias("__now"))
    joined = log.join(actuals, "target", "left").join(F.broadcast(now))
    out = joined.groupBy("run_id", "technique", "__now").agg(
        F.max("target").alias("last"), F.avg(F.col("actual").isNotNull().cast("double")).alias("coverage"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"), F.count("actual").alias("n")
    )
    return out.where((F.col("last") + lag_h <= F.col("__now")) & (F.col("coverage") >= coverage)).drop("__now", "last")


def imbalance_cost(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups).agg(F.sum(F.abs(F.col("actual") - F.col("predicted")) * F.col("price")).alias("cost"))


def safety_margin(rows: DataFrame, groups: list[str], under_cost: float, over_cost: float) -> DataFrame:
    """Newsvendor margin: the normal quantile of the critical ratio times the residuals' deviation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(under_cost / (under_cost + over_cost))
    return rows.groupBy(*groups).agg((F.lit(z) * F.stddev_samp(F.col("actual") - F.col("predicted"))).alias("margin"))


def calibration(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Straight line y = slope x + intercept by least squares."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def retrain(recent: float, overall: float, age_days: int, worse: float = 1.25, old: int = 90) -> bool:
    """Retrain when recent errors are a quarter above the overall and the model is old."""
    return recent > worse * overall and age_days > old


def allocation(rows: DataFrame, ceiling: float, floor_share: float = 0.6) -> DataFrame:
    """Shares of a grid ceiling per hour and farm: each farm its floor first, then what is left in proportion to what
    each still has.  ``rows(hour, farm, available)``."""
    low = F.col("available") * floor_share
    sums = rows.groupBy("hour").agg(F.sum("available").alias("__all"), F.sum(low).alias("__low"))
    rest = F.greatest(F.least(F.lit(ceiling), F.col("__all")) - F.col("__low"), F.lit(0.0))
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(ceiling), F.col("__low")), F.lit(1.0)))
    got = low * scale + F.coalesce(F.try_divide((F.col("available") - low) * rest, F.col("__all") - F.col("__low")), F.lit(0.0))
    return rows.join(sums, "hour").select("hour", "farm", "available", got.alias("allocated"))

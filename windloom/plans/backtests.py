"""Day-ahead backtests of fitted models: every event type is a farm, its hourly means the output; hours without any are left out.

Models are fitted on the first 80 % of a farm's rows and forecast the rest in whole days, each from the rows before it.  The fits are
iterative, so there is no SQL; tests compare filters, smoothers and splits with plain NumPy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators import boosting, forecasting
from windloom.operators import statespace as ss
from windloom.plans.relational import rounded
from windloom.plans.views import reading
from windloom.session import stored

SHARE = 0.8


def farm_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    rows = reading(spark, sf_dir).groupBy(F.col("event_type").alias("farm"), h.alias("h"))
    return rows.agg(F.avg("value").alias("output"), F.avg("power").alias("power"), F.count(F.lit(1)).cast("double").alias("n"))


def _metrics(rows: DataFrame) -> DataFrame:
    return rounded(forecasting.metrics(rows, ["farm"]), mae=6, rmse=6, r2=6, mape=5, bias=6)


def _fitted(parts: DataFrame, maker: ss.Maker, box: tuple, **options) -> DataFrame:
    return ss.fit(ss.training(parts, "farm", SHARE), "farm", maker, *box, **options)


def sarima_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIMA(1,1,1)(1,0,0)[24] by maximum likelihood."""
    parts, maker = ss.parts_of(farm_hours(spark, sf_dir), "farm", "h", "output"), ss.sarima_maker()
    fitted = _fitted(parts, maker, ss.SARIMA_BOX, points=3, rounds=7, shrink=0.6)
    return _metrics(ss.backtest(parts, "farm", maker, fitted, SHARE))


def _structural(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ss.Maker, DataFrame]:
    parts, maker = ss.parts_of(farm_hours(spark, sf_dir), "farm", "h", "output"), ss.structural_maker()
    known = ss.training(parts, "farm", SHARE)
    fitted = ss.fit(known, "farm", maker, *ss.STRUCTURAL_BOX, points=5, rounds=3)
    return parts, maker, ss.refit(known, "farm", maker, fitted, [0, 1], 2)


def structural_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local level and daily season, variances by likelihood and expectation maximisation."""
    parts, maker, fitted = _structural(spark, sf_dir)
    return _metrics(ss.backtest(parts, "farm", maker, fitted, SHARE))


def structural_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and season of every hour, given the farm's whole series."""
    parts, maker, fitted = _structural(spark, sf_dir)
    rows = ss.smoothed(parts, "farm", maker, fitted)
    return rounded(rows.select("farm", F.col("at").alias("h"), "actual", F.col("states")[0].alias("level"), F.col("states")[1].alias("season")), actual=6, level=4, season=4)


def _smoothing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ss.Maker, DataFrame]:
    rows, maker = farm_hours(spark, sf_dir), ss.smoothing_maker()
    parts = ss.parts_of(rows, "farm", "h", "output")
    consts = ss.smoothing_start(rows, "farm", "h", "output")
    return rows, parts, maker, _fitted(parts, maker, ss.SMOOTHING_BOX, consts=consts, points=3, rounds=7, shrink=0.6)


def smoothing_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holt-Winters with fitted smoothing."""
    _, parts, maker, fitted = _smoothing(spark, sf_dir)
    return _metrics(ss.backtest(parts, "farm", maker, fitted, SHARE))


def _windows(rows: DataFrame, back: int, ahead: int) -> DataFrame:
    """``(farm, h, x, y)``: the ``back`` outputs up to an hour and the ``ahead`` after it."""
    seen = forecasting.look_back(rows, "h", "output", back + ahead, ["farm"]).where("history is not null")
    return seen.select("farm", "h", F.slice("history", 1, back).alias("x"), F.slice("history", back + 1, ahead).alias("y"))


def direct_boosting_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 24 hours from the last 72 by boosted trees whose leaves hold all 24 values: 100 trees of depth 4."""
    rows, back, ahead = farm_hours(spark, sf_dir).select("farm", "h", "output"), 72, 24
    parts = ss.parts_of(rows, "farm", "h", "output")
    scored = stored(ss.scored_rows(parts, "farm", SHARE, ahead), "scored")
    first = scored.groupBy("farm").agg(F.min("at").alias("first"))
    known = _windows(rows.join(first, "farm").where(F.col("h") < F.col("first")).select("farm", "h", "output"), back, ahead)
    model = boosting.boosted(known, "farm")
    origins = forecasting.look_back(rows, "h", "output", back, ["farm"]).where("history is not null").select("farm", F.col("h").alias("origin"), F.col("history").alias("x"))
    made = model.predict(origins.join(scored.select("farm", "origin").distinct(), ["farm", "origin"]))
    made = made.select("farm", "origin", F.posexplode("predicted").alias("k", "predicted")).withColumn("lead", F.col("k") + 1)
    return _metrics(scored.join(made, ["farm", "origin", "lead"]))


def recursive_boosting_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step ahead by 200 trees on eight lags, 24 steps walked from its own forecasts."""
    rows, lags = farm_hours(spark, sf_dir).select("farm", "h", "output"), list(forecasting.LAGS)
    scored = stored(ss.scored_rows(ss.parts_of(rows, "farm", "h", "output"), "farm", SHARE), "scored")
    seen = forecasting.look_back(rows, "h", "output", max(lags) + 1, ["farm"]).where("history is not null")
    known = seen.join(scored.groupBy("farm").agg(F.min("at").alias("first")), "farm").where(F.col("h") < F.col("first"))
    known = known.select("farm", F.array(*[F.element_at("history", -1 - k) for k in lags]).alias("x"), F.array("output").alias("y"))
    model = boosting.boosted(known, "farm", trees=200, rate=0.05)
    origins = seen.select("farm", F.col("h").alias("origin"), "history").join(scored.select("farm", "origin").distinct(), ["farm", "origin"])
    return _metrics(scored.join(boosting.recursive(model, origins, lags), ["farm", "origin", "lead"]))


def hybrid_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holt-Winters with fitted smoothing, corrected by trees that learned its residuals on the first 80 % from the hour's other
    channels: 200 trees of depth 4 at rate 0.05."""
    rows, parts, maker, fitted = _smoothing(spark, sf_dir)
    features = F.array("power", "n", (F.col("h") % 24).cast("double"))
    own = rows.select("farm", F.col("h").alias("at"), features.alias("x"))
    known = ss.training(parts, "farm", SHARE)
    values = ss.fitted_values(known, "farm", maker, fitted).where(~F.isnan("actual"))
    residuals = values.select("farm", "at", F.array(F.col("actual") - F.col("predicted")).alias("y"))
    model = boosting.boosted(residuals.join(own, ["farm", "at"]), "farm", trees=200, rate=0.05)
    made = ss.backtest(parts, "farm", maker, fitted, SHARE).join(own, ["farm", "at"])
    made = model.predict(made.withColumnRenamed("predicted", "smooth"), name="correction")
    return _metrics(made.withColumn("predicted", F.col("smooth") + F.col("correction")[0]))


_NAMES = (sarima_backtest, structural_backtest, structural_components, smoothing_backtest, direct_boosting_backtest, recursive_boosting_backtest, hybrid_backtest)
QUERIES = {f.__name__: f for f in _NAMES}

"""Sensor models by peers, cross-validation, exports over all farms, notes and stored vector indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.functions.text import numbers
from windloom.operators import models, retrieval
from windloom.operators.watch import top_peers
from windloom.session import shared_folder

#: Bins of a pass of ``quantile``.
QUANTILE_BINS = 4096


def peer_design(readings: DataFrame, pairs: DataFrame, k: int = 2) -> DataFrame:
    """``(sensor, h, y, x1..xk)``: each reading with those of the sensor's k closest peers at the same time (all must be there).
    ``readings(sensor, h, v)``, ``pairs(sensor, peer, r)``: an equi-join on (peer, time) for each place."""
    near = top_peers(pairs, k)
    out = readings.select("sensor", "h", F.col("v").alias("y"))
    for p in range(1, k + 1):
        own = near.where(F.col("position") == p).select("sensor", F.col("peer").alias("__p"))
        values = readings.select(F.col("sensor").alias("__p"), "h", F.col("v").alias(f"x{p}"))
        out = out.join(own, "sensor").join(values, ["__p", "h"]).drop("__p")
    return out


def sensor_models(design: DataFrame, features: list[str], train: Column, quantile: float = 0.99, least_r2: float = 0.5) -> DataFrame:
    """One row a sensor: R2 of a ridge model on the rows after its training part, the quantile of the absolute residual there, and
    whether the sensor is watched (R2 of ``least_r2`` or more)."""
    fitted = models.ridge_residuals(design.withColumn("__train", train), "sensor", "h", features, "y", "__train", least=2)
    rest = fitted.where(~F.col("__train") & F.col("residual").isNotNull())
    out = rest.groupBy("sensor").agg(
        (1 - F.avg(F.col("residual") * F.col("residual")) / F.greatest(F.var_pop("y"), F.lit(1e-12))).alias("r2"),
        F.percentile(F.abs("residual"), quantile).alias("threshold"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("watched", F.col("r2") >= least_r2)


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a number between the two values next to it, as ``percentile`` gives it, without all values in one task:
    counts in ``QUANTILE_BINS`` even bins, and again inside the bins of those two values, until each bin has a single value."""
    v = F.col(column).cast("double")
    ends = rows.agg(F.min(v).alias("a"), F.max(v).alias("b"), F.count(v).alias("n")).first()
    if not ends.n:
        return None
    at = share * (ends.n - 1)

    def value(k: int) -> float:
        a, b = ends.a, ends.b
        while a < b:
            number = F.least(F.floor((v - a) / (b - a) * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1))
            kept = F.when(v < a, -1).otherwise(number)
            bins = rows.where(v <= b).groupBy(kept.alias("bin")).agg(F.count(v).alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).orderBy("bin").collect()
            seen = 0
            for own in bins:
                seen += own.n
                if seen > k:
                    break
            a, b = own.a, own.b
        return a

    low = value(int(at))
    part = at - int(at)
    return low if part == 0 else (1 - part) * low + part * value(int(at) + 1)


def cross_validated(rows: DataFrame, x: str, y: str, fold: Column, order: str, share: float = 0.8) -> DataFrame:
    """R2 of y on x by a straight line on rows it wasn't fitted on: of each fold, and of the last part in time.  One pass gathers
    the sums of every fold; the lines of all other folds come from their differences with the total."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), fold.alias("fold"), F.col(order).alias("o"))
    names = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    late = own.select("x", "y", (F.col("o") > F.lit(quantile(own, "o", share)).cast("double")).alias("late"))
    sums = lambda part, *keys: part.groupBy(*keys).agg(*[F.sum(v).alias(c) for c, v in names.items()])
    folds, split = sums(own, "fold"), sums(late, "late")

    def judged(part: DataFrame, rest: dict[str, Column], name: Column) -> DataFrame:
        n, sx, sy, xx, xy = (rest[c] for c in ("n", "sx", "sy", "xx", "xy"))
        slope = (xy - sx * sy / n) / (xx - sx * sx / n)
        icept = (sy - slope * sx) / n
        error = F.col("yy") + slope * slope * F.col("xx") + icept * icept * F.col("n") + 2 * slope * icept * F.col("sx") - 2 * slope * F.col("xy") - 2 * icept * F.col("sy")
        return part.select(name.alias("part"), F.col("n").cast("long").alias("n"), (1 - error / (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"))

    whole = folds.agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    by_fold = judged(folds.join(F.broadcast(whole)), {c: F.col(f"all_{c}") - F.col(c) for c in names}, F.concat(F.lit("fold "), F.col("fold").cast("string")))
    early = split.where("not late").select(*[F.col(c).alias(f"all_{c}") for c in names])
    last = judged(split.where("late").join(F.broadcast(early)), {c: F.col(f"all_{c}") for c in names}, F.lit("last"))
    return by_fold.unionByName(last)


def farm_export(efficiency: DataFrame) -> DataFrame:
    """One row a farm of ``efficiency(farm, turbine, capacity_factor, peak_cp)``: turbines, mean, best and worst one."""
    best = F.struct("capacity_factor", "turbine")
    return efficiency.groupBy("farm").agg(F.count(F.lit(1)).alias("turbines"), F.avg("capacity_factor").alias("mean_capacity_factor"), F.max(best).alias("b"), F.min(best).alias("w")).select("farm", "turbines", "mean_capacity_factor", F.col("b.turbine").alias("best"), F.col("w.turbine").alias("worst"))


def compact_summary(tree: DataFrame, key: str, node: str, drop: list[str], extreme: str) -> DataFrame:
    """Result trees without the fields of a list, with the least and largest ``extreme`` of all of them."""
    ends = tree.agg(F.min(F.col(f"{node}.{extreme}")).alias("least"), F.max(F.col(f"{node}.{extreme}")).alias("largest"))
    return tree.select(key, F.col(node).dropFields(*drop).alias(node)).join(F.broadcast(ends)).select(key, f"{node}.*", "least", "largest")


def wake_note(loss_pct: Column, records: Column, least: int = 50) -> Column:
    """What is said of a turbine's measured wake loss."""
    return (
        F.when(records < least, "too few records for a wake loss")
        .when(loss_pct < 0, F.format_string("makes %.1f %% more than the turbines in free wind: a site gradient, no wake", -loss_pct))
        .when(loss_pct < 5, F.format_string("small wake loss of %.1f %%", loss_pct))
        .otherwise(F.format_string("wake loss of %.1f %%", loss_pct))
    )


def single_number(text: Column) -> Column:
    """The number of a text that prints exactly one, else NULL."""
    found = numbers(text)
    return F.when(F.size(found) == 1, found[0])


def looked_up(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of some ids; the filter reaches the scan."""
    return rows.where(F.col(key).isin(values))


def build_index(chunks_: DataFrame, fingerprint: Column) -> str:
    """Write chunks with their vectors as a searchable table, with the fingerprint of each text; the path of it."""
    path = shared_folder(chunks_.sparkSession, "index")
    chunks_.withColumn("fingerprint", fingerprint).write.parquet(path)
    return path


def index_is_fresh(spark: SparkSession, path: str, texts: DataFrame, fingerprint: Column) -> bool:
    """Whether the index holds just these texts: no fingerprint is on one side only."""
    there, now = spark.read.parquet(path).select("fingerprint"), texts.select(fingerprint.alias("fingerprint"))
    return there.exceptAll(now).isEmpty() and now.exceptAll(there).isEmpty()


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    return retrieval.search(queries, spark.read.parquet(path), k)


def live_forecasts(series: DataFrame, group: str, order: str, value: str, horizon: int = 48, season: int = 24) -> DataFrame:
    """The next ``horizon`` values by two techniques: the last season repeated, and Holt-Winters (groups of two seasons and more)."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    last = series.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= season)
    steps = F.sequence(F.lit(1), F.lit(-(-horizon // season)))
    naive = last.select(group, F.explode(steps).alias("__s"), (season + 1 - F.col("__k")).alias("__at"), F.col(value).alias("prediction"))
    naive = naive.select(group, ((F.col("__s") - 1) * season + F.col("__at")).cast("int").alias("lead"), "prediction", F.lit("seasonal").alias("technique")).where(F.col("lead") <= horizon)
    smooth = models.holt_winters(series, group, order, value, season, horizon).withColumn("technique", F.lit("holt-winters"))
    return naive.unionByName(smooth)

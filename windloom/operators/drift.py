"""Distribution drift: population stability index and the two-sample Kolmogorov-Smirnov distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def psi(rows: DataFrame, value: str, reference: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """PSI of the rows outside the reference against those inside, over the reference's quantile bins (right-closed, open
    at both ends; shares at least ``floor``)."""
    edges = rows.where(F.col(reference)).agg(F.percentile(value, [k / bins for k in range(1, bins)]).alias("__e"))
    number = F.size(F.filter("__e", lambda e: e < F.col(value)))
    own = rows.where(F.col(value).isNotNull()).join(F.broadcast(edges)).groupBy(number.alias("bin")).agg(F.count_if(reference).alias("r"), F.count_if(~F.col(reference)).alias("c"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(own, "bin", "left").na.fill(0, ["r", "c"])
    total = every.agg(F.sum("r").alias("__r"), F.sum("c").alias("__c"))
    share = lambda n, t: F.greatest(F.coalesce(F.try_divide(n, t), F.lit(0.0)), F.lit(floor))
    p, q = share("c", "__c"), share("r", "__r")
    return every.join(F.broadcast(total)).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def ks_distance(rows: DataFrame, value: str, reference: str) -> DataFrame:
    """Largest gap of the two empirical distributions; running counts go over distinct values, in parts of equal ranks."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(reference).alias("r"), F.count_if(~F.col(reference)).alias("c"))
    edges = counts.agg(F.percentile_approx(value, [k / 64 for k in range(1, 64)], 1000).alias("__e"))
    parts = counts.join(F.broadcast(edges)).withColumn("__part", F.size(F.filter("__e", lambda e: e < F.col(value)))).drop("__e")
    sums = parts.groupBy("__part").agg(F.sum("r").alias("__r"), F.sum("c").alias("__c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
    offsets = sums.select("__part", F.coalesce(F.sum("__r").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("c0"))
    total = sums.agg(F.sum("__r").alias("rt"), F.sum("__c").alias("ct"))
    run = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.try_divide(F.col("r0") + F.sum("r").over(run), F.col("rt")) - F.try_divide(F.col("c0") + F.sum("c").over(run), F.col("ct")))
    return parts.join(F.broadcast(offsets), "__part").join(F.broadcast(total)).withColumn("g", gap).agg(F.max("g").alias("ks"))

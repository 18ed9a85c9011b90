"""Ordered rows and exact percentiles of a few large groups: work is cut by ranges of the order, so no task holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.session import stored

#: Rows of a part at most (about).  Accuracy of the sketches that bracket a percentile (of so many values or more), and the bracket's
#: half width as a share of the values.
PART_ROWS, ACCURACY, MARGIN = 500_000, 10_000, 0.0005


def with_neighbours(rows: DataFrame, groups: list[str], order: list[str], before: int, after: int = 0) -> DataFrame:
    """The rows with their ``__part``, a range of (groups, order), and copies (``__own`` false) of the ``before`` and ``after`` rows of
    the group around each part: windows over (groups, ``__part``) see the neighbours of all own rows."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    parts = stored(rows.repartitionByRange(n, *groups, *order).withColumn("__part", F.spark_partition_id()), "parts")
    inside, along = Window.partitionBy(*groups, "__part"), Window.partitionBy(*groups).orderBy("__part")
    # One row a group and part: their place in the group, and the group's rows up to their end.
    sizes = parts.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = stored(sizes.withColumns({"__i": F.row_number().over(along), "__to": F.sum("__n").over(along)}), "sizes")
    out = parts.withColumn("__own", F.lit(True))
    for most, way, backwards in ((before, 1, True), (after, -1, False)):
        if most:
            turned = [F.desc(c) if backwards else F.asc(c) for c in order]
            edge = parts.withColumn("__j", F.row_number().over(inside.orderBy(*turned))).where(F.col("__j") <= most).join(sizes, [*groups, "__part"])
            edge = edge.withColumn("__i", F.explode(F.array(*[F.col("__i") + way * k for k in range(1, most + 1)]))).withColumnsRenamed({"__n": "__n0", "__to": "__to0"}).drop("__part")
            met = edge.join(sizes, [*groups, "__i"])
            between = F.col("__to") - F.col("__n") - F.col("__to0") if backwards else F.col("__to0") - F.col("__n0") - F.col("__to")
            out = out.unionByName(met.where(between + F.col("__j") <= most).select(*rows.columns, "__part", F.lit(False).alias("__own")))
    return out.repartition(n, *groups, "__part")


def percentiles(rows: DataFrame, groups: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``(groups, name, ..)``: exact percentiles ``{name: (column, share)}`` as ``F.percentile`` gives them.  A sketch brackets each
    within some ten-thousandths of the rows; of the rows only those in the bracket are sorted, the smaller ones are counted."""
    near = lambda p: [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]
    found = [F.percentile_approx(c, F.array(*[F.lit(x) for x in near(p)]), F.lit(ACCURACY)).alias(f"__b_{k}") for k, (c, p) in wanted.items()]
    # The smallest and the largest share of a sketch may miss the ends; few values are sorted whole.
    ends = [f(c).alias(f"__{w}_{k}") for k, (c, _) in wanted.items() for f, w in ((F.min, "a"), (F.max, "z"))]
    brackets = stored(rows.groupBy(*groups).agg(*found, *ends, *[F.count(c).alias(f"__n_{k}") for k, (c, _) in wanted.items()]), "brackets")
    whole = lambda k: F.col(f"__n_{k}") < ACCURACY
    low = {k: F.when(whole(k) | F.lit(p <= MARGIN), F.col(f"__a_{k}")).otherwise(F.col(f"__b_{k}")[0]) for k, (_, p) in wanted.items()}
    high = {k: F.when(whole(k) | F.lit(p >= 1 - MARGIN), F.col(f"__z_{k}")).otherwise(F.col(f"__b_{k}")[1]) for k, (_, p) in wanted.items()}
    met = rows.select(*groups, *{c for c, _ in wanted.values()}).join(brackets, groups)
    smaller = met.groupBy(*groups).agg(*[F.count_if(F.col(c) < low[k]).alias(f"__s_{k}") for k, (c, _) in wanted.items()], *[F.first(f"__n_{k}").alias(f"__n_{k}") for k in wanted])
    each = F.array(*[F.struct(F.lit(k).alias("what"), F.col(c).cast("double").alias("v"), ((F.col(c) >= low[k]) & (F.col(c) <= high[k])).alias("in")) for k, (c, _) in wanted.items()])
    values = met.select(*groups, F.explode(F.filter(each, lambda e: e["in"])).alias("e")).groupBy(*groups, F.col("e.what").alias("what"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*groups, "what").orderBy("v")
    values = values.withColumn("to", F.sum("c").over(upto)).join(smaller, groups)
    made, out = [], []
    for k, (_, p) in wanted.items():
        at, below = (F.col(f"__n_{k}") - 1) * p, F.col(f"__s_{k}")
        value = lambda rank: F.when(below <= rank, F.min(F.when((F.col("what") == k) & (below + F.col("to") > rank), F.col("v"))))  # noqa: B023, E731
        made += [value(F.floor(at)).alias(f"__lo_{k}"), value(F.ceil(at)).alias(f"__hi_{k}")]
        lo, hi = F.col(f"__lo_{k}"), F.col(f"__hi_{k}")
        missed = F.raise_error(F.lit(f"the sketch of {k} misses its percentile")).cast("double")
        out.append(F.when(F.col(f"__n_{k}") == 0, None).when(lo.isNull() | hi.isNull(), missed).when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(k))
    keys = [*groups, *[f"__{x}_{k}" for k in wanted for x in "ns"]]
    return brackets.select(*groups).join(values.groupBy(*keys).agg(*made).select(*groups, *out), groups, "left")

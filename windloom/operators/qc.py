"""Quality control of sensor series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.functions.wind import TIE, right_closed_bin
from windloom.operators.parts import percentiles, with_neighbours
from windloom.session import stored


def frozen(value: Column, window, repeats: int = 3) -> Column:
    """Rows in a run of at least ``repeats`` equal neighbouring values (rows as ordered; NULL equals nothing)."""
    same = F.coalesce(value == F.lag(value).over(window), F.lit(False))
    # Rows up to `repeats - 2` before and after: some stretch of `repeats - 1` equal steps covers this row.
    steps = [F.lead(same, k).over(window) if k > 0 else F.lag(same, -k).over(window) if k < 0 else same for k in range(-(repeats - 2), repeats)]
    steps = [F.coalesce(s, F.lit(False)) for s in steps]
    need = repeats - 1
    covers = [steps[k : k + need] for k in range(repeats)]
    out = F.lit(False)
    for part in covers:
        every = F.lit(True)
        for s in part:
            every = every & s
        out = out | every
    return out


def frozen_flags(rows: DataFrame, groups: list[str], order: list[str], value: str, repeats: int = 3) -> DataFrame:
    return rows.withColumn("frozen", frozen(F.col(value), Window.partitionBy(*groups).orderBy(*order), repeats))


def bin_outliers(rows: DataFrame, groups: list[str], by: str, value: str, width: float, low: float, high: float, spread: float = 2.0) -> DataFrame:
    """``outlier``: further than ``spread`` sample deviations from the median of ``value`` among the group's rows in the
    same right-closed bin of ``by``; rows at that limit, in any order of summing, or outside (low, high] are never flagged."""
    number = F.when((F.col(by) > low) & (F.col(by) <= high), right_closed_bin(F.col(by), low, width))
    rows = rows.withColumn("bin", number)
    stats = rows.where("bin is not null").groupBy(*groups, "bin").agg(F.median(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    flag = F.coalesce(F.abs(F.col(value) - F.col("__m")) > spread * (1 + TIE) * F.col("__s"), F.lit(False))
    return rows.join(stats, [*groups, "bin"], "left").withColumn("outlier", flag).drop("__m", "__s")


def qc_flags(rows: DataFrame, order: list[str], rated_kw: float) -> DataFrame:
    """``frozen``, ``stopped`` (under 2 % of rated in 5 m/s or more), ``outlier`` and ``bad`` per row of a turbine."""
    flagged = frozen_flags(rows, ["turbine"], order, "wind")
    stopped = F.coalesce((F.col("power") < 0.02 * rated_kw) & (F.col("wind") >= 5), F.lit(False))
    flagged = bin_outliers(flagged.withColumn("stopped", stopped), ["turbine"], "power", "wind", 100.0, 0.02 * rated_kw, 0.95 * rated_kw)
    return flagged.withColumn("bad", F.col("frozen") | F.col("stopped") | F.col("outlier"))


def qc_summary(flagged: DataFrame) -> DataFrame:
    """Shares of flagged rows per turbine and over all (turbine NULL)."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_share")
    return flagged.rollup("turbine").agg(F.count(F.lit(1)).alias("n"), share("frozen"), share("stopped"), share("outlier"), share("bad"))


def run_lengths(rows: DataFrame, groups: list[str], order: list[str], mask: Column) -> DataFrame:
    """``run``: length of the run of true masks a row is in, 0 elsewhere."""
    w = Window.partitionBy(*groups).orderBy(*order)
    m = F.coalesce(mask, F.lit(False))
    marked = rows.withColumn("__m", m).withColumn("__island", F.sum((~F.col("__m")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*groups, "__island", "__m")
    return marked.withColumn("run", F.when(F.col("__m"), F.count(F.lit(1)).over(inside)).otherwise(0)).drop("__m", "__island")


#: Limits of the sensor checks (fixed values): rows of a stale run and of the scatter window, factors, least reference rows.
STALE_ROWS, STALE_FACTOR, COMMON_SHARE, SPREADS, STEP_FACTOR, SCATTER_ROWS, SCATTER_FACTOR, LEAST_REFERENCE = 6, 3.0, 0.01, 2.0, 3.0, 6, 4.0, 100
TEMPERATURE_LIMITS = (-50.0, 250.0)


def sensor_checks(rows: DataFrame, group: str, order: list[str], value: str, reference: str, temperature: bool = False) -> DataFrame:
    """Five checks per reading, each against the sensor's own reference rows: ``gap``, ``stale``, ``out_of_range``, ``step``
    and ``erratic``, and ``bad`` for any.  Sensors with under 100 reference readings get only ``gap``."""
    x, r = F.col(value), F.col(reference)
    # Windows go over parts of a sensor's rows that hold what lies before and after them.
    w = Window.partitionBy(group, "__part").orderBy(*order)
    parts = with_neighbours(rows, [group], order, SCATTER_ROWS, 1).withColumn("__d", x - F.lag(x).over(w))
    last6 = w.rowsBetween(-(SCATTER_ROWS - 1), 0)
    scatter = F.when(F.count("__d").over(last6) == SCATTER_ROWS, F.stddev_samp("__d").over(last6))
    parts = parts.withColumns({"__same": F.coalesce(F.col("__d") == 0, F.lit(False)), "__scatter": scatter, "__next": F.lead("__d").over(w)})
    # A run of rows without change has the number of changes up to it, in its part and then in all parts before.
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    changes = {"__run": ~F.col("__same"), "__ref_run": ~F.coalesce(F.col("__same") & r, F.lit(False))}
    parts = parts.withColumns({c: F.sum((F.col("__own") & m).cast("long")).over(upto) for c, m in changes.items()})
    parts = parts.where("__own").withColumns({"__ad": F.when(r, F.abs("__d")), "__sx": F.when(r, x), "__rs": F.when(r, F.col("__scatter"))})
    rows = stored(parts.drop("__own"), "checks")
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(group, "__part").agg(*[F.max(c).alias(f"{c}_end") for c in changes])
    ends = ends.select(group, "__part", *[F.coalesce(F.sum(f"{c}_end").over(earlier), F.lit(0)).alias(f"{c}_from") for c in changes])
    rows = rows.join(stored(ends, "ends"), [group, "__part"]).withColumns({c: F.col(c) + F.col(f"{c}_from") for c in changes})
    lengths = lambda c, m: rows.where(m).groupBy(group, c).agg(F.count(F.lit(1)).alias("__length"))
    stats = rows.groupBy(group).agg(F.count("__sx").alias("__n"), F.count("__ad").alias("__nd"), F.count("__rs").alias("__ns"))
    shares = {"__lo": ("__sx", 0.001), "__hi": ("__sx", 0.999), "__dq": ("__ad", 0.999), "__sq": ("__rs", 0.99)}
    stats = stats.join(percentiles(rows, [group], shares), group)
    normal = percentiles(lengths("__ref_run", F.col("__same") & r), [group], {"__normal": ("__length", 0.999)})
    stats = stored(stats.join(normal, group, "left").na.fill(0.0, ["__normal"]), "stats")
    limit = F.greatest(F.lit(STALE_ROWS - 1.0), F.ceil(STALE_FACTOR * F.col("__normal")).cast("double"))
    # The row before a run, the first of its value, has the run's number.
    long = lengths("__run", F.col("__same")).join(stats, group).where(F.col("__length") >= limit).select(group, "__run", F.lit(True).alias("__long"))
    long = stored(long, "long")
    # Common values are counted for those of long runs only.
    asked = stored(rows.join(long, [group, "__run"]).select(group, value).distinct(), "asked")
    common = rows.where("__sx is not null").join(asked, [group, value], "left_semi").groupBy(group, value).agg(F.count(F.lit(1)).alias("__c")).join(stats, group)
    common = stored(common.where(F.col("__c") > COMMON_SHARE * F.col("__n")).select(group, value, F.lit(True).alias("__usual")), "common")
    rows = rows.join(stats, group).join(long, [group, "__run"], "left").join(common, [group, value], "left")
    enough = F.col("__n") >= LEAST_REFERENCE
    long, usual = F.coalesce("__long", F.lit(False)), F.coalesce("__usual", F.lit(False))
    spread = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-6))
    out = (x < F.col("__lo") - SPREADS * spread) | (x > F.col("__hi") + SPREADS * spread)
    if temperature:
        out = out | (x < TEMPERATURE_LIMITS[0]) | (x > TEMPERATURE_LIMITS[1])
    big = lambda d: F.coalesce((F.abs(d) > STEP_FACTOR * F.greatest("__dq", F.lit(1e-6))) & (F.col("__nd") > 100), F.lit(False))
    checked = rows.withColumns({
        "gap": x.isNull(), "stale": enough & long & ~usual, "out_of_range": enough & F.coalesce(out, F.lit(False)),
        "step": enough & (big("__d") | big("__next")),
        "erratic": enough & F.coalesce((F.col("__scatter") > SCATTER_FACTOR * F.greatest("__sq", F.lit(1e-6))) & (F.col("__ns") > 100), F.lit(False)),
    })
    checked = checked.drop(*[c for c in checked.columns if c.startswith("__")])
    return checked.withColumn("bad", F.col("gap") | F.col("stale") | F.col("out_of_range") | F.col("step") | F.col("erratic"))


def profile(rows: DataFrame, groups: list[str], order: list[str], value: str) -> DataFrame:
    """Counts per group: rows, missing, negative, far from the median (robust z above 10) and stuck (two before equal)."""
    w, x = Window.partitionBy(*groups, "__part").orderBy(*order), F.col(value)
    own = with_neighbours(rows.select(*{*groups, *order, value}), groups, order, 2)
    stuck = F.coalesce((x == F.lag(x, 1).over(w)) & (x == F.lag(x, 2).over(w)), F.lit(False))
    rows = stored(own.withColumn("__stuck", stuck).where("__own").select(*groups, value, "__stuck"), "stuck")
    rows = rows.join(stored(percentiles(rows, groups, {"__m": (value, 0.5)}), "median"), groups)
    rows = rows.withColumn("__a", F.abs(x - F.col("__m")))
    mad = stored(percentiles(rows, groups, {"__mad": ("__a", 0.5)}), "mad")
    far = F.coalesce(F.try_divide(0.6745 * F.col("__a"), F.col("__mad")) > 10, F.lit(False))
    return rows.join(mad, groups).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("missing"), F.count_if(x < 0).alias("negative"), F.count_if(far).alias("far"), F.count_if("__stuck").alias("stuck")
    )


def eligible_sensors(readings: DataFrame, groups: list[str], value: str = "value", most_missing: float = 0.2, least_spread: float = 1e-6) -> DataFrame:
    """Groups (case, sensor) with few gaps and some variation."""
    stats = readings.groupBy(*groups).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.stddev_pop(value).alias("spread"))
    return stats.where((F.col("missing") <= most_missing) & (F.col("spread") > least_spread))

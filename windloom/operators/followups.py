"""Smaller operators that complete the farm studies: high-pass, peaks, rankings, code maps, samples, assets, yield draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def high_passed(rows: DataFrame, groups: list[str], order: list[str], value: str, n: int = 6) -> DataFrame:
    """``value`` less its centred mean over n rows (of an even n one row more lies before), NULL without n values."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(-(n // 2), (n - 1) // 2)
    return rows.withColumn("high_pass", F.when(F.count(value).over(w) == n, F.col(value) - F.avg(value).over(w)))


def local_peaks(bins: DataFrame, order: str, value: str, low: float, high: float) -> DataFrame:
    """Bins between ``low`` and ``high`` whose value is the largest of itself and both neighbours and above the median of all
    of them (a few dozen bins)."""
    own = bins.where(F.col(value).isNotNull() & F.col(order).between(low, high))
    median = own.agg(F.median(value).alias("__m"))
    w = Window.orderBy(order).rowsBetween(-1, 1)
    return own.withColumn("__top", F.max(value).over(w)).join(F.broadcast(median)).where((F.col(value) >= F.col("__top")) & (F.col(value) > F.col("__m"))).drop("__top", "__m")


def largest_offsets(rows: DataFrame, group: str, angle: str, within: float = 45.0, k: int = 5) -> DataFrame:
    """The k groups with the largest absolute median of ``angle`` (rounded to 0.1), of angles below ``within``."""
    medians = rows.where(F.abs(angle) < within).groupBy(group).agg(F.round(F.median(angle), 1).alias("median_deg"))
    return medians.orderBy(F.desc(F.abs("median_deg")), group).limit(k)


def ranked_by_trust(rows: DataFrame, value: str, status: str, last: str = "inconclusive") -> DataFrame:
    """``position`` by falling value, rows of status ``last`` behind all others (ties: the turbine's id).  A few rows a farm."""
    w = Window.partitionBy("farm").orderBy((F.col(status) == last).cast("int"), F.desc(value), "turbine")
    return rows.withColumn("position", F.row_number().over(w))


def described_codes(events: DataFrame, codes: DataFrame, default: str = "unknown") -> DataFrame:
    """Events with the description and stopping flag of their alarm code; codes without an entry get the default and False."""
    known = codes.groupBy("code").agg(F.min_by(F.struct("description", "stopping"), "description").alias("__d"))
    out = events.join(known, "code", "left")
    return out.select(*events.columns, F.coalesce("__d.description", F.lit(default)).alias("description"), F.coalesce("__d.stopping", F.lit(False)).alias("stopping"))


def with_interventions(events: DataFrame, maintenance_codes: dict[str, list[int]], category: str = "iec_category") -> DataFrame:
    """``is_maintenance`` and ``is_forced_outage``: for the providers listed by their codes (they log no outages), for the
    others by category."""
    listed = F.col("provider").isin(list(maintenance_codes))
    by_code = F.lit(False)
    for provider, codes in maintenance_codes.items():
        by_code = by_code | ((F.col("provider") == provider) & F.col("code").isin(codes))
    scheduled, forced = F.col(category) == "Scheduled Maintenance", F.col(category) == "Forced outage"
    return events.withColumns({
        "is_maintenance": F.when(listed, by_code).otherwise(F.coalesce(scheduled, F.lit(False))),
        "is_forced_outage": F.when(listed, F.lit(False)).otherwise(F.coalesce(forced, F.lit(False))),
    })


def status_stats(events: DataFrame) -> DataFrame:
    """Per turbine: events, interventions, forced-outage hours, and when the last maintenance began."""
    hours = (F.col("end_s") - F.col("start_s")) / 3600
    m, f = F.col("is_maintenance"), F.col("is_forced_outage")
    return events.groupBy("turbine").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(m).alias("interventions"), F.coalesce(F.sum(F.when(f, hours)), F.lit(0.0)).alias("forced_outage_hours"),
        F.max(F.when(m, F.col("start_s"))).alias("last_maintenance_s"),
    )


def joined_signals(power: DataFrame, wind: DataFrame) -> DataFrame:
    """Power and wind tables of one station and time as one row: both must be there."""
    return power.join(wind, ["station", "ts"])


def farm_wind(hourly: DataFrame, least: int = 3) -> DataFrame:
    """Mean wind of the farm's turbines in hours in which ``least`` of them report."""
    return hourly.groupBy("hour").agg(F.avg("wind").alias("wind"), F.count("wind").alias("turbines")).where(F.col("turbines") >= least)


def correlations(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, by falling absolute value: one row a feature, from one aggregation."""
    sums = rows.agg(*[F.corr(c, target).alias(c) for c in features])
    out = sums.unpivot([], features, "feature", "r")
    w = Window.orderBy(F.desc(F.abs("r")), "feature")  # one row a feature
    return out.withColumn("position", F.row_number().over(w))


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, quartiles and extremes of each column, one row a column."""
    made = rows.agg(*[
        F.struct(
            F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("least"), F.percentile(c, 0.25).alias("p25"),
            F.percentile(c, 0.5).alias("p50"), F.percentile(c, 0.75).alias("p75"), F.max(c).cast("double").alias("most"),
        ).alias(c) for c in columns
    ])
    return made.unpivot([], columns, "column", "d").select("column", "d.*")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows whose key has the smallest hash with the seed: the same on any partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def padded_id(name: Column, prefix: str, width: int = 2) -> Column:
    """The last number of a name or file name with a prefix and leading zeros."""
    from windloom.functions.text import last_number

    return F.concat(F.lit(prefix), F.lpad(last_number(name).cast("string"), width, "0"))


def as_assets(rows: DataFrame, power: str, assets: Column) -> DataFrame:
    """``(time, asset_id, WTUR_W)`` of readings in kW."""
    return rows.select(F.col("ts").alias("time"), assets.alias("asset_id"), (F.col(power) * 1000).alias("WTUR_W"))


def asset_table(static: DataFrame) -> DataFrame:
    """``(asset_id, latitude, longitude, rated_power, hub_height, rotor_diameter, elevation, type)`` in the units of a yield
    study; turbines without a position are left out."""
    return static.where("latitude is not null and longitude is not null").select(
        F.col("turbine").alias("asset_id"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), (F.col("rated_power_kw").cast("double")).alias("rated_power"),
        F.col("hub_height_m").cast("double").alias("hub_height"), F.col("rotor_diameter_m").cast("double").alias("rotor_diameter"), F.coalesce(F.col("elevation_m").cast("double"), F.lit(0.0)).alias("elevation"), F.lit("turbine").alias("type"),
    )


def assembled_plant(sources: dict[str, DataFrame], needed: list[str]) -> DataFrame:
    """The plant's rows from its sources in order of preference: of each (time, asset) the first source's row that has all the
    ``needed`` channels."""
    rows = None
    for k, (name, df) in enumerate(sources.items()):
        own = df.na.drop(subset=needed).withColumns({"source": F.lit(name), "__k": F.lit(k)})
        rows = own if rows is None else rows.unionByName(own)
    others = [c for c in rows.columns if c not in ("time", "asset_id")]
    first = rows.groupBy("time", "asset_id").agg(F.min(F.struct("__k", *[c for c in others if c != "__k"])).alias("__r"))
    return first.select("time", "asset_id", "__r.*").drop("__k")


def scaled(rows: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Each column between 0 and 1 by its group's extremes (``_scaled``) and standardised (``_z``); constants: 0."""
    stats = rows.groupBy(*groups).agg(*[f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_pop))])
    out = rows.join(stats, groups)
    made = {}
    for c in columns:
        made[f"{c}_scaled"] = F.coalesce(F.try_divide((F.col(c) - F.col(f"__lo_{c}")).cast("double"), (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double")), F.lit(0.0))
        made[f"{c}_z"] = F.coalesce(F.try_divide((F.col(c) - F.col(f"__m_{c}")).cast("double"), F.col(f"__s_{c}")), F.lit(0.0))
    return out.withColumns(made).select(*rows.columns, *made)


def rank_aligned(positions: DataFrame, along: str, turbines: DataFrame, number: str) -> DataFrame:
    """Positions in order along a line met with turbines in order of their number: equal ranks belong together.  Both are a
    farm's layout (some dozens of rows)."""
    left = positions.withColumn("rank", F.row_number().over(Window.partitionBy("farm").orderBy(along)))
    right = turbines.withColumn("rank", F.row_number().over(Window.partitionBy("farm").orderBy(number)))
    return left.join(right, ["farm", "rank"])


#: Relative deviations of the yield's uncertainties (fixed values): meter, losses.
METER_ERROR, LOSS_ERROR = 0.005, 0.05


def uniform(draw: Column, what: str) -> Column:
    """A number in [0, 1) by the MD5 of draw and name: any engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", draw.cast("string"), F.lit(what)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def yield_draws(months: DataFrame, long_term: DataFrame, draws: int, meter: float = METER_ERROR, losses: float = LOSS_ERROR) -> DataFrame:
    """``(draw, aep)``: yearly energy by Monte Carlo.  Each draw resamples the ``months(month_no, energy, wind)`` (numbered from
    0), fits energy on wind by a straight line, applies it to the twelve ``long_term(month, wind)`` means, and scales by draws of
    the meter's and the losses' errors.  Draws meet the months by their numbers, an equi-join; months are a bounded calendar."""
    spark = months.sparkSession
    n = months.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    picks = spark.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(n))  # one row on the right
    picks = picks.withColumn("place", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("place").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    rows = picks.withColumn("month_no", pick).join(months, "month_no")
    lines = rows.groupBy("draw").agg(F.regr_slope("energy", "wind").alias("slope"), F.regr_intercept("energy", "wind").alias("intercept"))
    year = long_term.agg(F.sum("wind").alias("winds"), F.count(F.lit(1)).alias("months"))
    made = lines.where("slope is not null").crossJoin(F.broadcast(year))  # one row on the right
    scale = (1 + meter * (2 * uniform(F.col("draw"), "meter") - 1)) * (1 + losses * (2 * uniform(F.col("draw"), "losses") - 1))
    return made.select("draw", ((F.col("slope") * F.col("winds") + F.col("intercept") * F.col("months")) * scale).alias("aep"))


def yield_components(months: DataFrame, long_term: DataFrame, draws: int) -> DataFrame:
    """Deviation of the yield in percent with one uncertainty at a time: the regression's own, and what meter and losses add
    to it (root of the difference of variances), and the root of their sum of squares."""
    made = {"regression": (0.0, 0.0), "meter": (METER_ERROR, 0.0), "losses": (0.0, LOSS_ERROR)}
    parts = None
    for name, (m, l) in made.items():
        one = yield_draws(months, long_term, draws, m, l).agg((100 * F.stddev_samp("aep") / F.avg("aep")).alias("cv")).select(F.lit(name).alias("component"), "cv")
        parts = one if parts is None else parts.unionByName(one)
    base = parts.where("component = 'regression'").select(F.col("cv").alias("__b"))
    own = F.when(F.col("component") == "regression", F.col("cv")).otherwise(F.sqrt(F.greatest(F.col("cv") * F.col("cv") - F.col("__b") * F.col("__b"), F.lit(0.0))))
    out = parts.crossJoin(F.broadcast(base)).select("component", own.alias("pct"))
    return out.unionByName(out.agg(F.sqrt(F.sum(F.col("pct") * F.col("pct"))).alias("pct")).select(F.lit("total").alias("component"), "pct"))


def retrain_due(recent: Column, overall: Column, age_days: Column, worse: float = 1.25, old: int = 90) -> Column:
    """``retrain``, ``watch`` (worse, but not old) or ``keep``."""
    return F.when((recent > worse * overall) & (age_days > old), "retrain").when(recent > worse * overall, "watch").otherwise("keep")

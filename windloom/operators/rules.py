"""Diagnosis, ranking and recommendation built from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windloom.functions.wind import BETZ

#: Metrics that turbines are ranked by, and whether more is better (fixed values).
RANK_METRICS = {
    "capacity_factor": True,
    "peak_cp": True,
    "wake_loss_lt_pct": False,
    "abs_yaw_misalignment_deg": False,
    "qc_removed_share": False,
    "forced_outage_hours": False,
    "maintenance_events": False,
}


def anomaly(rows: DataFrame, kind: str, turbine, share, detail) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), turbine.cast("string").alias("turbine"), share.cast("double").alias("value"), detail.alias("detail"))


def diagnose(band: DataFrame, efficiency: DataFrame, neighbours: DataFrame, yaw: DataFrame | None = None, wind_check: DataFrame | None = None) -> DataFrame:
    """One table of typed anomalies: farm output out of band, instruments over the Betz limit (fleet-wide from 75 % of at
    least four turbines on), turbines under their neighbours for over 5 % of hours, flagged yaw offsets, and mismatch with
    the reference wind over 2 % of hours."""
    nothing = F.lit(None).cast("string")
    out = anomaly(band.where("share_bad > 0"), "output_out_of_band", nothing, F.col("share_bad"), F.concat(F.col("n_bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" hours")))
    fleet = efficiency.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("peak_cp") > BETZ).alias("over"))
    wide = (F.col("n") >= 4) & (F.col("over") >= 0.75 * F.col("n"))
    out = out.unionByName(anomaly(fleet.where(wide), "fleet_wide_wind_bias", nothing, F.col("over") / F.col("n"), F.format_string("%d of %d turbines", "over", "n")))
    single = efficiency.where(F.col("peak_cp") > BETZ).join(F.broadcast(fleet.withColumn("wide", wide).select("wide"))).where(~F.col("wide"))
    out = out.unionByName(anomaly(single, "anemometer_suspect", F.col("turbine"), F.col("peak_cp"), F.lit("power coefficient above the Betz limit")))
    out = out.unionByName(anomaly(neighbours.where("share > 0.05"), "under_neighbours", F.col("turbine"), F.col("share"), F.concat(F.col("under").cast("string"), F.lit(" times"))))
    if yaw is not None:
        out = out.unionByName(anomaly(yaw.where("status = 'flag'"), "static_yaw_offset", F.col("turbine"), F.col("mean_deg"), F.lit("confidence interval excludes zero")))
    if wind_check is not None:
        out = out.unionByName(anomaly(wind_check.where("share_over_5 > 0.02"), "reference_wind_mismatch", nothing, F.col("share_over_5"), F.lit("hours differing by over 5 m/s")))
    return out


def recommend(efficiency: DataFrame, noted: DataFrame) -> DataFrame:
    """The turbine with the lowest capacity factor, to twelve digits, among those without a note (ties: the smaller id)."""
    return efficiency.join(noted.select("turbine"), "turbine", "left_anti").orderBy(F.round("capacity_factor", 12), "turbine").limit(1)


def extremes(metrics: DataFrame, metric: str) -> DataFrame:
    """The best and the worst turbine by a metric."""
    own = metrics.where(F.col(metric).isNotNull())
    return own.agg(F.max(F.struct(metric, "turbine")).alias("b"), F.min(F.struct(metric, "turbine")).alias("w")).select(
        F.col("b.turbine").alias("best"), F.col(f"b.{metric}").alias("best_value"), F.col("w.turbine").alias("worst"), F.col(f"w.{metric}").alias("worst_value")
    )


def turbine_details(efficiency: DataFrame, *others: DataFrame) -> DataFrame:
    """Efficiency with yaw, wake and status columns of the same turbine where known."""
    out = efficiency
    for o in others:
        out = out.join(o, "turbine", "left")
    return out


def resolve_turbine(turbines: DataFrame, asked: DataFrame) -> DataFrame:
    """``(asked, turbine)``: by exact name, else by normalised name, else by the last number if only one turbine has it."""
    from windloom.functions.text import last_number, turbine_name

    t = turbines.select(F.col("turbine").cast("string").alias("turbine"))
    t = t.withColumns({"__name": turbine_name(F.col("turbine")), "__number": last_number(F.col("turbine"))})
    a = asked.select("asked").distinct().withColumns({"__name": turbine_name(F.col("asked")), "__number": last_number(F.col("asked"))})
    exact = a.join(t, a["asked"] == t["turbine"]).select("asked", F.lit(1).alias("way"), "turbine")
    name = a.join(t, "__name").select("asked", F.lit(2).alias("way"), "turbine")
    number = a.join(t, "__number").select("asked", F.lit(3).alias("way"), "turbine")
    ways = exact.unionByName(name).unionByName(number).groupBy("asked", "way").agg(F.min("turbine").alias("turbine"), F.count(F.lit(1)).alias("n"))
    best = ways.where("n = 1").groupBy("asked").agg(F.min(F.struct("way", "turbine")).alias("m")).select("asked", "m.turbine")
    return asked.join(best, "asked", "left").select("asked", "turbine")

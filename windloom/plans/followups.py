"""Queries of the follow-up operators, with DuckDB SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.functions import angles, text, wind
from windloom.operators import followups, forecasting, power_curve, resample, rules, sequence
from windloom.plans import forecasts, wake
from windloom.plans.relational import rounded, settled
from windloom.plans.views import RATED_KW, ROTOR_M, ctes, hourly, interval, layout, reading, signal
from windloom.session import nan_to_null, table
from windloom.sources import scada


def _hour_s():
    return F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)


def high_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = followups.high_passed(reading(spark, sf_dir), ["turbine"], ["ts", "event_id"], "value")
    return rounded(out.select("event_id", "high_pass"), high_pass=6)


def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = wake.wake_loss_by_direction(spark, sf_dir)
    return followups.local_peaks(bins.select("bin", "loss_pct"), "bin", "loss_pct", 0, 355)


def yaw_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).withColumn("yaw", (F.col("direction") - 180) / 4)
    return followups.largest_offsets(rows, "turbine", "yaw")


def yaw_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute yaw estimates of all turbines with their status, inconclusive ones last."""
    s = reading(spark, sf_dir).groupBy("turbine").agg(F.avg("direction").alias("m"), F.stddev_samp("direction").alias("s"), F.count("direction").alias("n"))
    m, half = (F.col("m") - 180) / 10, F.col("s") / 10 / F.sqrt("n")
    est = s.select("turbine", F.lit(0).alias("farm"), F.round(F.abs(m), 6).alias("abs_deg"), wind.yaw_status(m, m - half, m + half, F.col("s") / 10).alias("status"))
    return followups.ranked_by_trust(est, "abs_deg", "status").select("turbine", "abs_deg", "status", "position")


def alarm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"), (F.col("n_regionkey") < 2).alias("stopping"))
    events = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("code"))
    return followups.described_codes(events, codes)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interval(spark, sf_dir).withColumn("provider", F.when(F.col("turbine") % 3 == 0, "towie").otherwise("byte")).withColumn("code", F.col("event_id") % 10)
    category = F.when(F.col("message") == "purchase", "Scheduled Maintenance").when(F.col("message") == "error", "Forced outage").when(F.col("message") == "view", "Full Performance")
    return followups.with_interventions(rows.withColumn("iec_category", category), {"towie": [2, 7]})


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(followups.status_stats(_status(spark, sf_dir)), forced_outage_hours=6)


def turbine_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficiency with status and yaw figures of the same turbine where known, and the fleet's mean and rank."""
    eff = signal(spark, sf_dir).groupBy("turbine").agg((F.avg("power") / RATED_KW).alias("capacity_factor"))
    own = rules.turbine_details(eff, followups.status_stats(_status(spark, sf_dir)).select("turbine", "interventions"), yaw_ranking(spark, sf_dir).select("turbine", "status"))
    fleet = eff.agg(F.avg("capacity_factor").alias("fleet_mean"), F.count(F.lit(1)).alias("fleet_size"))
    above = settled(eff, capacity_factor=6).withColumn("position", F.rank().over(Window.orderBy(F.desc("capacity_factor")))).select("turbine", "position")
    out = own.join(F.broadcast(fleet)).join(above, "turbine")
    return settled(out.select("turbine", "capacity_factor", "fleet_mean", "fleet_size", "position", "interventions", "status"), capacity_factor=6, fleet_mean=6)


def signal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power and wind channels of one station and day, from separate tables."""
    rows = signal(spark, sf_dir).withColumn("station", F.col("turbine"))
    power = rows.where("l_partkey % 2 = 0").groupBy("station", "ts").agg(F.avg("power").alias("power"))
    winds = rows.where("l_partkey % 2 = 1").groupBy("station", "ts").agg(F.avg("wind").alias("wind"))
    out = followups.joined_signals(power, winds)
    return rounded(out.select("station", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "power", "wind"), power=5, wind=6)


def farm_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = followups.farm_wind(resample.turbine_hourly(reading(spark, sf_dir)))
    return rounded(out.withColumn("hour", F.unix_timestamp("hour")), wind=9)


def daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_timestamp(F.date_trunc("DAY", F.col("ts").cast("timestamp"))).alias("day")
    return rounded(reading(spark, sf_dir).groupBy("turbine", day).agg(F.avg("power").alias("power"), F.avg("wind").alias("wind")), power=5, wind=6)


def turbine_hourly_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).withColumn("wind", F.when(F.col("event_id") % 3 > 0, F.col("wind")))
    return rounded(resample.turbine_hourly(rows, both_channels=True), wind=6, power=5).withColumn("hour", F.unix_timestamp("hour"))


def park_meter_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped readings of the park, hourly mean, scaled from 42 turbines to 40; hours with under four readings are out."""
    rows = reading(spark, sf_dir).withColumn("p", wind.clip_low(F.col("power") - 500))
    out = rows.groupBy(_hour_s().alias("hour")).agg((F.avg("p") * 40 / 42 / 1000).alias("output_mw"), F.count("p").alias("n"))
    return rounded(out.where("n >= 4"), output_mw=8)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analysis run records: mean capacity factor, typed anomalies, the recommended turbine."""
    from windloom.plans.relational import recommended_turbine

    eff = signal(spark, sf_dir).groupBy("turbine").agg((F.avg("power") / RATED_KW).alias("cf"))
    found = wake.diagnosis(spark, sf_dir).agg(F.count(F.lit(1)).alias("anomalies"))
    best = recommended_turbine(spark, sf_dir).select(F.col("turbine").alias("recommended"))
    return rounded(eff.agg(F.avg("cf").alias("mean_capacity_factor")).join(found).join(best), mean_capacity_factor=6)


def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rounded(followups.correlations(rows, ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_linenumber"], "l_extendedprice"), r=6)


def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = followups.described(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(out, mean=6, std=6, p25=6, p50=6, p75=6)


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 8 000 readings by a seeded hash."""
    return followups.seeded_sample(reading(spark, sf_dir).select("event_id", "turbine", "value"), "event_id", 8000, 42)


def first_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir)
    first = F.when(F.col("event_type") == "view", F.col("wind"))
    return rows.select("event_id", F.coalesce(first, F.when(F.col("event_id") % 2 == 0, F.col("power"))).alias("speed"))


def id_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of turbines from names."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("exports/Turbine_"), F.col("c_custkey").cast("string"), F.lit("_2021.csv.gz")).alias("file"), F.concat(F.lit("SMV"), (F.col("c_custkey") % 12).cast("string")).alias("name"))
    return rows.select("c_custkey", F.concat(F.lit("T"), F.lpad(F.regexp_extract("file", r"_([0-9]+)_[0-9]{4}", 1), 4, "0")).alias("from_file"), followups.padded_id(F.col("name"), "WT").alias("from_name"), F.col("name").startswith("SMV").alias("known"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    static = s.select(
        followups.padded_id(F.col("s_suppkey").cast("string"), "T", 5).alias("turbine"), F.when(F.col("s_suppkey") % 9 > 0, F.col("s_acctbal") / 200).alias("latitude"), (F.col("s_nationkey") * 1.5).alias("longitude"),
        F.lit(RATED_KW).alias("rated_power_kw"), (70 + F.col("s_nationkey")).alias("hub_height_m"), F.lit(82).alias("rotor_diameter_m"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("elevation_m"),
    )
    return rounded(followups.asset_table(static), latitude=6)


def plant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plant rows of three sources: rows without the needed channels out, of each (time, asset) the first source's."""
    def own(flag: str) -> DataFrame:
        rows = signal(spark, sf_dir).where(F.col("l_partkey") % 3 == int(flag)).groupBy("ts", "turbine").agg(F.max("power").alias("power"), F.max("wind").alias("vane"))
        out = followups.as_assets(rows, "power", followups.padded_id(F.col("turbine").cast("string"), "T", 5))
        return out.join(rows.select(F.col("ts").alias("time"), followups.padded_id(F.col("turbine").cast("string"), "T", 5).alias("asset_id"), F.when(F.col("vane") > 5, F.col("vane")).alias("vane")), ["time", "asset_id"])

    out = followups.assembled_plant({"scada": own("0"), "historian": own("1"), "export": own("2")}, ["WTUR_W", "vane"])
    return rounded(out.withColumn("time", F.unix_timestamp(F.col("time").cast("timestamp"))), WTUR_W=3)


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(followups.scaled(rows, ["l_quantity"], ["l_suppkey"]), l_quantity_scaled=6, l_quantity_z=6)


def aligned_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveyed positions met with turbine numbers by their rank within each nation."""
    s = table(spark, sf_dir, "supplier")
    positions = s.select(F.col("s_nationkey").alias("farm"), F.col("s_acctbal").alias("along"))
    turbines = s.select(F.col("s_nationkey").alias("farm"), F.col("s_suppkey").alias("turbine"))
    return followups.rank_aligned(positions, "along", turbines, "turbine")


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("MONTH", F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").groupBy(F.unix_timestamp(month).alias("month")).agg((F.sum("o_totalprice") / 1e6).alias("energy"), (F.count(F.lit(1)) / 10 + F.avg("o_custkey") / 1000).alias("wind"))
    return rows.withColumn("month_no", F.row_number().over(Window.orderBy("month")) - 1)  # one row a month


def _long_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _months(spark, sf_dir).groupBy(F.month(F.timestamp_seconds("month")).alias("month")).agg(F.avg("wind").alias("wind"))


def yield_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = followups.yield_draws(_months(spark, sf_dir).select("month_no", "energy", "wind"), _long_term(spark, sf_dir), 500)
    return rounded(out, aep=4)


def yield_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = followups.yield_components(_months(spark, sf_dir).select("month_no", "energy", "wind"), _long_term(spark, sf_dir), 500)
    return rounded(out, pct=4)


def retrain_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("recent"), F.avg("o_totalprice").alias("overall"), F.count(F.lit(1)).alias("n"))
    return rows.select("o_custkey", followups.retrain_due(F.col("recent"), F.col("overall"), F.col("n") * 8).alias("decision"))


def safety_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).select("event_type", F.col("value").alias("actual"), (F.col("power") / 40).alias("predicted"))
    return rounded(forecasting.safety_margin(rows, ["event_type"], 30.0, 10.0), margin=6)


def episode_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.episodes(reading(spark, sf_dir), ["turbine"], ["ts", "event_id"], F.col("value") > 20, 2)
    return rounded(sequence.episode_rate(rows, ["turbine"], F.dayofmonth("ts") <= 15), base_rate=8)


def look_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecasting.look_back(hourly(spark, sf_dir), "h", "output", 72)
    mean = F.aggregate("history", F.lit(0.0), lambda s, v: s + v) / 72
    return rounded(out.where("history is not null").select("h", mean.alias("mean"), F.col("history")[0].alias("oldest"), F.col("history")[71].alias("newest")), mean=8, oldest=8, newest=8)


def air_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind rows with the air density of their hour, where the weather has it."""
    rows = reading(spark, sf_dir).withColumn("hour", _hour_s())
    weather = rows.where("event_type = 'view'").groupBy("hour").agg((F.avg("value") / 5).alias("temperature_c"), (1000 + F.avg("wind")).alias("pressure_hpa"))
    return rounded(resample.air_density_on(rows.select("event_id", "hour"), weather), density=8)


def local_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (50 + F.col("s_acctbal") / 1e5).alias("lat"), (F.col("s_nationkey") / 100).alias("lon"))
    centre = rows.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    x, y = angles.local_metres(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return rounded(rows.join(F.broadcast(centre)).select("s_suppkey", x.alias("x"), y.alias("y")), x=4, y=4)


def model_output_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of answers with reasoning tags, fences and chatter around them."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<thinking>maybe {1}</thinking>Sure:\n```json\n{\"size\": "), F.col("p_size").cast("string"), F.lit(", \"name\": \""), F.col("p_type"), F.lit("\"}\n```")).alias("answer"))
    clean = text.without_reasoning(F.col("answer"))
    return rows.select("p_partkey", text.embedded_json(clean, "size int, name string").alias("j")).select("p_partkey", "j.size", "j.name")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text a row; NaN is left out."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, float("nan")).otherwise(F.col("p_size").cast("double")).alias("size"))
    return scada.to_json_rows(rows.select("p_partkey", "size"))


def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windloom.operators.watch import base_name, finite_round

    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("_avg")).alias("sensor"), F.when(F.col("p_partkey") % 3 == 0, float("inf")).when(F.col("p_partkey") % 5 == 0, float("nan")).otherwise(F.col("p_retailprice") / 7).alias("v"))
    return rows.select("p_partkey", base_name(F.col("sensor")).alias("sensor"), finite_round(F.col("v"), 3).alias("v"))


def as_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as exact decimals, for sinks that refuse floats."""
    rows = nan_to_null(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 8).alias("v")))
    return rows.select("p_partkey", F.col("v").cast("decimal(38,6)").cast("string").alias("v"))


def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windloom.operators.retrieval import cited_pages as cited

    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("See p. "), (F.col("p_size") % 7).cast("string"), F.lit(" and p."), (F.col("p_partkey") % 5).cast("string"), F.lit(", again p."), (F.col("p_size") % 7).cast("string")).alias("answer"))
    return cited(rows).select("p_partkey", F.concat_ws(",", F.transform("cited", lambda x: x.cast("string"))).alias("cited"))


def plant_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of plant data as one table, the first source's row of a (time, asset) kept."""
    rows = table(spark, sf_dir, "orders").select(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"), (F.col("o_custkey") % 10).alias("asset_id"), "o_totalprice")
    return scada.plant_scada(rows.where("o_orderkey % 2 = 0"), rows)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = rows.where("o_custkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0))
    return scada.upsert(rows, new, ["o_orderkey"])


def ten_minute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a control log to ten-minute means with two readings or more, directions as vector means."""
    rows = reading(spark, sf_dir).select(F.lit(1).alias("turbine"), "ts", "wind", "power", "direction", "event_id")
    control = rows.where("event_id % 2 = 0").select("turbine", "ts", F.lit(0.5).alias("derate")).distinct()
    out = scada.minute_to_ten(rows.drop("event_id"), control, 2)
    return rounded(out.withColumn("slot", F.unix_timestamp("slot")), wind=6, power=5, derate=6, direction=3)


def full_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed anomalies with flagged yaw offsets and the mismatch with the reference wind."""
    yaw = yaw_ranking(spark, sf_dir).select("turbine", "status", F.col("abs_deg").alias("mean_deg"))
    check = power_curve.compare_wind(_wind_pairs(spark, sf_dir))
    own = power_curve.efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M)
    band, under = forecasts.out_of_band(spark, sf_dir), wake.neighbour_underperformance(spark, sf_dir)
    return rounded(rules.diagnose(band, own, under, yaw, check).select("type", "turbine", "value"), value=6)


def _wind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading(spark, sf_dir).groupBy(_hour_s().alias("hour")).agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))


def farms_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farms registered (nations) for which no model was trained (no customer of the automobile segment), with the name of it."""
    farms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("farm"), F.concat(F.lit("output-"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("model"))
    trained = table(spark, sf_dir, "customer").where("c_mktsegment = 'AUTOMOBILE' and c_acctbal > 5000").select(F.col("c_nationkey").alias("farm"))
    return farms.join(trained, "farm", "left_anti")


_NAMES = (
    full_diagnosis, farms_without_model, high_passed, local_peaks, yaw_offsets, yaw_ranking, alarm_codes, interventions, turbine_details, signal_join, farm_wind, daily_means, turbine_hourly_both, park_meter_hourly,
    run_summary, feature_correlations, described_columns, seeded_sample, first_channel, id_formats, assets, plant_rows, scaled_features, aligned_ranks, yield_draws,
    yield_components, retrain_decisions, safety_margins, episode_rates, look_backs, air_densities, local_offsets, model_output_json, json_rows, finite_values, as_decimals,
    cited_pages, plant_years, upserted, ten_minute_rows,
)
QUERIES = {f.__name__: f for f in _NAMES}

_STATUS = """st as (select *, turbine % 3 = 0 as listed, event_id % 10 as code, message = 'purchase' as sm, message = 'error' as fo from v_interval),
si as (select *, case when listed then code in (2, 7) else sm end as m, case when listed then false else fo end as f from st)"""
_YAW = """ye as (select turbine, avg(direction) as a, stddev_samp(direction) as s, count(direction) as n from v_reading group by 1),
y2 as (select turbine, (a - 180) / 10 as m, s / 10 / sqrt(n) as h, s / 10 as sp from ye),
y3 as (select turbine, round(abs(m), 6) as abs_deg, case when m is null or h is null or sp > 10 then 'inconclusive' when abs(m) >= 3 and (m - h > 0 or m + h < 0) then 'flag' else 'ok' end as status from y2),
yr as (select *, row_number() over (order by (status = 'inconclusive')::int, abs_deg desc, turbine) as position from y3)"""
_MONTHS = """mo as (select epoch(date_trunc('month', o_orderdate))::bigint as month, sum(o_totalprice) / 1e6::double as energy, count(*) / 10::double + avg(o_custkey) / 1000 as wind from orders group by 1),
mn as (select *, row_number() over (order by month) - 1 as month_no from mo), lt as (select avg(wind) as wind from mo group by extract(month from make_timestamp(month * 1000000))),
yy as (select sum(wind) as winds, count(*) as months from lt),
ln_ as (select d as draw, regr_slope(energy, wind) as slope, regr_intercept(energy, wind) as icept from generate_series(0, 499) g(d), generate_series(0, (select count(*) - 1 from mn)) h(p) join mn on month_no = ('0x' || substr(md5(d || ':' || p), 1, 8))::bigint % (select count(*) from mn) group by 1)"""
_DRAW = "(slope * winds + icept * months) * (1 + %s::double * (2 * (('0x' || substr(md5(draw || ':meter'), 1, 8))::bigint / 4294967296::double) - 1)) * (1 + %s::double * (2 * (('0x' || substr(md5(draw || ':losses'), 1, 8))::bigint / 4294967296::double) - 1))"
_PLANT = "select ts, turbine, max(power) as power, max(wind) as vane, l_partkey % 3 as k from v_signal group by ts, turbine, l_partkey % 3"
_Z = NormalDist().inv_cdf(0.75)

ORACLES = {
    "full_diagnosis": f"""{ctes('v_signal', 'v_reading')}, {_YAW}, {wake._EFF}, fl as (select count(*) as n, count_if(peak_cp > 16::double / 27) as over_n from eff),
h as (select floor(epoch(date_trunc('second', ts)) / 3600)::bigint as hour, avg(value) filter (event_type = 'view') as a, avg(value) filter (event_type = 'click') as b from v_reading group by 1), m as (select avg((abs(a - b) > 5)::int::double) as s from h where a is not null and b is not null)
select 'fleet_wide_wind_bias' as type, null as turbine, round(over_n / n, 6) as value from fl where n >= 4 and over_n >= 0.75 * n
union all select 'anemometer_suspect', turbine::varchar, round(peak_cp, 6) from eff, fl where peak_cp > 16::double / 27 and not (n >= 4 and over_n >= 0.75 * n)
union all select 'static_yaw_offset', turbine::varchar, abs_deg from yr where status = 'flag' union all select 'reference_wind_mismatch', null, round(s, 6) from m where s > 0.02
union all select 'output_out_of_band', null, share_bad from ({forecasts.ORACLES["out_of_band"]}) where share_bad > 0
union all select 'under_neighbours', turbine::varchar, round(share, 6) from ({wake.ORACLES["neighbour_underperformance"]}) where share > 0.05""",
    "farms_without_model": "select n_nationkey as farm, 'output-' || lower(replace(n_name, ' ', '-')) as model from nation where n_nationkey not in (select c_nationkey from customer where c_mktsegment = 'AUTOMOBILE' and c_acctbal > 5000)",
    "high_passed": f"{ctes('v_reading')} select event_id, round(case when count(value) over w = 6 then value - avg(value) over w end, 6) as high_pass from v_reading window w as (partition by turbine order by ts, event_id rows between 3 preceding and 2 following)",
    "local_peaks": wake.ORACLES["wake_loss_by_direction"].replace("select * from dr", ", pk as (select bin, loss_pct, max(loss_pct) over (order by bin rows between 1 preceding and 1 following) as top, median(loss_pct) over () as m from dr where loss_pct is not null) select bin, loss_pct from pk where loss_pct >= top and loss_pct > m"),
    "yaw_offsets": f"{ctes('v_reading')} select turbine, round(median((direction - 180) / 4), 1) as median_deg from v_reading where abs((direction - 180) / 4) < 45 group by 1 order by abs(median_deg) desc, turbine limit 5",
    "yaw_ranking": f"{ctes('v_reading')}, {_YAW} select * from yr",
    "alarm_codes": "select c_custkey as event_id, c_nationkey as code, coalesce(n_name, 'unknown') as description, coalesce(n_regionkey < 2, false) as stopping from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 20",
    "interventions": f"{ctes('v_interval')}, {_STATUS} select turbine, count(*) as events, count_if(m) as interventions, round(coalesce(sum((end_s - start_s) / 3600) filter (f), 0), 6) as forced_outage_hours, max(start_s) filter (m) as last_maintenance_s from si group by 1",
    "turbine_details": f"""{ctes('v_signal', 'v_interval', 'v_reading')}, {_STATUS}, {_YAW}, ef as (select turbine, avg(power) / {RATED_KW}::double as cf from v_signal group by 1), iv as (select turbine, count_if(m) as interventions from si group by 1)
select ef.turbine, round(cf, 6) as capacity_factor, round(avg(cf) over (), 6) as fleet_mean, count(*) over () as fleet_size, rank() over (order by round(cf, 6) desc) as position, interventions, status from ef left join iv on iv.turbine = ef.turbine left join yr on yr.turbine = ef.turbine""",
    "signal_join": f"{ctes('v_signal')}, p as (select turbine as station, ts, avg(power) as power from v_signal where l_partkey % 2 = 0 group by 1, 2), w as (select turbine as station, ts, avg(wind) as wind from v_signal where l_partkey % 2 = 1 group by 1, 2) select station, epoch(ts)::bigint as ts, round(power, 5) as power, round(wind, 6) as wind from p join w using (station, ts)",
    "farm_wind": f"{ctes('v_reading')}, h as (select turbine, date_trunc('hour', ts) as hour, avg(wind) as wind from v_reading group by 1, 2) select epoch(hour)::bigint as hour, round(avg(wind), 9) as wind, count(wind) as turbines from h group by 1 having count(wind) >= 3",
    "daily_means": f"{ctes('v_reading')} select turbine, epoch(date_trunc('day', ts))::bigint as day, round(avg(power), 5) as power, round(avg(wind), 6) as wind from v_reading group by 1, 2",
    "turbine_hourly_both": f"{ctes('v_reading')} select turbine, epoch(date_trunc('hour', ts))::bigint as hour, round(avg(wind), 6) as wind, round(avg(power), 5) as power, count(*) as n from v_reading where event_id % 3 > 0 and wind is not null and power is not null group by 1, 2",
    "park_meter_hourly": f"{ctes('v_reading')} select floor(epoch(date_trunc('second', ts)) / 3600)::bigint as hour, round(avg(greatest(power - 500, 0)) * 40 / 42 / 1000, 8) as output_mw, count(power) as n from v_reading group by 1 having count(power) >= 4",
    "run_summary": wake.ORACLES["diagnosis"].replace("select 'output_out_of_band'", ", an as (select 'output_out_of_band'", 1) + f") select round((select avg(a) from (select avg(power) / {RATED_KW}::double as a from v_signal group by turbine)), 6) as mean_capacity_factor, (select count(*) from an) as anomalies, (select turbine from eff where turbine not in (select s_suppkey from supplier where s_acctbal < 1000) order by capacity_factor, turbine limit 1) as recommended",
    "feature_correlations": "with c as (" + " union all ".join(f"select '{c}' as feature, round(corr({c}, l_extendedprice), 6) as r from lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_partkey", "l_linenumber")) + ") select feature, r, row_number() over (order by abs(r) desc, feature) as position from c",
    "described_columns": " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c})::double as least, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75, max({c})::double as most from lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "seeded_sample": "select event_id, user_id as turbine, value from events order by md5(event_id || ':42'), event_id limit 8000",
    "first_channel": f"{ctes('v_reading')} select event_id, coalesce(case when event_type = 'view' then wind end, case when event_id % 2 = 0 then power end) as speed from v_reading",
    "id_formats": "select c_custkey, 'T' || case when length(c_custkey::varchar) >= 4 then left(c_custkey::varchar, 4) else lpad(c_custkey::varchar, 4, '0') end as from_file, 'WT' || lpad((c_custkey % 12)::varchar, 2, '0') as from_name, true as known from customer",
    "assets": f"select 'T' || lpad(s_suppkey::varchar, 5, '0') as asset_id, round(s_acctbal / 200, 6) as latitude, s_nationkey * 1.5::double as longitude, {RATED_KW}::double as rated_power, (70 + s_nationkey)::double as hub_height, 82::double as rotor_diameter, coalesce(case when s_suppkey % 2 = 0 then s_suppkey end, 0)::double as elevation, 'turbine' as type from supplier where s_suppkey % 9 > 0",
    "plant_rows": f"{ctes('v_signal')}, p as ({_PLANT}), r as (select *, row_number() over (partition by ts, turbine order by k) as n from p where power is not null and vane > 5) select epoch(ts)::bigint as time, 'T' || lpad(turbine::varchar, 5, '0') as asset_id, round(power * 1000, 3) as WTUR_W, vane, case k when 0 then 'scada' when 1 then 'historian' else 'export' end as source from r where n = 1",
    "scaled_features": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(coalesce((l_quantity - min(l_quantity) over w) / nullif(max(l_quantity) over w - min(l_quantity) over w, 0), 0), 6) as l_quantity_scaled, round(coalesce((l_quantity - avg(l_quantity) over w) / nullif(stddev_pop(l_quantity) over w, 0), 0), 6) as l_quantity_z from lineitem window w as (partition by l_suppkey)",
    "aligned_ranks": "with p as (select s_nationkey as farm, s_acctbal as along, row_number() over (partition by s_nationkey order by s_acctbal) as rank from supplier), t as (select s_nationkey as farm, s_suppkey as turbine, row_number() over (partition by s_nationkey order by s_suppkey) as rank from supplier) select farm, rank, along, turbine from p join t using (farm, rank)",
    "yield_draws": f"with {_MONTHS} select draw, round({_DRAW % (0.005, 0.05)}, 4) as aep from ln_, yy",
    "yield_components": f"""with {_MONTHS}, c as (select {', '.join(f"100 * stddev_samp({_DRAW % (m, l)}) / avg({_DRAW % (m, l)}) as {n}" for n, m, l in (('r', 0, 0), ('m', 0.005, 0), ('l', 0, 0.05)))} from ln_, yy),
p as (select 'regression' as component, r as pct from c union all select 'meter', sqrt(greatest(m * m - r * r, 0)) from c union all select 'losses', sqrt(greatest(l * l - r * r, 0)) from c) select component, round(pct, 4) as pct from p union all select 'total', round(sqrt(sum(pct * pct)), 4) from p""",
    "retrain_decisions": "with r as (select o_custkey, avg(o_totalprice) filter (o_orderkey % 2 = 0) as recent, avg(o_totalprice) as overall, count(*) * 8 as age from orders group by 1) select o_custkey, case when recent > 1.25 * overall and age > 90 then 'retrain' when recent > 1.25 * overall then 'watch' else 'keep' end as decision from r",
    "safety_margins": f"{ctes('v_reading')} select event_type, round({_Z!r}::double * stddev_samp(value - power / 40), 6) as margin from v_reading group by 1",
    "episode_rates": f"""{ctes('v_reading')}, a as (select *, value > 20 as m, row_number() over w as i from v_reading window w as (partition by turbine order by ts, event_id)), b as (select *, sum((not m)::int) over (partition by turbine order by i) as g from a),
c as (select *, m and count(*) over (partition by turbine, g, m) >= 2 as ep from b), d as (select *, ep and not coalesce(lag(ep) over (partition by turbine order by i), false) as st from c) select turbine, round((count_if(st) + 0.5::double) / count(*), 8) as base_rate from d where day(ts) <= 15 group by 1""",
    "look_backs": f"{ctes('v_hourly')}, l as (select h, list(output) over (order by h rows between 71 preceding and current row) as x from v_hourly) select h, round(list_avg(x), 8) as mean, round(x[1], 8) as oldest, round(x[72], 8) as newest from l where len(x) = 72",
    "air_densities": f"{ctes('v_reading')}, r as (select *, floor(epoch(date_trunc('second', ts)) / 3600)::bigint as hour from v_reading), w as (select hour, avg(value) / 5 as t, 1000 + avg(wind) as p from r where event_type = 'view' group by 1) select event_id, hour, round(p * 100 / (287.05::double * (t + 273.15::double)), 8) as density from r left join w using (hour)",
    "local_offsets": "with r as (select s_suppkey, 50 + s_acctbal / 1e5::double as lat, s_nationkey / 100 as lon from supplier), c as (select avg(lat) as lat0, avg(lon) as lon0 from r) select s_suppkey, round((lon - lon0) * 111320 * cos(radians(lat0)), 4) as x, round((lat - lat0) * 110574, 4) as y from r, c",
    "model_output_json": "select p_partkey, p_size::int as size, p_type as name from part",
    "json_rows": "select case when p_partkey % 3 = 0 then '{\"p_partkey\":' || p_partkey || '}' else '{\"p_partkey\":' || p_partkey || ',\"size\":' || p_size::int || '.0}' end as json from part",
    "finite_values": "select p_partkey, p_type as sensor, case when p_partkey % 3 > 0 and p_partkey % 5 > 0 then round(p_retailprice / 7, 3) end as v from part",
    "as_decimals": "select p_partkey, (p_retailprice / 8)::decimal(38,6)::varchar as v from part",
    "cited_pages": "select p_partkey, array_to_string(list_sort(list_distinct([p_size % 7, p_partkey % 5])), ',') as cited from part",
    "plant_years": "with r as (select epoch(o_orderdate)::bigint as time, o_custkey % 10 as asset_id, o_totalprice, (o_orderkey % 2)::int as k from orders), u as (select *, 0 as s from r where k = 0 union all select *, 1 from r) select time, asset_id, o_totalprice from (select *, row_number() over (partition by time, asset_id order by s, o_totalprice) as n from u) where n = 1",
    "upserted": "select o_orderkey, o_custkey, case when o_custkey % 3 = 0 then 0 else o_totalprice end as o_totalprice from orders",
    "ten_minute_rows": f"""{ctes('v_reading')}, c as (select distinct ts, 0.5::double as derate from v_reading where event_id % 2 = 0), j as (select v_reading.*, derate from v_reading left join c using (ts)),
g as (select time_bucket(interval 10 minute, ts) as slot, avg(wind) as wind, avg(power) as power, avg(sin(radians(direction))) as s, avg(cos(radians(direction))) as c, avg(derate) as derate, count(*) as n from j group by 1 having count(*) >= 2)
select 1 as turbine, epoch(slot)::bigint as slot, round(wind, 6) as wind, round(power, 5) as power, round(fmod(degrees(atan2(s, c)) + 360, 360), 3) as direction, round(derate, 6) as derate, n from g""",
}

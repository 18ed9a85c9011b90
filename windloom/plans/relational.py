"""Resampling, power curves, efficiency, resource and reshaping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.angles import components, yaw_loss
from windloom.functions.wind import available_power_kw, day_ahead_price, reanalysis_miss
from windloom.operators import power_curve, records, resample, rules
from windloom.plans.views import RATED_KW, ROTOR_M, ctes, hourly, reading, signal
from windloom.session import table


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def settled(df: DataFrame, **digits: int) -> DataFrame:
    """``rounded`` for means of many rows: to twelve digits first, so that a mean that ends in a 5 goes up in any order of summing."""
    return rounded(rounded(df, **dict.fromkeys(digits, 12)), **digits)


def power_curve_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = power_curve.binned_curve(signal(spark, sf_dir), ["turbine"])
    return rounded(out, mean_power=8)


def turbine_hourly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.turbine_hourly(reading(spark, sf_dir)), wind=6, power=5).withColumn("hour", F.unix_timestamp("hour"))


def farm_hourly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.farm_hourly(reading(spark, sf_dir), 150, least=5, scale="mean")
    return rounded(out, output_mw=6).withColumn("hour", F.unix_timestamp("hour"))


def farm_hourly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.farm_hourly(reading(spark, sf_dir), 150, least=1, scale="sum", clip_first=True)
    return rounded(out, output_mw=6).withColumn("hour", F.unix_timestamp("hour"))


def efficiency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = power_curve.efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M)
    return rounded(settled(out, capacity_factor=6), peak_cp=6, betz_limit=6)


def turbine_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = power_curve.efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M)
    out = settled(out.select("turbine", "capacity_factor"), capacity_factor=6)
    return power_curve.ranked(out, "capacity_factor")


def recommended_turbine(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = power_curve.efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M)
    noted = table(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("turbine"))
    return settled(rules.recommend(own.select("turbine", "capacity_factor"), noted), capacity_factor=6)


def wind_rose_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power_curve.wind_rose(reading(spark, sf_dir)), energy=2)


def prevailing_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power_curve.prevailing(reading(spark, sf_dir), ["event_type"]), prevailing=5, share_within_30=6)


def speed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power_curve.speed_histogram(signal(spark, sf_dir)), density=8)


def output_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power_curve.output_share(signal(spark, sf_dir), RATED_KW), share=6)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).where(F.col("event_type").isin("view", "click")).withColumn("hour", F.date_trunc("HOUR", F.col("ts").cast("timestamp")))
    return rows.groupBy("hour").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))


def scada_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power_curve.compare_wind(_pairs(spark, sf_dir)), r=6, mean_abs_diff=6, share_over_5=6)


def linear_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windloom.operators.forecasting import calibration

    return rounded(calibration(_pairs(spark, sf_dir), [], "b", "a"), slope=6, intercept=5, r2=6)


def correlate_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = power_curve.correlate_predict(7.5, reading(spark, sf_dir).select("event_id", "wind"))
    return rounded(out, wind=6, ratio=6, predicted=6)


def production_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.peaks(reading(spark, sf_dir)).withColumn("farm_at", F.unix_micros(F.col("farm_at").cast("timestamp"))), farm_kw=4, turbine_kw=4)


def production_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.periods(reading(spark, sf_dir), "DAY", 1)
    return rounded(out.withColumn("start", F.unix_timestamp("start")), mwh=6, coverage=6)


def best_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.best_period(reading(spark, sf_dir), "DAY", 1, 0.5)
    return rounded(out.withColumn("start", F.unix_timestamp("start")), mwh=6, coverage=6)


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).withColumn("output", F.when(F.pmod(F.col("h"), F.lit(23)) >= 9, F.col("output")))
    return rounded(resample.fill_gaps(resample.on_spine(h, "h"), "h", "output", 6), output=6, output_filled=6)


def spine_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).where("event_type = 'error'")
    h = rows.groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return resample.on_spine(h, "h")


def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).where("event_type = 'purchase' and value > 60")
    return resample.missing_hours(rows.select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h")).distinct(), "h")


def counter_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.counter_increments(hourly(spark, sf_dir), "h", "output", 20.0)
    return rounded(out, output=6, increment=6)


def unpivot_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"], "channel", "value")


def pivot_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return rounded(rows, A=6, N=6, R=6)


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather, price and production joined by hour, with features; mismatched rows are rejected."""
    h = F.date_trunc("HOUR", F.col("ts").cast("timestamp"))
    rows = reading(spark, sf_dir).withColumn("hour", h)
    weather = rows.where("event_type = 'view'").groupBy("hour").agg(F.avg("wind").alias("wind"))
    output = rows.where("event_type = 'click'").groupBy("hour").agg(F.avg("power").alias("output"))
    price = weather.select("hour", day_ahead_price(F.col("hour")).alias("price"))
    out = weather.join(price, "hour").join(output, "hour").na.drop(subset=["wind", "output"])
    out = out.where(~reanalysis_miss(F.col("wind"), F.col("output"), RATED_KW))
    out = out.withColumns({"wind_cubed": F.pow("wind", F.lit(3.0)), "hour_of_day": F.hour("hour"), "available_kw": available_power_kw(F.col("wind"), ROTOR_M)})
    return rounded(out.withColumn("hour", F.unix_timestamp("hour")), wind=6, output=5, wind_cubed=4, available_kw=4)


def wind_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = components(F.col("wind"), F.col("direction"))
    out = reading(spark, sf_dir).select("event_id", u.alias("u"), v.alias("v"), yaw_loss(F.col("direction") / 20).alias("yaw_loss"))
    return rounded(out, u=6, v=6, yaw_loss=6).withColumns({"u": F.col("u") + F.lit(0.0), "v": F.col("v") + F.lit(0.0)})


def full_outer_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbine sums and grid sums by day, full outer: days that only one of them has stay."""
    rows = reading(spark, sf_dir).withColumn("day", F.date_trunc("DAY", F.col("ts").cast("timestamp")))
    a = rows.where("event_type = 'signup' and value > 150").groupBy("day").agg(F.sum("value").alias("turbine_sum"))
    b = rows.where("event_type = 'error' and value > 150").groupBy("day").agg(F.sum("value").alias("grid_sum"))
    return rounded(a.join(b, "day", "full").withColumn("day", F.unix_timestamp("day")), turbine_sum=4, grid_sum=4)


def weibull_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power_curve.weibull_fit(signal(spark, sf_dir), ["turbine"])


def kernel_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(power_curve.kernel_curve(signal(spark, sf_dir), ["turbine"]), power=5)


def curve_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir)
    return power_curve.curve_displacement(rows, power_curve.binned_curve(rows, []))


_NAMES = (
    power_curve_binned, turbine_hourly_mean, farm_hourly_coverage, farm_hourly_sum, efficiency_summary, turbine_rank, recommended_turbine, wind_rose_energy,
    prevailing_direction, speed_histogram, output_share, scada_vs_reference, linear_calibration, correlate_predict, production_records, production_periods, best_day,
    gap_fill, spine_left_join, missing_hours, counter_increments, unpivot_channels, pivot_sources, feature_frame, wind_components, full_outer_meter,
    weibull_fit, kernel_curve, curve_displacement,
)
QUERIES = {f.__name__: f for f in _NAMES}

_BIN = "case when wind = 0 then 0.25 when wind > 0 and wind <= 20 then ceil(wind / 0.5) * 0.5 - 0.25 when wind > 20 and wind <= 28 then 20 + ceil((wind - 20) / 2) * 2 - 1 end"
_EFFICIENCY = f"""eff as (select turbine, avg(power) / {RATED_KW} as capacity_factor,
  quantile_cont(case when wind >= 3 then power / (0.5::double * 1.225::double * (3.141592653589793::double * {ROTOR_M / 2}::double ** 2) * wind ** 3 / 1000) end, 0.95) as peak_cp, count(*) as hours from v_signal group by 1)"""
_HOURLY = "hm as (select turbine, epoch(date_trunc('hour', ts))::bigint as hour, avg(wind) as wind, avg(power) as power, count(*) as n from v_reading group by 1, 2)"
_PAIR = "v_pair as (select date_trunc('hour', ts) as hour, avg(value) filter (event_type = 'view') as a, avg(value) filter (event_type = 'click') as b from v_reading where event_type in ('view', 'click') group by 1)"

ORACLES = {
    "power_curve_binned": f"{ctes('v_signal')}, b as (select turbine, ({_BIN})::double as wind_bin, power from v_signal) select turbine, wind_bin, round(avg(power), 8) as mean_power, count(power) as n from b where wind_bin is not null group by 1, 2",
    "turbine_hourly_mean": f"{ctes('v_reading')}, {_HOURLY} select turbine, hour, round(wind, 6) as wind, round(power, 5) as power, n from hm",
    "farm_hourly_coverage": f"{ctes('v_reading')}, {_HOURLY} select hour, count(power) as reporting, round(greatest(avg(power) * 150, 0) / 1000, 6) as output_mw from hm group by 1 having count(power) >= 5",
    "farm_hourly_sum": f"{ctes('v_reading')}, {_HOURLY} select hour, count(power) as reporting, round(greatest(sum(power), 0) / 1000, 6) as output_mw from hm group by 1 having count(power) >= 1",
    "efficiency_summary": f"{ctes('v_signal')}, {_EFFICIENCY} select turbine, round(capacity_factor, 6) as capacity_factor, round(peak_cp, 6) as peak_cp, hours, round(16::double / 27, 6) as betz_limit, coalesce(peak_cp > 16::double / 27, false) as over_betz from eff",
    "turbine_rank": f"{ctes('v_signal')}, {_EFFICIENCY}, c as (select turbine, round(capacity_factor, 6) as capacity_factor from eff) select turbine, capacity_factor, rank() over (order by capacity_factor desc) as position from c",
    "recommended_turbine": f"{ctes('v_signal')}, {_EFFICIENCY} select turbine, round(capacity_factor, 6) as capacity_factor from eff where turbine not in (select s_suppkey from supplier where s_acctbal < 1000) order by eff.capacity_factor, turbine limit 1",
    "wind_rose_energy": f"{ctes('v_reading')}, e as (select floor(fmod(direction + 11.25::double, 360) / 22.5::double)::int as sector, sum(power) as e from v_reading where direction is not null group by 1) select s::int as sector, s * 22.5::double as direction, round(coalesce(e, 0), 2) as energy from generate_series(0, 15) g(s) left join e on e.sector = s",
    "prevailing_direction": f"""{ctes('v_reading')}, m as (select event_type, fmod(degrees(atan2(avg(sin(radians(direction))), avg(cos(radians(direction))))) + 360, 360) as p from v_reading where direction is not null group by 1)
select event_type, round(p, 5) as prevailing, round(avg((abs(fmod(direction - p + 540, 360) - 180) <= 30)::int::double), 6) as share_within_30, count(*) as n from v_reading join m using (event_type) where direction is not null group by event_type, p""",
    "speed_histogram": f"{ctes('v_signal')}, t as (select ceil(max(wind) / 0.5::double) as bins, count(wind) as total from v_signal), b as (select (case when wind = bins * 0.5 then bins - 1 else floor(wind / 0.5::double) end)::int as bin, total from v_signal, t where wind is not null) select bin, (bin + 0.5::double) * 0.5::double as centre, count(*) as n, round(count(*) / (total * 0.5::double), 8) as density from b group by bin, total",
    "output_share": f"{ctes('v_signal')} select (ceil(wind / 0.5::double) - 1)::int as bin, round(avg(power) / {RATED_KW}::double, 6) as share, count(*) as n from v_signal where wind > 0 group by 1",
    "scada_vs_reference": f"{ctes('v_reading')}, {_PAIR} select round(corr(a, b), 6) as r, round(avg(abs(a - b)), 6) as mean_abs_diff, round(avg((abs(a - b) > 5)::int::double), 6) as share_over_5, count(*) as n from v_pair where a is not null and b is not null",
    "linear_calibration": f"{ctes('v_reading')}, {_PAIR} select round(regr_slope(a, b), 6) as slope, round(regr_intercept(a, b), 5) as intercept, round(regr_r2(a, b), 6) as r2, count(*) as n from v_pair where a is not null and b is not null",
    "correlate_predict": f"{ctes('v_reading')}, m as (select 7.5::double / avg(wind) as ratio from v_reading) select event_id, round(wind, 6) as wind, round(ratio, 6) as ratio, round(wind * ratio, 6) as predicted from v_reading, m",
    "production_records": f"""{ctes('v_reading')}, f as (select ts, sum(power) as total, count(*) as reporting from v_reading where power is not null group by 1),
a as (select * from f order by total desc, ts limit 1), o as (select power, turbine from v_reading where power is not null order by power desc, ts, turbine desc limit 1)
select round(a.total, 4) as farm_kw, epoch_us(a.ts) as farm_at, a.reporting, round(o.power, 4) as turbine_kw, o.turbine from a, o""",
    "production_periods": f"{ctes('v_reading')} select epoch(date_trunc('day', ts))::bigint as start, round(sum(power) / 6000, 6) as mwh, count(*) as readings, round(count(*) / 144::double, 6) as coverage from v_reading where power is not null group by 1",
    "best_day": f"{ctes('v_reading')}, d as (select epoch(date_trunc('day', ts))::bigint as start, sum(power) / 6000 as mwh, count(*) as readings from v_reading where power is not null group by 1) select start, round(mwh, 6) as mwh, readings, round(readings / 144::double, 6) as coverage from d where readings / 144::double >= 0.5 order by d.mwh desc, start limit 1",
    "gap_fill": f"""{ctes('v_hourly')}, s as (select k as h, case when h % 23 >= 9 then output end as output from generate_series((select min(h) from v_hourly), (select max(h) from v_hourly)) g(k) left join v_hourly on h = k),
w as (select h, output, last_value(case when output is not null then h end ignore nulls) over p as k0, last_value(output ignore nulls) over p as v0, first_value(case when output is not null then h end ignore nulls) over n as k1, first_value(output ignore nulls) over n as v1 from s
window p as (order by h rows between unbounded preceding and current row), n as (order by h rows between current row and unbounded following))
select h, round(output, 6) as output, round(case when output is not null then output when h - k0 <= 6 then v0 + (v1 - v0) / nullif(k1 - k0, 0) * (h - k0) end, 6) as output_filled from w""",
    "spine_left_join": f"{ctes('v_reading')}, c as (select floor(epoch(date_trunc('second', ts)) / 3600)::bigint as h, count(*) as n from v_reading where event_type = 'error' group by 1) select k as h, n from generate_series((select min(h) from c), (select max(h) from c)) g(k) left join c on h = k",
    "missing_hours": f"{ctes('v_reading')}, c as (select distinct floor(epoch(date_trunc('second', ts)) / 3600)::bigint as h from v_reading where event_type = 'purchase' and value > 60) select k as h from generate_series((select min(h) from c), (select max(h) from c)) g(k) except select h from c",
    "counter_increments": f"{ctes('v_hourly')}, d as (select h, output, output - lag(output) over (order by h) as x from v_hourly) select h, round(output, 6) as output, round(case when x between 0 and 20 then x end, 6) as increment from d",
    "unpivot_channels": "select l_orderkey, l_linenumber, l_partkey, 'l_quantity' as channel, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount from lineitem union all select l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax from lineitem",
    "pivot_sources": "select l_suppkey, " + ", ".join(f"round(avg(l_quantity) filter (l_returnflag = '{c}'), 6) as {c}" for c in "ANR") + " from lineitem group by 1",
    "kernel_curve": f"{ctes('v_signal')}, c as (select 0.25::double + 0.5::double * k as centre from generate_series(0, 49) g(k)) select turbine, centre, round(sum(exp(-0.5::double * ((wind - centre) / 0.5::double) ** 2) * power) / sum(exp(-0.5::double * ((wind - centre) / 0.5::double) ** 2)), 5) as power, count(*) as n from v_signal join c on abs(wind - centre) <= 2 + 1e-9 where wind is not null and power is not null group by 1, 2",
    "feature_frame": f"""{ctes('v_reading')}, w as (select date_trunc('hour', ts) as hour, avg(wind) as wind from v_reading where event_type = 'view' group by 1), o as (select date_trunc('hour', ts) as hour, avg(power) as output from v_reading where event_type = 'click' group by 1)
select epoch(w.hour)::bigint as hour, round(wind, 6) as wind, case when hour(w.hour) between 7 and 21 then 80.0::double else 55.0::double end as price, round(output, 5) as output, round(wind ** 3, 4) as wind_cubed, hour(w.hour)::int as hour_of_day,
round(0.5::double * 1.225::double * (3.141592653589793::double * {ROTOR_M / 2}::double ** 2) * wind ** 3 / 1000, 4) as available_kw from w join o on w.hour = o.hour where wind is not null and output is not null and not (wind < 2 and output > {RATED_KW / 2})""",
    "wind_components": f"{ctes('v_reading')} select event_id, round(-wind * sin(radians(direction)), 6) + 0::double as u, round(-wind * cos(radians(direction)), 6) + 0::double as v, round(1 - cos(radians(direction / 20)) ** 2, 6) as yaw_loss from v_reading",
    "full_outer_meter": f"""{ctes('v_reading')}, a as (select epoch(date_trunc('day', ts))::bigint as day, sum(value) as s from v_reading where event_type = 'signup' and value > 150 group by 1), b as (select epoch(date_trunc('day', ts))::bigint as day, sum(value) as s from v_reading where event_type = 'error' and value > 150 group by 1)
select coalesce(a.day, b.day) as day, round(a.s, 4) as turbine_sum, round(b.s, 4) as grid_sum from a full join b on a.day = b.day""",
}

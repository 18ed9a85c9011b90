"""Neighbour, sector and wake queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators import forecasting, geometry, layouts, rules, yields
from windloom.operators.power_curve import efficiency_summary
from windloom.plans.relational import rounded, settled
from windloom.plans.views import RATED_KW, ROTOR_M, ctes, layout, reading, signal
from windloom.session import stored, table

REACH = 4000.0


def nearest_turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.nearest(layout(spark, sf_dir), 5).select("turbine", "other", "position", "distance"), distance=6)


def neighbour_underperformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.underperformance(signal(spark, sf_dir), layout(spark, sf_dir), spreads=1.0), share=8)


def freestream_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.freestream(layout(spark, sf_dir), REACH).groupBy("degree").agg(F.count(F.lit(1)).alias("n"), F.sum("turbine").alias("ids"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all turbines: one a ship date and part number's remainder, as one whole number; a record is in one partition."""
    record = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) * 8 + F.col("l_partkey") % 4 + 3
    rows = table(spark, sf_dir, "lineitem").select(record.alias("record"), F.col("l_suppkey").alias("turbine"), (F.col("l_extendedprice") / 50).alias("power"))
    return rows.repartition("record").groupBy("record", "turbine").agg(F.avg("power").alias("power"))


def _second() -> Column:
    return F.floor(F.col("record") / 8)


def _direction() -> Column:
    """A direction from a record's date and part."""
    name = F.concat_ws(":", _second().cast("string"), (F.pmod("record", F.lit(8)) - 3).cast("string"))
    return F.when(F.col("record").isNotNull(), F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(3600)) / 10)


def _measured(spark: SparkSession, sf_dir: str) -> tuple:
    sectors = stored(geometry.open_sectors(layout(spark, sf_dir), REACH), "sectors")
    return _readings(spark, sf_dir), sectors, _direction(), RATED_KW, 3


def wake_loss_by_turbine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.wake_losses(*_measured(spark, sf_dir)), loss_pct=6)


def wake_loss_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.wake_by_direction(geometry.wake_records(*_measured(spark, sf_dir))), loss_pct=6, energy_share_pct=6)


def worst_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.worst_bins(wake_loss_by_direction(spark, sf_dir), 3, 40)


def gam_yield_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's energy by 300 draws of the ship dates, by splines of each day's mean wind and discount, applied to the order dates."""
    days = signal(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), ["l_orderkey", "l_linenumber"])
    days = days.groupBy(F.unix_date(F.col("ts").cast("date")).alias("day")).agg((F.sum("power") / 1000).alias("energy"), F.avg("wind").alias("wind"), (100 * F.avg("l_discount")).alias("temperature"))
    year = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg((12 + F.avg(F.col("o_custkey") % 10) / 5).alias("wind"), (F.avg("o_totalprice") / 30000).alias("temperature"))
    return rounded(yields.gam_yield(days, year, 300), aep=3, freedom=4)


def long_term_wake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wake losses by 30 draws of the ship dates, as measured and with the events' long-term winds."""
    own = geometry.wake_records(*_measured(spark, sf_dir)).withColumn("day", F.floor(_second() / 86400))
    sector, speed = F.floor(F.col("direction") / 30).cast("int"), F.least(F.floor(10 * F.col("free_kw") / RATED_KW), F.lit(9)).cast("int")
    bins = own.groupBy("day", sector.alias("direction"), speed.alias("speed")).agg(F.sum("power").alias("power"), F.sum(F.col("free_kw") * F.col("reporting")).alias("free"), F.sum("reporting").alias("records"))
    bins = stored(bins, "bins")
    bins = bins.join(forecasting.numbered(bins.select("day").distinct(), "day").withColumnRenamed("i", "day_no"), "day").drop("day")
    winds = reading(spark, sf_dir).groupBy(F.floor(F.col("direction") / 30).cast("int").alias("direction"), F.least(F.floor("wind"), F.lit(9)).cast("int").alias("speed"))
    return rounded(yields.long_term_wake(bins, winds.agg(F.count(F.lit(1)).cast("double").alias("hours")), 30), loss_pct=6, loss_lt_pct=6)


#: Turbine k of a planted line stands at place 7 k modulo their number.
LINE_TURBINES = 20


def inferred_line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planted line recovered: each turbine's power is a sum of the event types' hourly means, weighted by its distance from
    five points along the line; positions run from northwest to southeast."""
    h = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    hours = reading(spark, sf_dir).groupBy(h.alias("ts"), (F.array_position(kinds, F.col("event_type")) - 1).alias("k")).agg(F.avg("value").alias("v"))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(LINE_TURBINES)))
    place = F.pmod(F.col("turbine") * 7, F.lit(LINE_TURBINES))
    spread = hours.select("ts", "k", "v", numbers.alias("turbine")).withColumn("w", F.greatest(1 - F.abs(place - F.col("k") * 4.75) / 7, F.lit(0.0)))
    power = spread.groupBy(F.lit("line").alias("farm"), "turbine", "ts").agg(F.sum(F.col("v") * F.col("w")).alias("power"))
    spots = spark.range(LINE_TURBINES).select(F.lit("line").alias("farm"), F.col("id").alias("spot"), (50 - 0.002 * F.col("id")).alias("lat"), (8 + 0.004 * F.col("id")).alias("lon"))
    return layouts.inferred_layout(power, spots).select("spot", "turbine", "rank")


def line_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.line_bearing(layout(spark, sf_dir)), bearing=5)


def _on_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading(spark, sf_dir).select((F.col("direction") / 20).alias("direction"), (F.col("wind") / 4).alias("wind"), (F.col("event_id") % 2 == 0).alias("on"), F.col("value").alias("power"), (F.col("power") + 1).alias("reference"))


def binned_on_off_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.on_off_gain(geometry.on_off_bins(_on_off(spark, sf_dir))), gain_pct=6)


def day_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).withColumn("day", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400))
    daily = rows.groupBy("day").agg(F.sum("value").alias("a"), F.sum("power").alias("b"))
    return rounded(geometry.block_bootstrap(daily, 300, "a", "b"), ratio=8)


def sector_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).select("direction", F.col("value").alias("a"), F.col("power").alias("b"))
    return rounded(geometry.sector_ratio(rows), ratio=6)


def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = signal(spark, sf_dir).groupBy("turbine", F.year("ts").alias("year")).agg(F.sum("power").alias("power"))
    return rounded(geometry.row_profile(days, ["turbine"], "year", "power"), power=4, relative_pct=6)


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed anomalies of the projected farm."""
    own = efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M)
    under = geometry.underperformance(signal(spark, sf_dir), layout(spark, sf_dir), spreads=1.0)
    band = reading(spark, sf_dir).agg(F.count_if(F.col("power") > 1.5 * F.col("value") * 20).alias("n_bad"), F.avg((F.col("power") > 1.5 * F.col("value") * 20).cast("double")).alias("share_bad"), F.count(F.lit(1)).alias("n"))
    return rounded(rules.diagnose(band, own, under).select("type", "turbine", "value"), value=6)


def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(rules.extremes(efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M), "capacity_factor"), best_value=6, worst_value=6)


_NAMES = (
    nearest_turbines, neighbour_underperformance, freestream_sets, wake_loss_by_turbine, wake_loss_by_direction, worst_directions, line_bearing, inferred_line_layout, gam_yield_draws, long_term_wake, binned_on_off_ratio,
    day_block_bootstrap, sector_ratio, row_profile, diagnosis, best_and_worst,
)
QUERIES = {f.__name__: f for f in _NAMES}

_NEAR = """pr as (select a.turbine, b.turbine as other, b.x - a.x as dx, b.y - a.y as dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as distance from v_layout a join v_layout b on a.turbine <> b.turbine),
nr as (select *, row_number() over (partition by turbine order by distance, other) as position from pr)"""
_UNDER = f"""{_NEAR}, pw as (select turbine, ts, avg(power) as power from v_signal group by 1, 2),
ar as (select nr.turbine, ts, median(power) as m, stddev_samp(power) as s from nr join pw on pw.turbine = nr.other where position <= 5 group by 1, 2),
un as (select pw.turbine, count(*) as under from pw join ar using (turbine, ts) where m > 50 and power < m - s group by 1),
us as (select t.turbine, coalesce(under, 0) as under, coalesce(under, 0) / (select count(distinct ts) from pw)::double as share from (select distinct turbine from pw) t left join un using (turbine))"""
_FREE = f"""{_NEAR}, wk as (select distinct turbine, d from pr, generate_series(0, 359) g(d) where distance > 0 and distance <= {REACH}::double
  and abs(fmod(fmod(fmod(degrees(atan2(dx, dy)) + 360, 360) - d + 180, 360) + 360, 360) - 180) <= 20),
fr as (select d::int as degree, turbine from v_layout, generate_series(0, 359) g(d) where not exists (select 1 from wk where wk.turbine = v_layout.turbine and wk.d = g.d))"""
_REC = f"""{_FREE}, l0 as (select epoch(l_shipdate)::bigint || ':' || (l_partkey % 4) as record, l_suppkey as turbine, l_extendedprice / 50 as power from lineitem),
l1 as (select record, turbine, avg(power) as power from l0 group by 1, 2),
l2 as (select *, (('0x' || substr(md5(record), 1, 6))::bigint % 3600) / 10 as direction from l1),
l3 as (select l2.*, fr.turbine is not null as free from l2 left join fr on fr.turbine = l2.turbine and fr.degree = round_even(direction, 0)::int % 360),
l4 as (select record, avg(power) filter (free) as free_kw, count(power) as reporting from l3 group by 1),
rc as (select l2.*, free_kw from l2 join l4 using (record) where free_kw between 0.05::double * {RATED_KW} and 0.9::double * {RATED_KW} and reporting >= 3 and power is not null)"""
_DIR = """bd as (select (floor(direction / 5) * 5)::int % 360 as bin, sum(power) as e, sum(free_kw) as f, count(distinct record) as n from rc group by 1),
dr as (select b::int as bin, round(case when coalesce(n, 0) >= 20 then 100 * (1 - e / f) end, 6) as loss_pct, round(case when coalesce(n, 0) >= 20 then 100 * e / (select sum(power) from rc) else 0 end, 6) as energy_share_pct, coalesce(n, 0) as records
from generate_series(0, 355, 5) g(b) left join bd on bin = b)"""
_EFF = f"""eff as (select turbine, avg(power) / {RATED_KW}::double as capacity_factor,
  quantile_cont(case when wind >= 3 then power / (0.5::double * 1.225::double * (3.141592653589793::double * {ROTOR_M / 2}::double ** 2) * wind ** 3 / 1000) end, 0.95) as peak_cp from v_signal group by 1)"""

ORACLES = {
    "nearest_turbines": f"{ctes('v_layout')}, {_NEAR} select turbine, other, position, round(distance, 6) as distance from nr where position <= 5",
    "neighbour_underperformance": f"{ctes('v_layout', 'v_signal')}, {_UNDER} select turbine, under, round(share, 8) as share from us",
    "freestream_sets": f"{ctes('v_layout')}, {_FREE} select degree, count(*) as n, sum(turbine)::bigint as ids from fr group by 1",
    "wake_loss_by_turbine": f"{ctes('v_layout')}, {_REC} select turbine, round(100 * (1 - sum(power) / sum(free_kw)), 6) as loss_pct, count(distinct record) as records from rc group by 1",
    "wake_loss_by_direction": f"{ctes('v_layout')}, {_REC}, {_DIR} select * from dr",
    "worst_directions": f"{ctes('v_layout')}, {_REC}, {_DIR} select * from dr where loss_pct is not null and records >= 40 order by loss_pct desc, bin limit 3",
    "long_term_wake": f"""{ctes('v_layout', 'v_reading')}, {_REC}, b as (
  select floor(split_part(record, ':', 1)::bigint / 86400)::bigint as day, floor(direction / 30)::int as d, least(floor(10 * free_kw / {RATED_KW}::double), 9)::int as s, sum(power) as power, sum(free_kw) as free, count(*) as n from rc group by 1, 2, 3),
dn as (select day, row_number() over (order by day) - 1 as day_no from (select distinct day from b)),
p as (select i as draw, ('0x' || substr(md5(i || ':' || j), 1, 8))::bigint % (select count(*) from dn) as day_no from generate_series(0, 29) g(i), generate_series(0, (select count(*) - 1 from dn)) h(j)),
w as (select draw, day_no, count(*) as k from p group by 1, 2),
db as (select draw, d, s, sum(k * power) as power, sum(k * free) as free, sum(k * n) as n from w join dn using (day_no) join b using (day) group by 1, 2, 3),
lt as (select floor(direction / 30)::int as d, least(floor(wind), 9)::int as s, count(*)::double as h from v_reading group by 1, 2)
select draw, round(100 * (1 - sum(power) / sum(free)), 6) as loss_pct, round(100 * (1 - sum(power / n * h) / sum(free / n * h)), 6) as loss_lt_pct from db left join lt using (d, s) group by 1""",
    "inferred_line_layout": """with t as (select i as turbine, (i * 7) % 20 as place from generate_series(1, 20) g(i)), s as (select covar_pop(place, turbine) as c from t)
select case when c >= 0 then place else 19 - place end::bigint as spot, turbine::int as turbine, case when c >= 0 then place + 1 else 20 - place end::int as rank from t, s""",
    "line_bearing": f"{ctes('v_layout')} select round(fmod(90 - degrees(atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) / 2 + 360, 180), 5) as bearing from v_layout",
    "binned_on_off_ratio": f"""{ctes('v_reading')}, r as (select floor(direction / 20 / 2)::int as db, floor(wind / 4)::int as sb, event_id % 2 = 0 as o, value as power, power + 1 as reference from v_reading),
b as (select db, sb, count_if(o) as n1, count_if(not o) as n0, avg(power) filter (o) as p1, avg(power) filter (not o) as p0, avg(reference) filter (o) as r1, avg(reference) filter (not o) as r0 from r group by 1, 2 having count_if(o) > 0 and count_if(not o) > 0),
w as (select *, least(n1, n0) as w from b) select round(100 * ((sum(w * p1) / sum(w * r1)) / (sum(w * p0) / sum(w * r0)) - 1), 6) as gain_pct, count(*) as bins from w""",
    "day_block_bootstrap": f"""{ctes('v_reading')}, s as (select floor(epoch(date_trunc('second', ts)) / 86400)::bigint as day, sum(value) as a, sum(power) as b from v_reading group by 1),
d as (select *, row_number() over (order by day) - 1 as day_no from s), p as (select i as draw, ('0x' || substr(md5(i || ':' || j), 1, 8))::bigint % (select count(*) from d) as day_no from generate_series(0, 299) g(i), generate_series(0, (select count(*) - 1 from d)) h(j))
select draw, round(sum(a) / sum(b), 8) as ratio from p join d using (day_no) group by 1""",
    "sector_ratio": f"{ctes('v_reading')} select floor(direction / 30) * 30 as sector, round(avg(value / power), 6) as ratio, count(*) as n from v_reading where power > 0 group by 1",
    "row_profile": f"{ctes('v_signal')}, d as (select turbine, year(ts)::int as year, sum(power) as power from v_signal group by 1, 2), f as (select turbine, min_by(power, year) as p0 from d group by 1) select turbine, year, round(power, 4) as power, round(100 * power / p0, 6) as relative_pct from d join f using (turbine)",
    "diagnosis": f"""{ctes('v_layout', 'v_signal', 'v_reading')}, {_UNDER}, {_EFF}, fl as (select count(*) as n, count_if(peak_cp > 16::double / 27) as over_n from eff),
bd as (select avg((power > 1.5 * value * 20)::int::double) as v from v_reading)
select 'output_out_of_band' as type, null as turbine, round(v, 6) as value from bd where v > 0
union all select 'fleet_wide_wind_bias', null, round(over_n / n, 6) from fl where n >= 4 and over_n >= 0.75 * n
union all select 'anemometer_suspect', turbine::varchar, round(peak_cp, 6) from eff, fl where peak_cp > 16::double / 27 and not (n >= 4 and over_n >= 0.75 * n)
union all select 'under_neighbours', turbine::varchar, round(share, 6) from us where share > 0.05""",
    "best_and_worst": f"{ctes('v_signal')}, {_EFF} select arg_max(turbine, capacity_factor) as best, round(max(capacity_factor), 6) as best_value, arg_min(turbine, capacity_factor) as worst, round(min(capacity_factor), 6) as worst_value from eff",
}

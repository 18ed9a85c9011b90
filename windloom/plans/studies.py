"""Queries of the studies over all farms, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.text import fingerprint
from windloom.operators import studies
from windloom.operators.power_curve import efficiency_summary
from windloom.plans import forecasts, texts, wake
from windloom.plans.relational import rounded, settled
from windloom.plans.views import RATED_KW, ROTOR_M, ctes, reading, signal
from windloom.session import table


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return reading(spark, sf_dir).groupBy(F.col("event_type").alias("sensor"), hour.alias("h")).agg(F.avg("value").alias("v"))


def sensor_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's hourly mean from its two closest peers; the first twenty days of a month are for fitting."""
    design = studies.peer_design(_hours(spark, sf_dir), forecasts.correlation_pairs(spark, sf_dir))
    return rounded(studies.sensor_models(design, ["x1", "x2"], F.floor(F.col("h") / 24) % 30 < 20), r2=6, threshold=5)


def cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_orderkey")
    return rounded(studies.cross_validated(rows, "l_quantity", "l_extendedprice", F.col("l_orderkey") % 5, "l_orderkey"), r2=6)


def farm_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All farms (nations) in one job."""
    eff = efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M)
    farms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("turbine"), F.col("s_nationkey").alias("farm"))
    return rounded(studies.farm_export(eff.join(farms, "turbine")), mean_capacity_factor=5)


def compact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    eff = rounded(settled(efficiency_summary(signal(spark, sf_dir), RATED_KW, ROTOR_M), capacity_factor=6), peak_cp=6)
    tree = eff.select("turbine", F.struct("capacity_factor", "peak_cp", "hours", "betz_limit").alias("result"))
    return studies.compact_summary(tree, "turbine", "result", ["hours", "betz_limit"], "capacity_factor")


def wake_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wake.wake_loss_by_turbine(spark, sf_dir)
    return out.select("turbine", studies.wake_note(F.col("loss_pct"), F.col("records"), 40).alias("note"))


def single_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",000 kW"))), F.when(F.col("p_partkey") % 3 == 0, F.lit("and 7.5 m"))).alias("text"))
    return rows.select("p_partkey", studies.single_number(F.col("text")).alias("number"))


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turbines asked for by id."""
    return studies.looked_up(table(spark, sf_dir, "supplier"), "s_suppkey", [3, 7]).select("s_suppkey", "s_name", "s_acctbal")


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as an index, checked to be fresh, and searched: ids divisible by 100 against all rows."""
    v = table(spark, sf_dir, "embeddings")
    mark = fingerprint(F.col("vec_id"), F.col("label"))
    path = studies.build_index(v, mark)
    if not studies.index_is_fresh(spark, path, v, mark):
        raise RuntimeError("the index isn't of these vectors")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(studies.search_index(spark, path, queries, 3), distance=6)


def live_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hours(spark, sf_dir).withColumnRenamed("sensor", "farm")
    return rounded(studies.live_forecasts(rows, "farm", "h", "v"), prediction=5)


_NAMES = (sensor_models, cross_validated, farm_export, compact_summary, wake_notes, single_numbers, looked_up, indexed_search, live_forecasts)
QUERIES = {f.__name__: f for f in _NAMES}

_EFF = f"""{ctes('v_signal')}, eff as (select turbine, round(avg(power) / {RATED_KW}::double, 6) as cf,
  round(quantile_cont(case when wind >= 3 then power / (0.5::double * 1.225::double * (3.141592653589793::double * {ROTOR_M / 2}::double ** 2) * wind ** 3 / 1000) end, 0.95), 6) as cp from v_signal group by 1)"""
_PAIRS = forecasts.ORACLES["correlation_pairs"]
_CUT = _PAIRS.index("select a.sensor")
_HW = forecasts.ORACLES["holt_winters"]

ORACLES = {
    "sensor_models": f"""{_PAIRS[:_CUT].rstrip()}, cp as ({_PAIRS[_CUT:]}), pe as (select sensor, peer, row_number() over (partition by sensor order by abs(r) desc, peer) as k from (select sensor, peer, r from cp union all select peer, sensor, r from cp)),
d as (select a.sensor, a.h, a.v as y, b.v as x1, c.v as x2, floor(a.h / 24) % 30 < 20 as train from r a join pe p on p.sensor = a.sensor and p.k = 1 join r b on b.sensor = p.peer and b.h = a.h join pe q on q.sensor = a.sensor and q.k = 2 join r c on c.sensor = q.peer and c.h = a.h),
s as (select sensor, count(*) + 1 as d, avg(x1) as m1, avg(x2) as m2, avg(y) as my, stddev_pop(x1) as s1, stddev_pop(x2) as s2, count(*) * covar_pop(x1, x2) / (stddev_pop(x1) * stddev_pop(x2)) as p, count(*) * covar_pop(x1, y) / stddev_pop(x1) as u, count(*) * covar_pop(x2, y) / stddev_pop(x2) as v from d where train group by 1),
w as (select *, (u * d - v * p) / (d * d - p * p) / s1 as w1, (v * d - u * p) / (d * d - p * p) / s2 as w2 from s),
e as (select sensor, y, y - (my + w1 * (x1 - m1) + w2 * (x2 - m2)) as e from d join w using (sensor) where not train)
select sensor, round(1 - avg(e * e) / greatest(var_pop(y), 1e-12), 6) as r2, round(quantile_cont(abs(e), 0.99), 5) as threshold, count(*) as n, 1 - avg(e * e) / greatest(var_pop(y), 1e-12) >= 0.5 as watched from e group by 1""",
    "cross_validated": """with f as (select unnest(range(5)) as k), l as (select f.k, regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from f join lineitem on l_orderkey % 5 <> f.k group by 1),
a as (select 'fold ' || k as part, count(*) as n, round(1 - sum((l_extendedprice - s * l_quantity - i) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) as r2 from l join lineitem on l_orderkey % 5 = k group by 1),
c as (select quantile_cont(l_orderkey, 0.8) as c from lineitem), m as (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem, c where l_orderkey <= c)
select * from a union all select 'last', count(*), round(1 - sum((l_extendedprice - s * l_quantity - i) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) from lineitem, c, m where l_orderkey > c""",
    "farm_export": f"{ctes('v_signal')}, eff as (select turbine, avg(power) / {RATED_KW}::double as cf from v_signal group by 1) select s_nationkey as farm, count(*) as turbines, round(avg(cf), 5) as mean_capacity_factor, max({{'c': cf, 't': turbine}}).t as best, min({{'c': cf, 't': turbine}}).t as worst from eff join supplier on s_suppkey = turbine group by 1",
    "compact_summary": f"{_EFF} select turbine, cf as capacity_factor, cp as peak_cp, min(cf) over () as least, max(cf) over () as largest from eff",
    "wake_notes": wake.ORACLES["wake_loss_by_turbine"].replace(" select turbine, round(100", ", wn as (select turbine, round(100") + ") select turbine, case when records < 40 then 'too few records for a wake loss' when loss_pct < 0 then printf('makes %.1f %% more than the turbines in free wind: a site gradient, no wake', -loss_pct) when loss_pct < 5 then printf('small wake loss of %.1f %%', loss_pct) else printf('wake loss of %.1f %%', loss_pct) end as note from wn",
    "single_numbers": "select p_partkey, case when p_partkey % 2 = 0 and p_partkey % 3 > 0 then p_size * 1000.0::double when p_partkey % 2 > 0 and p_partkey % 3 = 0 then 7.5::double end as number from part",
    "looked_up": "select s_suppkey, s_name, s_acctbal from supplier where s_suppkey in (3, 7)",
    "indexed_search": texts.ORACLES["knn_l2"].replace("position <= 10", "position <= 3"),
    "live_forecasts": _HW.replace("select farm, k::int as lead", ", l as (select farm, y, row_number() over (partition by farm order by i desc) as k from n) select farm, ((g - 1) * 24 + 25 - k)::int as lead, round(y, 5) as prediction, 'seasonal' as technique from l, generate_series(1, 2) s(g) where k <= 24 union all select farm, k::int as lead", 1).replace(" as prediction from e, generate_series(1, 24)", " as prediction, 'holt-winters' as technique from e, generate_series(1, 48)"),
}

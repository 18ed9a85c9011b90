"""Backtest, metric, drift, model and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators import drift, forecasting, models
from windloom.plans.relational import rounded
from windloom.plans.views import ctes, hourly, reading, signal
from windloom.session import table


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasting.split_chronological(hourly(spark, sf_dir), "h")


def naive_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecasting.naive_forecasts(_split(spark, sf_dir), "output"), actual=6, predicted=6)


def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecasting.metrics(forecasting.naive_forecasts(_split(spark, sf_dir), "output"), ["method"])
    return rounded(out, mae=6, rmse=6, r2=6, mape=5, bias=6)


def mae_by_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecasting.metrics(forecasting.naive_forecasts(_split(spark, sf_dir), "output"), ["method", "lead"])
    return rounded(out.select("method", "lead", "n", "mae"), mae=6)


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecasting.lag_features(hourly(spark, sf_dir), "h", "output")
    return rounded(out, output=6, **{f"lag_{k}": 6 for k in forecasting.LAGS})


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value a day before as the prediction."""
    out = forecasting.lag_features(hourly(spark, sf_dir), "h", "output", (24,))
    return out.select("h", F.col("output").alias("actual"), F.col("lag_24").alias("predicted"))


def rolling_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecasting.rolling_error(_forecast(spark, sf_dir), "h"), actual=6, predicted=6, rolling_mape=5)


def out_of_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecast(spark, sf_dir)
    both = forecasting.actual_vs_predicted(rows.select("h", "actual"), rows.select("h", "predicted"), "h")
    return rounded(forecasting.out_of_band(both), share_bad=6)


def recent_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecasting.recent_against_all(_forecast(spark, sf_dir).where("predicted is not null"), "h"), mape=5, recent_mape=5)


def graded_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecast(spark, sf_dir).where("predicted is not null")
    runs = rows.select(F.floor(F.col("h") / 48).alias("run_id"), F.lit("naive").alias("technique"), F.col("h").alias("target"), "predicted")
    actual = rows.where("h % 7 > 0").select(F.col("h").alias("target"), "actual")
    return rounded(forecasting.grade(runs, actual, 30, 0.85), coverage=6, mae=6)


def imbalance_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecast(spark, sf_dir).withColumns({"price": F.when((F.col("h") % 24).between(7, 21), 80.0).otherwise(55.0), "week": F.floor(F.col("h") / 168)})
    return rounded(forecasting.imbalance_cost(rows, ["week"]), cost=4)


def capacity_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"), F.col("event_type").alias("farm")).agg(F.sum("value").alias("available"))
    return rounded(forecasting.allocation(rows, 400.0), available=6, allocated=6)


def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).select(F.col("value"), (F.dayofmonth("ts") <= 15).alias("ref"))
    return rounded(drift.psi(rows, "value", "ref"), psi=8)


def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).select(F.col("value"), (F.dayofmonth("ts") <= 15).alias("ref"))
    return rounded(drift.ks_distance(rows, "value", "ref"), ks=8)


def ridge_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sensor"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice").withColumn("train", F.col("l_orderkey") % 5 > 0)
    out = models.ridge_residuals(rows, "sensor", "l_orderkey", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "train")
    return rounded(out.select("sensor", "l_orderkey", "l_linenumber", "l_partkey", "fitted", "residual"), fitted=3, residual=3)


def pca_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sensor"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice").withColumn("train", F.col("l_orderkey") % 5 > 0)
    return models.pca_error(rows, "sensor", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "train", 0.9)


def holt_winters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day ahead for each event type's hourly means, hours without any left out."""
    rows = reading(spark, sf_dir).groupBy(F.col("event_type").alias("farm"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h")).agg(F.avg("value").alias("output"))
    return rounded(models.holt_winters(rows, "farm", "h", "output"), prediction=5)


def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasting.lag_features(_split(spark, sf_dir), "i", "output", (1, 2, 24)).na.drop()
    features = ["lag_1", "lag_2", "lag_24"]
    model = models.boosted(rows.where("train").select(*features, "output"), features, "output")
    return models.predict(model, rows.where("not train")).select("h", "output", "prediction")


def var_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day ahead of two event types' hourly means by an autoregression on both."""
    h = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    rows = reading(spark, sf_dir).groupBy(h.alias("h")).agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    return rounded(models.vector_autoregression(rows.na.drop(), "h", ["a", "b"]), a=5, b=5)


def cosine_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.cosine_yaw(reading(spark, sf_dir), "turbine", "direction", "value"), offset_deg=4)


def gated_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yaw offsets by farm (event type) and turbine; the errors' vane hardly moves."""
    spread = F.when(F.col("event_type") == "error", 38.0).otherwise(8.0)
    rows = reading(spark, sf_dir).select(F.col("event_type").alias("farm"), (F.col("turbine") % 10).alias("turbine"), ((F.col("direction") - 180) / spread).alias("angle"), "wind", "power", "value")
    return rounded(models.gated_yaw(rows), vane_std=6, offset_deg=4)


def electrical_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = reading(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("turbine_mwh"), (F.sum("value") * 0.985).alias("meter_mwh"))
    out = models.draws_summary(models.electrical_losses(daily), [], "loss")
    return rounded(out, **{c: 8 for c in out.columns if c != "n"})


def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every pair of event types' hourly means, missing hours as their type's mean (standardised zero)."""
    rows = reading(spark, sf_dir).groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("h"), F.col("event_type").alias("sensor")).agg(F.avg("value").alias("v"))
    stats = rows.groupBy("sensor").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = rows.join(stats, "sensor").select("h", "sensor", ((F.col("v") - F.col("m")) / F.col("s")).alias("z"))
    return rounded(correlations_by_hour(z), r=8)


def correlations_by_hour(z: DataFrame) -> DataFrame:
    """``(sensor, peer, r)`` of standardised values ``z(h, sensor, z)``: the sensors of an hour are gathered once (a bounded
    array), and the products of its pairs are summed."""
    hours = z.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("sensor", "z"))).alias("s"))
    n = hours.agg(F.count(F.lit(1)).alias("n"))  # one row
    pairs = hours.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a.sensor < b.sensor")
    sums = pairs.groupBy(F.col("a.sensor").alias("sensor"), F.col("b.sensor").alias("peer")).agg(F.sum(F.col("a.z") * F.col("b.z")).alias("p"))
    return sums.join(F.broadcast(n)).select("sensor", "peer", (F.col("p") / (F.col("n") - 1)).alias("r"))


def customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry join: orders by region and priority, small dimensions first."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(rows.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")), mean_price=4)


_NAMES = (
    naive_backtest, forecast_metrics, mae_by_lead, lag_features, rolling_error, out_of_band, recent_error, graded_forecasts, imbalance_cost, capacity_allocation, psi_drift, ks_drift,
    ridge_residual, pca_score, holt_winters, gbt_forecast, var_forecast, cosine_yaw, gated_yaw, electrical_losses, correlation_pairs, customer_nations,
)
QUERIES = {f.__name__: f for f in _NAMES}

_NAIVE = f"""{ctes('v_hourly')}, n as (select h, output, row_number() over (order by h) - 1 as i, count(*) over () as c from v_hourly), t as (select *, floor(c * 0.8::double) as f from n),
w as (select *, floor((i - f) / 24)::bigint as w, ((i - f)::bigint % 24 + 1)::bigint as lead from t where i >= f and (floor((i - f) / 24) + 1) * 24 <= c - f),
p as (select w.w, w.lead, w.output as actual, a.output as persistence, b.output as seasonal, (select avg(z.output) from n z where z.i between w.i - w.lead - 23 and w.i - w.lead) as mean from w left join n a on a.i = w.i - w.lead left join n b on b.i = w.i - 24),
q as (unpivot p on persistence, seasonal, mean into name method value predicted)"""
_FC = f"{ctes('v_hourly')}, fc as (select h, output as actual, lag(output, 24) over (order by h) as predicted from v_hourly)"
_REF = f"{ctes('v_reading')}, rf as (select value, day(ts) <= 15 as ref from v_reading)"

ORACLES = {
    "naive_backtest": f"{_NAIVE} select w, lead, round(actual, 6) as actual, method, round(predicted, 6) as predicted from q",
    "forecast_metrics": f"{_NAIVE} select method, count(*) as n, round(avg(abs(predicted - actual)), 6) as mae, round(sqrt(avg((predicted - actual) ** 2)), 6) as rmse, round(1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)), 6) as r2, round(100 * avg(abs((predicted - actual) / nullif(actual, 0))), 5) as mape, round(avg(predicted - actual), 6) as bias from q group by 1",
    "mae_by_lead": f"{_NAIVE} select method, lead, count(*) as n, round(avg(abs(predicted - actual)), 6) as mae from q group by 1, 2",
    "lag_features": f"{ctes('v_hourly')} select h, round(output, 6) as output, " + ", ".join(f"round(lag(output, {k}) over (order by h), 6) as lag_{k}" for k in forecasting.LAGS) + " from v_hourly",
    "rolling_error": f"{_FC}, a as (select *, 100 * abs((predicted - actual) / nullif(actual, 0)) as a from fc) select h, round(actual, 6) as actual, round(predicted, 6) as predicted, round(case when count(a) over w >= 24 then avg(a) over w end, 5) as rolling_mape from a window w as (order by h rows between 167 preceding and current row)",
    "out_of_band": f"{_FC}, r as (select actual / nullif(predicted, 0) as r from fc where predicted is not null) select count_if(coalesce(r < 0.5 or r > 1.5, false)) as n_bad, round(avg(coalesce(r < 0.5 or r > 1.5, false)::int::double), 6) as share_bad, count(*) as n from r",
    "recent_error": f"{_FC}, r as (select h, 100 * abs((actual - predicted) / nullif(actual, 0)) as a from fc where predicted is not null), l as (select a from r order by h desc limit 168) select round((select avg(a) from r), 5) as mape, round((select avg(a) from l), 5) as recent_mape",
    "graded_forecasts": f"""{_FC}, p as (select * from fc where predicted is not null), a as (select h, actual from p where h % 7 > 0), j as (select floor(p.h / 48)::bigint as run_id, p.h, p.predicted, a.actual from p left join a using (h))
select run_id, 'naive' as technique, round(avg((actual is not null)::int::double), 6) as coverage, round(avg(abs(predicted - actual)), 6) as mae, count(actual) as n from j group by 1 having max(h) + 30 <= (select max(h) from a) and avg((actual is not null)::int::double) >= 0.85""",
    "imbalance_cost": f"{_FC} select floor(h / 168)::bigint as week, round(sum(abs(actual - predicted) * case when h % 24 between 7 and 21 then 80 else 55 end), 4) as cost from fc group by 1",
    "capacity_allocation": f"""{ctes('v_reading')}, r as (select floor(epoch(date_trunc('second', ts)) / 3600)::bigint as hour, event_type as farm, sum(value) as available from v_reading group by 1, 2),
s as (select *, sum(available) over (partition by hour) as t, sum(available * 0.6::double) over (partition by hour) as l from r)
select hour, farm, round(available, 6) as available, round(available * 0.6::double * least(1, coalesce(400 / nullif(l, 0), 1)) + coalesce((available - available * 0.6::double) * greatest(least(400, t) - l, 0) / nullif(t - l, 0), 0), 6) as allocated from s""",
    "psi_drift": f"""{_REF}, e as (select quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from rf where ref),
b as (select len(list_filter(e, lambda x: x < value)) as bin, count_if(ref) as r, count_if(not ref) as c from rf, e group by 1),
p as (select greatest(coalesce(c, 0) / (select sum(c) from b), 0.0001) as p, greatest(coalesce(r, 0) / (select sum(r) from b), 0.0001) as q from generate_series(0, 9) g(k) left join b on bin = k) select round(sum((p - q) * ln(p / q)), 8) as psi from p""",
    "ks_drift": f"{_REF}, v as (select value, count_if(ref) as r, count_if(not ref) as c from rf where value is not null group by 1), g as (select abs(sum(r) over (order by value) / (select sum(r) from v) - sum(c) over (order by value) / (select sum(c) from v)) as g from v) select round(max(g), 8) as ks from g",
    "holt_winters": f"""{ctes('v_reading')}, m as (select event_type as farm, floor(epoch(date_trunc('second', ts)) / 3600)::bigint as h, avg(value) as y from v_reading group by 1, 2),
n as (select farm, y, row_number() over (partition by farm order by h) - 1 as i, count(*) over (partition by farm) as c from m),
b as (select farm, avg(y) filter (i < 24) as a, avg(y) filter (i between 24 and 47) as a2, list(y order by i) filter (i < 24) as f from n where c >= 48 group by 1),
st as (select farm, 0::bigint as i, a as level, (a2 - a) / 24 as trend, list_transform(f, lambda x: x - a) as s from b
  union all select farm, i + 1, nl, 0.02::double * (nl - level) + 0.98::double * trend, list_transform(s, lambda x, j: case when j = i % 24 + 1 then 0.2::double * (y - nl) + 0.8::double * x else x end)
  from (select st.*, y, 0.3::double * (y - s[st.i % 24 + 1]) + 0.7::double * (level + trend) as nl from st join n on n.farm = st.farm and n.i = st.i)),
e as (select st.* from st join (select farm, max(c) as c from n group by 1) using (farm) where i = c)
select farm, k::int as lead, round(level + trend * k + s[(i + k - 1) % 24 + 1], 5) as prediction from e, generate_series(1, 24) g(k)""",
    "var_forecast": f"""{ctes('v_reading')}, r as (select floor(epoch(date_trunc('second', ts)) / 3600)::bigint as h, avg(value) filter (event_type = 'view') as a, avg(value) filter (event_type = 'click') as b from v_reading group by 1),
k as (select * from r where a is not null and b is not null), l as (select *, lag(a) over (order by h) as x, lag(b) over (order by h) as y from k), o as (select * from l where x is not null),
s as (select avg(x) as mx, avg(y) as my, avg(a) as ma, avg(b) as mb, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy, covar_pop(x, a) as xa, covar_pop(y, a) as ya, covar_pop(x, b) as xb, covar_pop(y, b) as yb from o),
w as (select *, (xa * yy - ya * xy) / (xx * yy - xy * xy) as p, (ya * xx - xa * xy) / (xx * yy - xy * xy) as q, (xb * yy - yb * xy) / (xx * yy - xy * xy) as u, (yb * xx - xb * xy) / (xx * yy - xy * xy) as v from s),
f as (select 0 as lead, arg_max(a, h) as a, arg_max(b, h) as b from k union all select lead + 1, ma + p * (a - mx) + q * (b - my), mb + u * (a - mx) + v * (b - my) from f, w where lead < 24)
select lead, round(a, 5) as a, round(b, 5) as b from f where lead > 0""",
    "gated_yaw": f"""{ctes('v_reading')}, o as (select event_type as farm, turbine % 10 as turbine, (direction - 180) / case when event_type = 'error' then 38 else 8 end::double as angle, value from v_reading where wind > 4.5 and wind < 8.5 and power > 0 and direction is not null),
g as (select farm, stddev_samp(angle) as vane_std from o group by 1),
s as (select farm, turbine, count(*) as n, var_pop(cos(radians(angle))) as xx, var_pop(sin(radians(angle))) as yy, covar_pop(cos(radians(angle)), sin(radians(angle))) as xy, covar_pop(cos(radians(angle)), value) as xv, covar_pop(sin(radians(angle)), value) as yv from o where abs(angle) <= 25 group by 1, 2),
f as (select *, degrees(atan2((yv * xx - xv * xy) / nullif(xx * yy - xy * xy, 0), (xv * yy - yv * xy) / nullif(xx * yy - xy * xy, 0))) as off from s join g using (farm))
select farm, turbine, round(vane_std, 6) as vane_std, n, round(case when vane_std >= 4 then off end, 4) as offset_deg, case when vane_std >= 4 and off is not null then 'fitted' else 'not identifiable' end as status from f""",
    "cosine_yaw": f"""{ctes('v_reading')}, s as (select turbine, count(*) as n, var_pop(cos(radians(direction))) as xx, var_pop(sin(radians(direction))) as yy, covar_pop(cos(radians(direction)), sin(radians(direction))) as xy, covar_pop(cos(radians(direction)), value) as xv, covar_pop(sin(radians(direction)), value) as yv
  from v_reading where direction is not null and value is not null group by 1)
select turbine, n, round(degrees(atan2((yv * xx - xv * xy) / nullif(xx * yy - xy * xy, 0), (xv * yy - yv * xy) / nullif(xx * yy - xy * xy, 0))), 4) as offset_deg from s""",
    "electrical_losses": f"""{ctes('v_reading')}, t as (select sum(value) as t, sum(value) * 0.985::double as m from v_reading), u as (select ('0x' || substr(md5(i || ':meter'), 1, 8))::bigint / 4294967296::double as a, ('0x' || substr(md5(i || ':scada'), 1, 8))::bigint / 4294967296::double as b from generate_series(0, 4999) g(i)),
l as (select 1 - m * (1 + 0.005::double * (2 * a - 1)) / (t * (1 + 0.005::double * (2 * b - 1))) as loss from u, t)
select round(avg(loss), 8) as mean, round(stddev_samp(loss), 8) as std, {', '.join(f"round(quantile_cont(loss, {q}), 8) as p{int(q * 100)}" for q in (0.05, 0.1, 0.5, 0.9, 0.95))}, count(*) as n from l""",
    "ridge_residual": """with r as (select l_suppkey as sensor, l_orderkey, l_linenumber, l_partkey, l_quantity::double as a, l_discount::double as b, l_tax::double as c, l_extendedprice::double as y, l_orderkey % 5 > 0 as train from lineitem),
s as (select sensor, count(*) as n, avg(a) as ma, avg(b) as mb, avg(c) as mc, avg(y) as my, greatest(stddev_pop(a), 1e-6) as sa, greatest(stddev_pop(b), 1e-6) as sb, greatest(stddev_pop(c), 1e-6) as sc,
  count(*) * covar_pop(a, b) as ab, count(*) * covar_pop(a, c) as ac, count(*) * covar_pop(b, c) as bc, count(*) * covar_pop(a, y) as ay, count(*) * covar_pop(b, y) as by_, count(*) * covar_pop(c, y) as cy from r where train group by 1),
m as (select *, n + 1 as d, ab / (sa * sb) as p, ac / (sa * sc) as q, bc / (sb * sc) as t, ay / sa as u, by_ / sb as v, cy / sc as w from s),
k as (select *, d * (d * d - t * t) - p * (p * d - t * q) + q * (p * t - d * q) as det from m),
w as (select sensor, ma, mb, mc, my, (u * (d * d - t * t) - p * (v * d - t * w) + q * (v * t - d * w)) / det / sa as wa, (d * (v * d - t * w) - u * (p * d - t * q) + q * (p * w - v * q)) / det / sb as wb, (d * (d * w - v * t) - p * (p * w - v * q) + u * (p * t - d * q)) / det / sc as wc, n from k)
select sensor, l_orderkey, l_linenumber, l_partkey, round(case when n >= 100 then my + wa * (a - ma) + wb * (b - mb) + wc * (c - mc) end, 3) as fitted, round(case when n >= 100 then y - (my + wa * (a - ma) + wb * (b - mb) + wc * (c - mc)) end, 3) as residual from r left join w using (sensor)""",
    "correlation_pairs": f"""{ctes('v_reading')}, r as (select floor(epoch(date_trunc('second', ts)) / 3600)::bigint as h, event_type as sensor, avg(value) as v from v_reading group by 1, 2),
z as (select h, sensor, (v - avg(v) over (partition by sensor)) / stddev_samp(v) over (partition by sensor) as z from r)
select a.sensor, b.sensor as peer, round(sum(a.z * b.z) / ((select count(distinct h) from r) - 1), 8) as r from z a join z b on a.h = b.h and a.sensor < b.sensor group by 1, 2""",
    "customer_nations": "select r_name, o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean_price from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
}

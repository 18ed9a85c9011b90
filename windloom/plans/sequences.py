"""Quality control, intervals, ordered state and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators import intervals, qc, scoring, sequence
from windloom.plans.relational import rounded
from windloom.plans.views import RATED_KW, SIGNAL_ORDER, ctes, interval, reading, signal
from windloom.session import table

KEYS = ["turbine", "l_orderkey", "l_linenumber", "l_partkey", "wind"]


def qc_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qc.frozen_flags(signal(spark, sf_dir), ["turbine"], SIGNAL_ORDER, "wind")
    return out.groupBy("turbine").agg(F.count_if("frozen").alias("frozen"), F.count(F.lit(1)).alias("n"))


def qc_bin_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qc.bin_outliers(signal(spark, sf_dir), ["turbine"], "power", "wind", 100.0, 0.02 * RATED_KW, 0.95 * RATED_KW)
    return out.select(*KEYS, "bin", "outlier")


def qc_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qc.qc_summary(qc.qc_flags(signal(spark, sf_dir), SIGNAL_ORDER, RATED_KW))
    return rounded(out, frozen_share=6, stopped_share=6, outlier_share=6, bad_share=6)


def _sensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir).withColumn("sensor", F.pmod("turbine", F.lit(10)))
    return rows.withColumn("value", F.when(F.pmod("l_partkey", F.lit(97)) > 0, F.col("power"))).withColumn("ref", F.col("ts") < F.lit("1998-06-01").cast("timestamp_ntz"))


def sensor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qc.sensor_checks(_sensor_rows(spark, sf_dir), "sensor", ["ts", "l_orderkey", "l_linenumber", "l_partkey", "power", "turbine"], "value", "ref")
    return out.groupBy("sensor").agg(*[F.count_if(c).alias(c) for c in ("gap", "stale", "out_of_range", "step", "erratic", "bad")])


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.profile(_sensor_rows(spark, sf_dir), ["sensor"], ["ts", "l_orderkey", "l_linenumber", "l_partkey", "power", "turbine"], "value")


def downtime_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.downtime(interval(spark, sf_dir), ["turbine"]), hours=6)


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(interval(spark, sf_dir), ["turbine"])


def top_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.top_causes(interval(spark, sf_dir), ["turbine"]), hours=6, longest=6)


def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.latest(interval(spark, sf_dir), ["turbine"], ["start_s", "event_id"])


def significant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.significant(interval(spark, sf_dir), ["error", "purchase"])


def in_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = interval(spark, sf_dir)
    windows = events.where("message = 'error'").select("turbine", F.col("start_s").alias("window_start"), (F.col("end_s") + 86400).alias("window_end"), F.col("event_id").alias("window_id"))
    return intervals.in_windows(events.select("turbine", "event_id", "start_s"), windows, "turbine", "start_s").select("turbine", "event_id", "window_id")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: events of large value as episodes, all events as monitored rows, and a base rate per user."""
    rows = reading(spark, sf_dir).withColumn("day", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400))
    days = rows.groupBy(F.col("turbine").alias("event_id"), "day").agg(F.count_if(F.col("value") > 60).alias("episodes"), F.count(F.lit(1)).alias("monitored"))
    rate = days.groupBy("event_id").agg(((F.sum("episodes") + 0.5) / F.sum("monitored") / 2).alias("base_rate"))
    return days.join(rate, "event_id")


def cusum_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.poisson_cusum(_days(spark, sf_dir), ["event_id"], ["day"], factor=2.0, alpha=0.1)
    return rounded(out.select("event_id", "day", "cusum", "warn"), cusum=6)


def count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.count_rule(_days(spark, sf_dir), ["event_id"], ["day"], 2, 2).select("event_id", "day", "alert", "warn")


def trailing_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("alert", F.col("episodes") >= 2)
    return sequence.trailing_any(days, ["event_id"], ["day"], "alert", 3, "recent").select("event_id", "day", "alert", "recent")


def episode_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.episodes(signal(spark, sf_dir), ["turbine"], SIGNAL_ORDER, F.col("wind") > 9)
    return out.groupBy("turbine").agg(F.count_if("in_episode").alias("rows_in"), F.count_if("starts").alias("starts"))


def _case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases: numbered rows, a flag for large values, status from props, an event in the last third."""
    w = Window.partitionBy("turbine").orderBy("ts", "event_id")
    rows = reading(spark, sf_dir).withColumn("id", F.row_number().over(w))
    n = rows.groupBy("turbine").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(n, "turbine")
    return rows.select(
        F.col("turbine").alias("event_id"), F.when(F.col("turbine") % 2 == 0, "anomaly").otherwise("normal").alias("label"), "id",
        ((F.col("value") > 30) | ((F.col("turbine") % 4 == 0) & (F.col("id") * 3 > F.col("n")))).alias("flag"), (F.col("power") > 40).alias("normal"),
        F.ceil(F.col("n") * 2 / 3).alias("start_id"), F.col("n").alias("end_id"),
    )


def criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _case(spark, sf_dir).select("event_id", "id", "flag", "normal")
    return sequence.criticality(rows, ["event_id"], ["id"], "flag", "normal").select("event_id", "id", "criticality")


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.evaluate_events(_case(spark, sf_dir)), coverage=6, accuracy=6, earliness=6)


def care_score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scoring.evaluate_events(_case(spark, sf_dir)).withColumn("farm", F.floor(F.col("event_id") / 50))
    return rounded(scoring.care_score(events, "farm"), coverage=6, accuracy=6, reliability=6, earliness=6, care=6)


def rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(k, e, p) for k, (e, p) in enumerate((e, p) for e in (1, 2, 3) for p in (1, 2))], "rule_id int, least int, persist int")
    return scoring.rule_grid(_days(spark, sf_dir).select("event_id", "day", "episodes"), rules)


def fbeta_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rounded(rows.groupBy("lang").agg(scoring.f_beta(F.col("quality") == 0, F.col("n_chars") > 2000).alias("f_beta")), f_beta=6)


def lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.lead_times(scoring.evaluate_events(_case(spark, sf_dir))), p25=4, p50=4, p75=4)


def ewm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reading(spark, sf_dir).select("turbine", "ts", "event_id", "wind")
    for span in (18, 72):
        rows = sequence.exponential_mean(rows, ["turbine"], ["ts", "event_id"], "wind", span)
    return rounded(rows.select("event_id", "wind_ewm18", "wind_ewm72"), wind_ewm18=6, wind_ewm72=6)


_NAMES = (
    qc_frozen, qc_bin_outlier, qc_summary_rollup, sensor_checks, quality_profile, downtime_union, merged_intervals, top_causes, last_event, significant_events, in_event_windows,
    cusum_warning, count_rule, trailing_any, episode_starts, criticality, event_scores, care_score_rollup, rule_grid, fbeta_labels, lead_times, ewm_features,
)
QUERIES = {f.__name__: f for f in _NAMES}

_ORDER = "order by ts, l_orderkey, l_linenumber, l_partkey, wind, power"
_FROZEN = f"""s0 as (select *, coalesce(wind = lag(wind) over w, false) as same from v_signal window w as (partition by turbine {_ORDER})),
s1 as (select *, same and coalesce(lag(same) over w, false) as ends from s0 window w as (partition by turbine {_ORDER})),
s2 as (select *, ends or coalesce(lead(ends, 1) over w, false) or coalesce(lead(ends, 2) over w, false) as frozen from s1 window w as (partition by turbine {_ORDER}))"""
_OUT = f"""b0 as (select *, case when power > {0.02 * RATED_KW}::double and power <= {0.95 * RATED_KW}::double then (ceil((power - {0.02 * RATED_KW}::double) / 100) - 1)::int end as bin from %s),
b1 as (select turbine, bin, median(wind) as m, stddev_samp(wind) as s from b0 where bin is not null group by 1, 2),
b2 as (select b0.*, coalesce(abs(wind - m) > 2 * s, false) as outlier from b0 left join b1 on b0.turbine = b1.turbine and b0.bin = b1.bin)"""
_SENSOR = """r as (select turbine % 10 as sensor, case when l_partkey % 97 > 0 then power end as value, ts < timestamp '1998-06-01' as ref,
  row_number() over (partition by turbine % 10 order by ts, l_orderkey, l_linenumber, l_partkey, power, turbine) as i from v_signal)"""
_DAYS = """d0 as (select turbine as event_id, floor(epoch(date_trunc('second', ts)) / 86400)::bigint as day, count_if(value > 60) as episodes, count(*) as monitored from v_reading group by 1, 2),
days as (select d0.*, (sum(episodes) over (partition by event_id) + 0.5::double) / sum(monitored) over (partition by event_id) / 2 as base_rate from d0)"""
_CASE = """c0 as (select turbine as event_id, value, power, row_number() over (partition by turbine order by ts, event_id) as id, count(*) over (partition by turbine) as n from v_reading),
cases as (select event_id, case when event_id % 2 = 0 then 'anomaly' else 'normal' end as label, id, (value > 30 or (event_id % 4 = 0 and id * 3 > n)) as flag, power > 40 as normal, ceil(n * 2 / 3)::bigint as start_id, n as end_id from c0),
crit as (select event_id, id, case when not normal then 0 when flag then 1 else 0 end::int as c from cases where id = 1
  union all select n.event_id, n.id, least(1000, greatest(0, crit.c + case when not n.normal then 0 when n.flag then 1 else -1 end))::int from crit join cases n on n.event_id = crit.event_id and n.id = crit.id + 1)"""
_FB = "coalesce(1.25::double * tp / nullif(1.25::double * tp + 0.25::double * fn + fp, 0), 0)"
_EVENTS = f"""e0 as (select *, id between start_id and end_id as inside, not normal or (id between start_id and end_id and label = 'anomaly') as truth from cases),
e1 as (select *, (row_number() over (partition by event_id, inside order by id) - 1)::double / nullif(count(*) over (partition by event_id, inside) - 1, 0) as x from e0),
e2 as (select event_id, label, end_id, count_if(normal and truth and flag) as tp, count_if(normal and not truth and flag) as fp, count_if(normal and truth and not flag) as fn,
  avg((truth = flag)::int::double) filter (normal) as accuracy, sum(case when inside and flag then case when coalesce(x, 0) <= 0.25 then 1 else (1 - x) / 0.75::double end end) as wf,
  sum(case when inside then case when coalesce(x, 0) <= 0.25 then 1 else (1 - x) / 0.75::double end end) as w, count_if(inside) as n_inside from e1 group by all),
e3 as (select event_id, max(c) as max_criticality, min(id) filter (c >= 72) as first_id from crit group by 1),
ev as (select event_id, label, max_criticality >= 72 as detected, max_criticality, case when label = 'anomaly' then {_FB} end as coverage, accuracy,
  case when label = 'anomaly' and n_inside > 0 then coalesce(wf / w, 0) end as earliness, case when label = 'anomaly' then first_id end as first_id, case when label = 'anomaly' then end_id - first_id end as lead_rows from e2 join e3 using (event_id))"""

ORACLES = {
    "qc_frozen": f"{ctes('v_signal')}, {_FROZEN} select turbine, count_if(frozen) as frozen, count(*) as n from s2 group by 1",
    "qc_bin_outlier": f"{ctes('v_signal')}, {_OUT % 'v_signal'} select turbine, l_orderkey, l_linenumber, l_partkey, wind, bin, outlier from b2",
    "qc_summary_rollup": f"""{ctes('v_signal')}, {_FROZEN}, {_OUT % 's2'}, f as (select *, power < {0.02 * RATED_KW}::double and wind >= 5 as stopped from b2)
select turbine, count(*) as n, round(avg(frozen::int::double), 6) as frozen_share, round(avg(stopped::int::double), 6) as stopped_share, round(avg(outlier::int::double), 6) as outlier_share, round(avg((frozen or stopped or outlier)::int::double), 6) as bad_share from f group by rollup (turbine)""",
    "sensor_checks": f"""{ctes('v_signal')}, {_SENSOR},
a as (select *, value - lag(value) over w as d from r window w as (partition by sensor order by i)),
b as (select *, coalesce(d = 0, false) as same, case when count(d) over l = 6 then stddev_samp(d) over l end as scatter from a window l as (partition by sensor order by i rows between 5 preceding and current row)),
c as (select *, sum((not same)::int) over w as g1, sum((not (same and ref))::int) over w as g2 from b window w as (partition by sensor order by i)),
e as (select *, case when same then count(*) over (partition by sensor, g1, same) else 0 end as run, case when same and ref then count(*) over (partition by sensor, g2, same and ref) else 0 end as ref_run from c),
f as (select *, case when ref_run > 0 and coalesce(lead(ref_run) over (partition by sensor order by i), 0) = 0 then ref_run end as run_end from e),
st as (select sensor, count(value) filter (ref) as n, quantile_cont(value, 0.001) filter (ref) as lo, quantile_cont(value, 0.999) filter (ref) as hi, coalesce(quantile_cont(run_end, 0.999), 0) as normal_run,
  count(d) filter (ref) as nd, quantile_cont(abs(d), 0.999) filter (ref) as dq, count(scatter) filter (ref) as ns, quantile_cont(scatter, 0.99) filter (ref) as sq from f group by 1),
cm as (select sensor, value, count(*) as k from f where ref and value is not null group by 1, 2),
g as (select f.*, st.* exclude (sensor), k, run >= greatest(5, ceil(3 * normal_run)) as long, coalesce(abs(d) > 3 * greatest(dq, 1e-6) and nd > 100, false) as big from f join st using (sensor) left join cm using (sensor, value)),
h as (select *, value is null as gap, n >= 100 and (long or coalesce(lead(long) over w, false)) and not coalesce(k > 0.01 * n, false) as stale,
  n >= 100 and coalesce(value < lo - 2 * greatest(hi - lo, 1e-6) or value > hi + 2 * greatest(hi - lo, 1e-6), false) as out_of_range,
  n >= 100 and (big or coalesce(lead(big) over w, false)) as step, n >= 100 and coalesce(scatter > 4 * greatest(sq, 1e-6) and ns > 100, false) as erratic from g window w as (partition by sensor order by i))
select sensor, count_if(gap) as gap, count_if(stale) as stale, count_if(out_of_range) as out_of_range, count_if(step) as step, count_if(erratic) as erratic, count_if(gap or stale or out_of_range or step or erratic) as bad from h group by 1""",
    "quality_profile": f"""{ctes('v_signal')}, {_SENSOR}, m as (select sensor, median(value) as m from r group by 1),
a as (select r.*, abs(value - m) as a, coalesce(value = lag(value, 1) over w and value = lag(value, 2) over w, false) as stuck from r join m using (sensor) window w as (partition by sensor order by i)),
d as (select sensor, median(a) as mad from a group by 1)
select sensor, count(*) as n, count_if(value is null) as missing, count_if(value < 0) as negative, count_if(coalesce(0.6745 * a / nullif(mad, 0) > 10, false)) as far, count_if(stuck) as stuck from a join d using (sensor) group by 1""",
    "downtime_union": "__DOWN select turbine, round(sum(e - s) / 3600, 6) as hours, sum(n)::bigint as events, count(*) as outages from u group by 1",
    "merged_intervals": "__DOWN select turbine, s as start_s, e as end_s, n as events from u",
    "top_causes": f"{ctes('v_interval')}, c as (select turbine, message, count(*) as n, sum((end_s - start_s) / 3600) as hours, max((end_s - start_s) / 3600) as longest from v_interval group by 1, 2), k as (select *, row_number() over (partition by turbine order by hours desc, message) as position from c) select turbine, message, n, round(hours, 6) as hours, round(longest, 6) as longest, position from k where position <= 3",
    "last_event": f"{ctes('v_interval')}, k as (select *, row_number() over (partition by turbine order by start_s desc, event_id desc) as k from v_interval) select turbine, start_s, event_id, end_s, message from k where k = 1",
    "significant_events": f"{ctes('v_interval')} select *, end_s - start_s as duration_s from v_interval where message in ('error', 'purchase') and end_s - start_s >= 3600 order by duration_s desc, event_id limit 60",
    "in_event_windows": f"{ctes('v_interval')} select a.turbine, a.event_id, b.event_id as window_id from v_interval a join v_interval b on a.turbine = b.turbine and a.start_s between b.start_s and b.end_s + 86400 where b.message = 'error'",
    "cusum_warning": f"{ctes('v_reading')}, {_DAYS}, i as (select event_id, day, sum(episodes * ln(2::double) - base_rate * monitored) over (partition by event_id order by day) as c from days), s as (select event_id, day, c - least(0, min(c) over (partition by event_id order by day)) as cusum from i) select event_id, day, round(cusum, 6) as cusum, cusum >= ln(9::double) as warn from s",
    "count_rule": f"{ctes('v_reading')}, {_DAYS} select event_id, day, episodes >= 2 as alert, episodes >= 2 and coalesce(bool_or(episodes >= 2) over (partition by event_id order by day rows between 2 preceding and 1 preceding), false) as warn from days",
    "trailing_any": f"{ctes('v_reading')}, {_DAYS} select event_id, day, episodes >= 2 as alert, bool_or(episodes >= 2) over (partition by event_id order by day rows between 2 preceding and current row) as recent from days",
    "episode_starts": f"""{ctes('v_signal')}, a as (select *, wind > 9 as m, row_number() over (partition by turbine {_ORDER}) as i from v_signal), b as (select *, sum((not m)::int) over (partition by turbine order by i) as g from a),
c as (select *, m and count(*) over (partition by turbine, g, m) >= 3 as ep from b), d as (select *, ep and not coalesce(lag(ep) over (partition by turbine order by i), false) as st from c) select turbine, count_if(ep) as rows_in, count_if(st) as starts from d group by 1""",
    "criticality": f"{ctes('v_reading')}, {_CASE} select event_id, id::int as id, c as criticality from crit",
    "event_scores": f"{ctes('v_reading')}, {_CASE}, {_EVENTS} select event_id, label, detected, max_criticality, round(coverage, 6) as coverage, round(accuracy, 6) as accuracy, round(earliness, 6) as earliness, first_id, lead_rows from ev",
    "care_score_rollup": f"""{ctes('v_reading')}, {_CASE}, {_EVENTS}, g as (select floor(event_id / 50)::bigint as farm, avg(coverage) filter (label = 'anomaly') as coverage, avg(accuracy) filter (label <> 'anomaly') as accuracy, avg(earliness) filter (label = 'anomaly') as earliness,
  count_if(label = 'anomaly') as anomaly_events, count_if(label <> 'anomaly') as normal_events, count_if(label = 'anomaly' and detected) as anomalies_detected, count_if(label <> 'anomaly' and detected) as false_alarms, count_if(label = 'anomaly' and not detected) as missed from ev group by rollup (floor(event_id / 50)::bigint)),
h as (select *, coalesce(1.25::double * anomalies_detected / nullif(1.25::double * anomalies_detected + 0.25::double * missed + false_alarms, 0), 0) as reliability from g)
select farm, round(coverage, 6) as coverage, round(accuracy, 6) as accuracy, round(reliability, 6) as reliability, round(earliness, 6) as earliness, anomaly_events, normal_events, anomalies_detected, false_alarms,
round(case when anomaly_events > 0 and normal_events > 0 then case when anomalies_detected + false_alarms = 0 then 0 when accuracy <= 0.5 then accuracy else (coverage + 2 * accuracy + reliability + earliness) / 5 end end, 6) as care from h""",
    "rule_grid": f"""{ctes('v_reading')}, {_DAYS}, rules as (select row_number() over (order by e, p) - 1 as rule_id, e, p from (values (1), (2), (3)) a(e), (values (1), (2)) b(p)),
a as (select rule_id::int as rule_id, event_id, day, p, episodes >= e as alert, bool_or(episodes >= e) over (partition by rule_id, event_id order by day rows between 2 preceding and 1 preceding) as before from days, rules)
select rule_id, count_if(alert) as alerts, count_if(alert and (p = 1 or coalesce(before, false))) as warnings, count(distinct event_id) filter (alert and (p = 1 or coalesce(before, false))) as events_warned from a group by 1""",
    "fbeta_labels": f"with l as (select lang, count_if(quality = 0 and n_chars > 2000) as tp, count_if(quality <> 0 and n_chars > 2000) as fp, count_if(quality = 0 and not n_chars > 2000) as fn from labels join documents using (doc_id) group by 1) select lang, round({_FB}, 6) as f_beta from l",
    "ewm_features": f"""{ctes('v_reading')}, o as (select *, row_number() over (partition by turbine order by ts, event_id) as i from v_reading),
s as (select turbine, event_id, i, wind::double as a, wind::double as b, 1.0::double as da, 1.0::double as db, 1 as n from o where i = 1
  union all select x.turbine, x.event_id, x.i, s.a * (1 - 2.0::double / 19) + x.wind, s.b * (1 - 2.0::double / 73) + x.wind, s.da * (1 - 2.0::double / 19) + 1, s.db * (1 - 2.0::double / 73) + 1, s.n + 1 from s join o x on x.turbine = s.turbine and x.i = s.i + 1)
select event_id, case when n >= 6 then round(a / da, 6) end as wind_ewm18, case when n >= 24 then round(b / db, 6) end as wind_ewm72 from s""",
    "lead_times": f"{ctes('v_reading')}, {_CASE}, {_EVENTS} select count(*) as n, round(quantile_cont(lead_rows, 0.25), 4) as p25, round(quantile_cont(lead_rows, 0.5), 4) as p50, round(quantile_cont(lead_rows, 0.75), 4) as p75 from ev where lead_rows is not null",
}
_DOWN = f"""{ctes('v_interval')}, a as (select *, max(end_s) over (partition by turbine order by start_s, end_s rows between unbounded preceding and 1 preceding) as seen from v_interval),
b as (select *, sum((coalesce(start_s > seen, true))::int) over (partition by turbine order by start_s, end_s rows between unbounded preceding and current row) as island from a),
u as (select turbine, island, min(start_s) as s, max(end_s) as e, count(*) as n from b group by 1, 2)"""
ORACLES = {k: v.replace("__DOWN", _DOWN) for k, v in ORACLES.items()}

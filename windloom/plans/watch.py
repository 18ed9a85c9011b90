"""Sensor watch queries: users stand for cases, event types for their sensors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators import causes, sequence, watch
from windloom.plans import forecasts
from windloom.plans.relational import rounded
from windloom.plans.views import ctes, reading
from windloom.session import stored, table

#: The grid of alert rules: 24 sums and 16 counts.  Quantiles stand for the two episode limits of the projection.
QUANTILES = (0.99, 0.999)
GRID = [("cusum", q, f, a, 0.1, 0, 0, m) for q, f, a, m in product(QUANTILES, (2.0, 4.0), (0.01, 0.001, 0.0001), (1, 2))]
GRID += [("count", q, 1.0, 0.1, 0.1, e, p, m) for q, e, p, m in product(QUANTILES, (2, 3), (1, 2), (1, 2))]
RULES = [(k, *r) for k, r in enumerate(GRID)]
RULE_SCHEMA = "rule_id int, method string, quantile double, factor double, alpha double, beta double, least int, persist int, min_sensors int"
MAIN_RULE = 2  # a sum at the lower quantile


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of (case, sensor) before the case's end, its last event: readings over the limit are episodes."""
    rows = reading(spark, sf_dir).withColumnsRenamed({"event_id": "reading_id", "turbine": "event_id", "event_type": "sensor"})
    end = rows.groupBy("event_id").agg(F.max("ts").alias("end"))
    rows = rows.join(end, "event_id").withColumn("day", watch.day_of(F.col("ts"), F.col("end")))
    limits = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(x).alias("limit")) for q, x in zip(QUANTILES, (30.0, 60.0), strict=True)]))
    days = rows.select("event_id", "sensor", "day", "value", limits.alias("l")).groupBy("event_id", "sensor", "day", "l.quantile")
    days = days.agg(F.count_if(F.col("value") > F.col("l.limit")).alias("episodes"), F.count(F.lit(1)).alias("monitored"))
    rate = days.groupBy("event_id", "sensor", "quantile").agg(((F.sum("episodes") + 0.5) / F.sum("monitored") / 12).alias("base_rate"))
    component = F.when(F.col("sensor").isin("view", "click"), "gearbox oil").when(F.col("sensor") == "error", "pitch system").otherwise("other")
    return days.join(rate, ["event_id", "sensor", "quantile"]).withColumn("component", component)


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases of four farms; every second one a fault, its cause from the customer's segment."""
    rows = _days(spark, sf_dir).where(f"quantile = {QUANTILES[0]}").groupBy("event_id").agg(F.countDistinct("day").alias("monitored_days"))
    cause = F.when(F.col("event_id") % 6 == 0, "gearbox bearing damage").when(F.col("event_id") % 6 == 2, "Pitch battery fault").when(F.col("event_id") % 12 == 4, "")
    label = F.when(F.col("event_id") % 2 == 0, "anomaly").otherwise("normal")
    return rows.select("event_id", (F.col("event_id") % 4).alias("farm"), label.alias("label"), cause.alias("description"), "monitored_days")


def _alarms(spark: SparkSession, sf_dir: str, only: int | None = None) -> DataFrame:
    rules = _rules(spark) if only is None else _rules(spark).where(F.col("rule_id") == only)
    # Days lie together by case before they meet the rules: windows and sums by rule and case need no further shuffle.  A number is given,
    # as the few bytes of the days would else be put into few tasks.
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return watch.component_days(watch.warnings(_days(spark, sf_dir).repartition(n, "event_id"), rules), ["rule_id", "event_id"])


def _results(spark: SparkSession, sf_dir: str, only: int | None = None) -> DataFrame:
    rules = _rules(spark).select("rule_id") if only is None else _rules(spark).where(F.col("rule_id") == only).select("rule_id")
    cases = _cases(spark, sf_dir).withColumn("rule_id", F.explode(F.array(*[F.lit(r["rule_id"]) for r in rules.collect()])))
    return watch.outcomes(cases, _alarms(spark, sf_dir, only), ["rule_id", "event_id"])


def watch_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per case, sensor and day, 0 on days without."""
    rows = reading(spark, sf_dir).withColumn("day", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400))
    return rounded(watch.per_day(rows, ["turbine", "event_type"], "day", "value"), total=4)


def watch_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("turbine").orderBy("ts", "event_id")
    rows = reading(spark, sf_dir).withColumn("i", F.row_number().over(w) - 1)
    return rounded(watch.chart(rows, ["turbine"], "i", "value", 10), mean=6)


def peer_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.top_peers(forecasts.correlation_pairs(spark, sf_dir), 3)


def watch_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warning days and cases of all forty rules, before components are looked at."""
    out = watch.warnings(_days(spark, sf_dir), _rules(spark)).where("warn")
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("warnings"), F.countDistinct("event_id").alias("cases"))


def watch_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(watch.sensitivity(_results(spark, sf_dir)), false_days_a_month=6)


def watch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.summary(_results(spark, sf_dir, MAIN_RULE))


def cases_by_subsystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = watch.with_causes(_cases(spark, sf_dir), _results(spark, sf_dir, MAIN_RULE))
    out = watch.by_subsystem(cases.withColumn("detected", F.col("watch_alarm")))
    return out.withColumns({c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in ("caught_ids", "missed_ids")})


def cases_by_farm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = watch.with_causes(_cases(spark, sf_dir), _results(spark, sf_dir, MAIN_RULE))
    out = watch.by_farm(cases.withColumn("detected", F.col("watch_alarm")))
    return out.withColumn("false_ids", F.concat_ws(",", F.transform("false_ids", lambda x: x.cast("string"))))


def diagnosed_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component that the watch points at against the operator's cause, fault cases only."""
    cases = watch.with_causes(_cases(spark, sf_dir), _results(spark, sf_dir, MAIN_RULE)).where("label = 'anomaly'")
    found = watch.diagnosis(_alarms(spark, sf_dir, MAIN_RULE), ["event_id"])
    out = cases.join(found, "event_id", "left")
    return out.select("event_id", "subsystem", "diagnosis", "watch_lead_days", watch.agrees(F.col("diagnosis"), F.col("subsystem")).alias("agrees"))


def warned_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = watch.warnings(_days(spark, sf_dir), _rules(spark).where(F.col("rule_id") == MAIN_RULE))
    out = watch.warned_sensors(days, ["event_id"], 2)
    listed = F.transform("sensors", lambda x: F.concat_ws(":", x["sensor"], x["days"].cast("string"), x["first_day"].cast("string")))
    return out.select("event_id", "warned", F.concat_ws(",", listed).alias("sensors"))


def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = watch.warnings(_days(spark, sf_dir), _rules(spark).where(F.col("rule_id") == MAIN_RULE)).join(_cases(spark, sf_dir).select("event_id", "label"), "event_id")
    return rounded(watch.escalation(days), share=6)


def hourly_case_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy("ts", "reading_id")
    rows = reading(spark, sf_dir).withColumnsRenamed({"event_id": "reading_id", "turbine": "event_id"}).withColumn("id", F.row_number().over(w))
    rows = rows.select("event_id", "id", F.max("id").over(Window.partitionBy("event_id")).alias("end_id"), (F.col("value") / 50).alias("score"), (F.col("value") > 30).alias("flag"), (F.col("power") > 40).alias("normal"))
    return rounded(watch.hourly_series(sequence.criticality(rows, ["event_id"], ["id"], "flag", "normal")), score=6)


def error_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two event types with most of each user's squared distance from the type's mean."""
    rows = reading(spark, sf_dir).select(F.col("turbine").alias("event_id"), F.col("event_type").alias("sensor"), "value")
    mean = rows.groupBy("sensor").agg(F.avg("value").alias("m"))
    out = rows.join(mean, "sensor").withColumn("error", F.pow(F.col("value") - F.col("m"), F.lit(2.0)))
    return rounded(watch.error_shares(out, ["event_id"], 2), share_pct=6)


def eligible_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors with few gaps and some variation."""
    from windloom.operators.qc import eligible_sensors as eligible

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sensor"), F.when(F.col("l_partkey") % F.lit(7) > F.col("l_suppkey") % F.lit(4) - 1, F.col("l_quantity")).alias("value"))
    return rounded(eligible(rows, ["sensor"]), missing=6, spread=6)


def sensor_fault_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty and doubtful sensor days: warnings of the main rule against the peers of each sensor."""
    days = watch.warnings(_days(spark, sf_dir), _rules(spark).where(F.col("rule_id") == MAIN_RULE)).select("event_id", "sensor", "day", "warn", F.try_divide("episodes", "monitored").alias("bad_share"))
    peers = watch.top_peers(forecasts.correlation_pairs(spark, sf_dir), 2).select("sensor", "peer", (1 - F.col("position") / 100).alias("r"))
    peers = days.select("event_id", "sensor").distinct().join(peers, "sensor").select("event_id", "sensor", "peer", "r")
    return sequence.sensor_faults(days, peers, most_bad=0.9).groupBy("sensor").agg(F.count_if("fault").alias("faults"), F.count_if("check").alias("checks"), F.count(F.lit(1)).alias("days"))


def _causes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event types as cases of three sensors; days of the month to the 18th for the fit, to the 24th for thresholds."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("event_id"), "ts", F.col("event_id").alias("id"), (F.col("value") / 10).alias("wind"), (k * 20.5).alias("power"),
        (k * 3.6 + F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 100).alias("bearing"), F.dayofmonth("ts").alias("day"),
    )
    order, targets = ["ts", "id"], ["wind", "power", "bearing"]
    made, inputs = causes.design(rows, "event_id", order, ["wind", "power"], ["wind"])
    made = stored(made, "design")
    fitted = stored(causes.fit(made, "event_id", inputs, targets, F.col("day") <= 18), "causes")
    res = stored(causes.residuals(made, "event_id", order, inputs, targets, fitted, ["day"]), "residuals")
    return res, causes.thresholds(res, "event_id", F.col("day").between(19, 24))


def cause_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cause models of all sensors reach on rows after their fit, and the thresholds at three quantiles."""
    return rounded(_causes(spark, sf_dir)[1], threshold=6, r2=6)


def cause_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the watched sensors under all rules of their quantiles, with warnings."""
    res, limits = _causes(spark, sf_dir)
    calibration = F.col("day").between(19, 24)
    days = causes.episode_days(res, "event_id", ["ts", "id"], F.col("day"), limits, calibration, F.col("day") > 24)
    out = watch.warnings(days, _rules(spark))
    return out.select("rule_id", "event_id", "sensor", "quantile", "day", "episodes", "monitored", F.round("base_rate", 8).alias("base_rate"), "warn")


_NAMES = (
    watch_days, watch_chart, peer_sensors, watch_warnings, watch_sensitivity, watch_summary, cases_by_subsystem, cases_by_farm, diagnosed_causes, warned_sensors, escalation,
    hourly_case_series, error_shares, eligible_sensors, sensor_fault_days, cause_thresholds, cause_warnings,
)
QUERIES = {f.__name__: f for f in _NAMES}

_GRID = "rules(rule_id, method, quantile, factor, alpha, beta, least, persist, min_sensors) as (values " + ", ".join(f"({k}, '{m}', {q}::double, {f}::double, {a}::double, {b}::double, {e}, {p}, {n})" for k, m, q, f, a, b, e, p, n in RULES) + ")"
_WATCH = f"""{_GRID}, en as (select turbine as event_id, max(ts) as t from v_reading group by 1),
wr as (select turbine as event_id, event_type as sensor, floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', t))) / 86400)::bigint as day, value from v_reading join en on en.event_id = turbine),
d0 as (select event_id, sensor, day, q as quantile, count_if(value > lim) as episodes, count(*) as monitored from wr, (values (0.99::double, 30), (0.999::double, 60)) l(q, lim) group by all),
dd as (select *, (sum(episodes) over p + 0.5::double) / sum(monitored) over p / 12 as base_rate, case when sensor in ('view', 'click') then 'gearbox oil' when sensor = 'error' then 'pitch system' else 'other' end as component from d0 window p as (partition by event_id, sensor, quantile)),
t0 as (select dd.*, r.* exclude (quantile), sum(episodes * ln(factor) - (factor - 1) * base_rate * monitored) over w as c, row_number() over w as n, episodes >= least as alert from dd join rules r on r.quantile = dd.quantile %s window w as (partition by rule_id, event_id, sensor order by day)),
t1 as (select *, min(c) over w as low, max(case when alert then n end) over (partition by rule_id, event_id, sensor order by day rows between unbounded preceding and 1 preceding) as last from t0 window w as (partition by rule_id, event_id, sensor order by day)),
ww as (select *, case when method = 'cusum' then c - least(0, low) >= ln((1 - beta) / alpha) else alert and (persist <= 1 or coalesce(n - last <= persist, false)) end as warn from t1)"""
_COMPONENT = """w2 as (select *, bool_or(warn) over (partition by rule_id, event_id, sensor order by day range between 2 preceding and current row) as recent from ww),
mb as (select rule_id, event_id, component, count(distinct sensor) as members from ww group by all),
cd as (select rule_id, event_id, component, day, min_sensors, count_if(recent) as on_, bool_or(warn) as today, count_if(warn) as sensors from w2 group by all),
al as (select cd.* from cd join mb using (rule_id, event_id, component) where today and on_ >= least(min_sensors, members)),
cs as (select event_id, event_id % 4 as farm, case when event_id % 2 = 0 then 'anomaly' else 'normal' end as label, case when event_id % 6 = 0 then 'gearbox bearing damage' when event_id % 6 = 2 then 'Pitch battery fault' when event_id % 12 = 4 then '' end as description, count(distinct day) as monitored_days from d0 where quantile = 0.99 group by 1),
fa as (select rule_id, event_id, min(day) as first_alarm_day, count(distinct day) as alarm_days from al group by all),
rs as (select cs.*, r.rule_id, first_alarm_day, coalesce(alarm_days, 0) as alarm_days from cs join rules r on true __ONLY__ left join fa on fa.event_id = cs.event_id and fa.rule_id = r.rule_id)"""
_SUMS = "count_if(label = 'anomaly') as faults, count_if(label = 'anomaly' and first_alarm_day is not null) as faults_alarmed, count_if(label = 'normal') as normal_cases, count_if(label = 'normal' and first_alarm_day is not null) as normal_with_alarm, coalesce(sum(monitored_days) filter (label = 'normal'), 0)::bigint as normal_monitored_days, coalesce(sum(alarm_days) filter (label = 'normal'), 0)::bigint as normal_alarm_days"
_ONE = f"where r.rule_id = {MAIN_RULE}"
_MAIN = f"{ctes('v_reading')}, {_WATCH % _ONE}"
_MAIN_CASES = f"{_MAIN}, {_COMPONENT.replace('__ONLY__', f'and r.rule_id = {MAIN_RULE}')}, sc as (select *, first_alarm_day is not null as hit, case when length(description) > 0 then case when contains(description, 'gear') then 'gearbox' else 'pitch system' end end as subsystem from rs)"
_PEERS = "pe as (select sensor, peer, r, row_number() over (partition by sensor order by abs(r) desc, peer) as position from (select sensor, peer, r from cp union all select peer, sensor, r from cp))"
_PAIRS = forecasts.ORACLES["correlation_pairs"]
_PAIR_TABLE = f"cp as ({_PAIRS[_PAIRS.index('select a.sensor'):]})"
_PAIR_CTES = _PAIRS[: _PAIRS.index("select a.sensor")].rstrip()

ORACLES = {
    "watch_days": f"""{ctes('v_reading')}, c as (select turbine, event_type, floor(epoch(date_trunc('second', ts)) / 86400)::bigint as day, count(*) as n, sum(value) as total from v_reading group by all),
s as (select turbine, event_type, unnest(generate_series(min(day), max(day))) as day from c group by 1, 2) select s.*, coalesce(n, 0) as n, round(coalesce(total, 0), 4) as total from s left join c using (turbine, event_type, day)""",
    "watch_chart": f"{ctes('v_reading')}, o as (select turbine, value, row_number() over (partition by turbine order by ts, event_id) - 1 as i from v_reading) select turbine, floor((i - 10) / 36)::bigint as bucket, round(avg(value), 6) as mean, count(value) as n from o where i >= 10 group by 1, 2",
    "peer_sensors": f"{_PAIR_CTES}, {_PAIR_TABLE}, {_PEERS} select * from pe where position <= 3",
    "watch_warnings": f"{ctes('v_reading')}, {_WATCH % ''} select rule_id, count(*) as warnings, count(distinct event_id) as cases from ww where warn group by 1",
    "watch_sensitivity": f"{ctes('v_reading')}, {_WATCH % ''}, {_COMPONENT.replace('__ONLY__', '')}, x as (select rule_id, {_SUMS} from rs group by 1) select *, round(30 * normal_alarm_days / greatest(normal_monitored_days, 1), 6) as false_days_a_month from x",
    "watch_summary": f"{_MAIN_CASES} select farm, {_SUMS} from rs group by rollup (farm)",
    "cases_by_subsystem": f"{_MAIN_CASES} select coalesce(subsystem, 'unspecified') as subsystem, count(*) as faults, count_if(hit) as caught, coalesce(string_agg(case when hit then event_id::varchar end, ',' order by event_id), '') as caught_ids, coalesce(string_agg(case when not hit then event_id::varchar end, ',' order by event_id), '') as missed_ids from sc where label = 'anomaly' group by 1",
    "cases_by_farm": f"{_MAIN_CASES} select farm, count_if(label = 'anomaly') as faults, count_if(label = 'anomaly' and hit) as caught, count_if(label = 'normal') as normal_cases, count_if(label = 'normal' and hit) as false_alarms, coalesce(string_agg(case when hit and label = 'normal' then event_id::varchar end, ',' order by event_id), '') as false_ids from sc group by 1",
    "diagnosed_causes": f"""{_MAIN_CASES}, dg as (select event_id, component, sum(sensors) as n, min(day) as first_day from al group by all), dk as (select *, row_number() over (partition by event_id order by n desc, first_day, component) as k from dg)
select sc.event_id, subsystem, component as diagnosis, -first_alarm_day as watch_lead_days, case when subsystem is not null and subsystem <> 'other' and component is not null then split_part(component, ' ', 1) = split_part(subsystem, ' ', 1) end as agrees from sc left join dk on dk.event_id = sc.event_id and k = 1 where label = 'anomaly'""",
    "warned_sensors": f"""{_MAIN}, o as (select event_id, sensor, count(*) as days, min(day) as first_day from ww where warn group by 1, 2), k as (select *, row_number() over (partition by event_id order by days desc, first_day, sensor) as k, count(*) over (partition by event_id) as warned from o)
select event_id, warned, string_agg(sensor || ':' || days || ':' || first_day, ',' order by k) as sensors from k where k <= 2 group by 1, 2""",
    "escalation": f"{_MAIN}, sh as (select event_id, case when event_id % 2 = 0 then 'anomaly' else 'normal' end as label, day, avg(warn::int::double) as share from ww where day between -90 and -1 group by all) select label, day, round(avg(share), 6) as share, count(*) as cases from sh group by 1, 2",
    "hourly_case_series": f"""{ctes('v_reading')}, o as (select turbine as event_id, value, power, row_number() over (partition by turbine order by ts, event_id) as id, count(*) over (partition by turbine) as end_id from v_reading),
s as (select event_id, id, case when power > 40 and value > 30 then 1 else 0 end::int as c from o where id = 1 union all select n.event_id, n.id, least(1000, greatest(0, s.c + case when not coalesce(n.power > 40, false) then 0 when n.value > 30 then 1 else -1 end))::int from s join o n on n.event_id = s.event_id and n.id = s.id + 1)
select event_id, floor((id - end_id) / 6)::bigint as hour, round(avg(value / 50), 6) as score, max(c) as criticality from o join s using (event_id, id) group by 1, 2""",
    "error_shares": f"""{ctes('v_reading')}, e as (select turbine as event_id, event_type as sensor, avg((value - m) ** 2) as e from v_reading join (select event_type, avg(value) as m from v_reading group by 1) using (event_type) group by 1, 2),
k as (select *, 100 * e / nullif(sum(e) over (partition by event_id), 0) as share_pct, row_number() over (partition by event_id order by e desc, sensor) as position from e) select event_id, sensor, round(share_pct, 6) as share_pct, position from k where position <= 2""",
    "eligible_sensors": "with v as (select l_suppkey as sensor, case when l_partkey % 7 > l_suppkey % 4 - 1 then l_quantity end as value from lineitem), s as (select sensor, avg((value is null)::int::double) as missing, stddev_pop(value) as spread from v group by 1) select sensor, round(missing, 6) as missing, round(spread, 6) as spread from s where missing <= 0.2 and spread > 1e-6",
    "sensor_fault_days": f"""{_MAIN}, {_PAIR_CTES[_PAIR_CTES.index('r as ('):]}, {_PAIR_TABLE}, {_PEERS}, pr as (select sensor, peer, 1 - position / 100::double as r from pe where position <= 2),
dy as (select event_id, sensor, day, warn, episodes / monitored as bad from ww),
st as (select a.event_id, a.sensor, a.day, count_if(pr.r > 0.98) as twins, count_if(pr.r > 0.98 and b.warn) as tw, avg(b.warn::int::double) as share from dy a join pr on pr.sensor = a.sensor join dy b on b.event_id = a.event_id and b.sensor = pr.peer and b.day = a.day group by all),
f as (select dy.*, bad > 0.9 or (warn and coalesce(twins, 0) > 0 and coalesce(tw, 0) = 0) as fault, share from dy left join st using (event_id, sensor, day))
select sensor, count_if(fault) as faults, count_if(warn and coalesce(share < 0.5, false) and not fault) as checks, count(*) as days from f group by 1""",
}

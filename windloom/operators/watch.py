"""Sensor watch: daily counts, peers, alert rules, component alarms and case rollups.

Everything is keyed by case and sensor; a rule table of some dozens of rows meets the days by an equi-join on the threshold's
quantile, so rows grow with the rules that use it and never with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.functions.text import subsystem

#: Days for which a warning stays recent; rows of a chart bucket; peers of a sensor; rules at most.
RECENT_DAYS, CHART_ROWS, PEERS, MAX_RULES = 3, 36, 5, 1000


def day_of(ts: Column, end: Column) -> Column:
    """Whole days from the event's end, negative before it."""
    return F.floor((F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(end.cast("timestamp"))) / 86400)


def per_day(rows: DataFrame, groups: list[str], day: str, weight: str | None = None) -> DataFrame:
    """Rows (and the sum of ``weight``) of every day between a group's first and last, 0 where there are none."""
    bounds = rows.groupBy(*groups).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    spine = bounds.select(*groups, F.explode(F.sequence("__lo", "__hi")).alias(day))
    sums = rows.groupBy(*groups, day).agg(F.count(F.lit(1)).alias("n"), *([F.sum(weight).alias("total")] if weight else []))
    return spine.join(sums, [*groups, day], "left").na.fill(0, ["n", *(["total"] if weight else [])])


def chart(rows: DataFrame, groups: list[str], place: str, value: str, start: int = 0, width: int = CHART_ROWS) -> DataFrame:
    """Mean of ``value`` over buckets of ``width`` rows from ``start`` on."""
    own = rows.where(F.col(place) >= start).withColumn("bucket", F.floor((F.col(place) - start) / width))
    return own.groupBy(*groups, "bucket").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def top_peers(pairs: DataFrame, k: int = PEERS) -> DataFrame:
    """The k most correlated others of each sensor of ``pairs(sensor, peer, r)``, which holds each pair once."""
    both = pairs.select("sensor", "peer", "r").unionByName(pairs.select(F.col("peer").alias("sensor"), F.col("sensor").alias("peer"), "r"))
    w = Window.partitionBy("sensor").orderBy(F.desc(F.abs("r")), "peer")
    return both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def checked_rules(rules: DataFrame) -> DataFrame:
    """The rules, an error if there are more than ``MAX_RULES``: they are a stated list, not data."""
    n = rules.limit(MAX_RULES + 1).count()
    if n > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return F.broadcast(rules)


def warnings(days: DataFrame, rules: DataFrame) -> DataFrame:
    """``days(event_id, sensor, quantile, day, episodes, monitored, base_rate, ...)`` under every rule of its quantile, with
    ``warn``.  ``rules(rule_id, quantile, method, factor, alpha, beta, least, persist)``: method ``cusum`` is Page's sum
    against the sensor's own rate with Wald's boundary, ``count`` an alert with another one in the days before."""
    tried = days.join(checked_rules(rules), "quantile")
    w = Window.partitionBy("rule_id", "event_id", "sensor").orderBy("day")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("episodes") * F.log("factor") - (F.col("factor") - 1) * F.col("base_rate") * F.col("monitored")
    tried = tried.withColumns({"__c": F.sum(step).over(upto), "__n": F.row_number().over(w), "__alert": F.col("episodes") >= F.col("least")})
    tried = tried.withColumns({"__low": F.min("__c").over(upto), "__last": F.max(F.when(F.col("__alert"), F.col("__n"))).over(before)})
    by_sum = F.col("__c") - F.least(F.lit(0.0), F.col("__low")) >= F.log((1 - F.col("beta")) / F.col("alpha"))
    by_count = F.col("__alert") & ((F.col("persist") <= 1) | F.coalesce(F.col("__n") - F.col("__last") <= F.col("persist"), F.lit(False)))
    return tried.withColumn("warn", F.when(F.col("method") == "cusum", by_sum).otherwise(by_count)).drop("__c", "__low", "__n", "__last", "__alert")


def component_days(warned: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, component, day, sensors)`` on alarm: a member warns today, and ``min_sensors`` of them (no more than there are)
    did within the recent days.  ``warned(keys, sensor, component, day, warn, min_sensors)`` has whole days of every member."""
    w = Window.partitionBy(*keys, "sensor").orderBy("day").rangeBetween(-(RECENT_DAYS - 1), 0)
    first = F.row_number().over(Window.partitionBy(*keys, "sensor").orderBy("day")) == 1
    out = warned.withColumns({"__recent": F.bool_or("warn").over(w), "__first": first}).groupBy(*keys, "component", "day", "min_sensors")
    out = out.agg(F.count_if("__recent").alias("__on"), F.bool_or("warn").alias("__today"), F.count_if("warn").alias("sensors"), F.count_if("__first").alias("__new"))
    # Each member has one first day: the rows are not made twice to count them.
    out = out.withColumn("__members", F.sum("__new").over(Window.partitionBy(*keys, "component")))
    return out.where(F.col("__today") & (F.col("__on") >= F.least("min_sensors", "__members"))).select(*keys, "component", "day", "sensors")


def outcomes(cases: DataFrame, alarms: DataFrame, keys: list[str]) -> DataFrame:
    """``cases`` with their ``first_alarm_day`` and ``alarm_days`` (NULL and 0 without an alarm); ``alarms(keys, day, ..)``."""
    sums = alarms.groupBy(*keys).agg(F.min("day").alias("first_alarm_day"), F.countDistinct("day").alias("alarm_days"))
    return cases.join(sums, keys, "left").na.fill(0, ["alarm_days"])


def summary(results: DataFrame, groups: list[str] | None = None, by: str | None = "farm") -> DataFrame:
    """Faults, faults with an alarm, normal cases, those with one, and their days, per ``by`` and over all (NULL)."""
    fault, normal, alarmed = F.col("label") == "anomaly", F.col("label") == "normal", F.col("first_alarm_day").isNotNull()
    made = [
        F.count_if(fault).alias("faults"), F.count_if(fault & alarmed).alias("faults_alarmed"), F.count_if(normal).alias("normal_cases"),
        F.count_if(normal & alarmed).alias("normal_with_alarm"), F.coalesce(F.sum(F.when(normal, F.col("monitored_days"))), F.lit(0)).alias("normal_monitored_days"),
        F.coalesce(F.sum(F.when(normal, F.col("alarm_days"))), F.lit(0)).alias("normal_alarm_days"),
    ]
    return (results.rollup(by) if by else results.groupBy(*(groups or []))).agg(*made)


def sensitivity(results: DataFrame) -> DataFrame:
    """``summary`` of each rule with false alarm days per turbine and month."""
    out = summary(results, ["rule_id"], None)
    return out.withColumn("false_days_a_month", 30 * F.col("normal_alarm_days") / F.greatest("normal_monitored_days", F.lit(1)))


def with_causes(cases: DataFrame, seen: DataFrame) -> DataFrame:
    """Cases with the subsystem of the operator's cause and the watch's outcome (NULL where a case wasn't watched)."""
    known = seen.select("event_id", F.col("first_alarm_day").isNotNull().alias("watch_alarm"), (-F.col("first_alarm_day")).alias("watch_lead_days"))
    return cases.join(known, "event_id", "left").withColumn("subsystem", subsystem(F.col("description")))


def by_subsystem(cases: DataFrame) -> DataFrame:
    """Fault cases per subsystem: how many, caught and missed, with their ids in order."""
    faults = cases.where("label = 'anomaly'").groupBy(F.coalesce("subsystem", F.lit("unspecified")).alias("subsystem"))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("event_id"))))
    return faults.agg(F.count(F.lit(1)).alias("faults"), F.count_if("detected").alias("caught"), ids(F.col("detected")).alias("caught_ids"), ids(~F.col("detected")).alias("missed_ids"))


def by_farm(cases: DataFrame) -> DataFrame:
    """Per farm: fault cases, caught ones, normal cases, and false alarms with their ids."""
    fault, hit = F.col("label") == "anomaly", F.col("detected")
    false = ~fault & hit
    return cases.groupBy("farm").agg(
        F.count_if(fault).alias("faults"), F.count_if(fault & hit).alias("caught"), F.count_if(~fault).alias("normal_cases"),
        F.count_if(false).alias("false_alarms"), F.array_sort(F.collect_list(F.when(false, F.col("event_id")))).alias("false_ids"),
    )


def hourly_series(rows: DataFrame, rows_an_hour: int = 6) -> DataFrame:
    """Mean score and largest criticality by hour before the event's end: ``rows(event_id, id, end_id, score, criticality)``."""
    hour = F.floor((F.col("id") - F.col("end_id")) / rows_an_hour)
    return rows.groupBy("event_id", hour.alias("hour")).agg(F.avg("score").alias("score"), F.max("criticality").alias("criticality"))


def error_shares(rows: DataFrame, groups: list[str], k: int = 3) -> DataFrame:
    """The k sensors with most of the error of ``rows(groups, sensor, error)``: their share in percent and position."""
    sums = rows.groupBy(*groups, "sensor").agg(F.avg("error").alias("__e"))
    whole = Window.partitionBy(*groups)
    w = whole.orderBy(F.desc("__e"), "sensor")
    out = sums.withColumns({"share_pct": 100 * F.try_divide(F.col("__e"), F.sum("__e").over(whole)), "position": F.row_number().over(w)})
    return out.where(F.col("position") <= k).drop("__e")


def warned_sensors(days: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Per case the sensors that warned, those with most days first (then the earlier first day, then the name), at most
    ``most`` of them, and how many there are."""
    one = days.where("warn").groupBy(*keys, "sensor").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("days")).alias("order"), "first_day", "sensor", "days")))
    out = one.groupBy(*keys).agg(F.slice(listed, 1, most).alias("__l"), F.count(F.lit(1)).alias("warned"))
    return out.select(*keys, "warned", F.transform("__l", lambda x: F.struct(x["sensor"].alias("sensor"), x["days"].alias("days"), x["first_day"].alias("first_day"))).alias("sensors"))


def diagnosis(alarms: DataFrame, keys: list[str]) -> DataFrame:
    """The component with most sensor warnings of each case's alarm days (ties: the earlier first day, then the name)."""
    sums = alarms.groupBy(*keys, "component").agg(F.sum("sensors").alias("n"), F.min("day").alias("first_day"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_day", "component")
    return sums.withColumn("k", F.row_number().over(w)).where("k = 1").select(*keys, F.col("component").alias("diagnosis"))


def agrees(diagnosis_: Column, cause: Column) -> Column:
    """Whether the diagnosis is the operator's cause or begins with the same word; NULL where either says nothing."""
    unsaid = (F.length(diagnosis_) == 0) | (F.length(cause) == 0) | (cause == "other") | diagnosis_.isNull() | cause.isNull()
    return F.when(~unsaid, F.split(diagnosis_, " ")[0] == F.split(cause, " ")[0])


def escalation(days: DataFrame, least: int = -90) -> DataFrame:
    """Mean share of sensors in warning by day before the event and label: ``days(event_id, label, sensor, day, warn)``."""
    share = days.where((F.col("day") <= -1) & (F.col("day") >= least)).groupBy("event_id", "label", "day").agg(F.avg(F.col("warn").cast("double")).alias("share"))
    return share.groupBy("label", "day").agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("cases"))


def base_name(column: Column) -> Column:
    return F.regexp_replace(column, "_avg$", "")


def finite_round(value: Column, digits: int) -> Column:
    """Rounded; NULL for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value, digits))

"""Scores of early-fault detectors: F-beta, event evaluation, the combined score and rule grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.sequence import criticality

#: Fixed values of the score: beta, rows for a detection, weights.
BETA, DETECTED_AT, WEIGHTS = 0.5, 72, {"coverage": 1.0, "accuracy": 2.0, "reliability": 1.0, "earliness": 1.0}


def f_beta(truth: Column, flag: Column, beta: float = BETA) -> Column:
    """Aggregate: F-beta of two boolean columns, 0 where precision and recall are both 0."""
    b2 = beta * beta
    tp, fp, fn = F.count_if(truth & flag), F.count_if(~truth & flag), F.count_if(truth & ~flag)
    return F.coalesce(F.try_divide((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp), F.lit(0.0))


def earliness_weight(position: Column, n: Column) -> Column:
    """1 on the first quarter of n rows, then linearly down to 0 at the last; ``position`` from 1."""
    x = F.coalesce(F.try_divide((position - 1).cast("double"), (n - 1).cast("double")), F.lit(0.0))
    return F.when(x <= 0.25, 1.0).otherwise(F.greatest((1 - x) / 0.75, F.lit(0.0)))


def evaluate_events(rows: DataFrame) -> DataFrame:
    """One row per event of ``rows(event_id, label, id, flag, normal, start_id, end_id)``: coverage (anomalies), accuracy,
    earliness (anomalies), the largest criticality up to the event's end, whether detected, first detection and lead."""
    anomaly, inside = F.col("label") == "anomaly", F.col("id").between(F.col("start_id"), F.col("end_id"))
    rows = rows.withColumn("inside", inside).withColumn("truth", ~F.col("normal") | (inside & anomaly))
    event = Window.partitionBy("event_id", "inside").orderBy("id")
    n = F.count(F.lit(1)).over(Window.partitionBy("event_id", "inside"))
    rows = rows.withColumn("weight", F.when(F.col("inside") & anomaly, earliness_weight(F.row_number().over(event), n)))
    scored = F.col("normal")
    part = rows.groupBy("event_id", "label", "end_id").agg(
        f_beta(F.col("truth") & scored, F.col("flag") & scored).alias("coverage"),
        F.avg(F.when(scored, (F.col("truth") == F.col("flag")).cast("double"))).alias("accuracy"),
        F.try_divide(F.sum(F.when(F.col("flag"), F.col("weight"))), F.sum("weight")).alias("earliness"),
        F.count_if(F.col("weight").isNotNull()).alias("__inside"),
    )
    upto = criticality(rows.where(F.col("id") <= F.col("end_id")).select("event_id", "id", "flag", "normal"), ["event_id"], ["id"], "flag", "normal")
    crit = upto.groupBy("event_id").agg(F.max("criticality").alias("max_criticality"), F.min(F.when(F.col("criticality") >= DETECTED_AT, F.col("id"))).alias("first_id"))
    joined = part.join(crit, "event_id", "left")
    known = F.col("label") == "anomaly"
    return joined.select(
        "event_id", "label", (F.coalesce("max_criticality", F.lit(0)) >= DETECTED_AT).alias("detected"), F.coalesce("max_criticality", F.lit(0)).alias("max_criticality"),
        F.when(known, F.col("coverage")).alias("coverage"), "accuracy", F.when(known & (F.col("__inside") > 0), F.coalesce("earliness", F.lit(0.0))).alias("earliness"),
        F.when(known, F.col("first_id")).alias("first_id"), F.when(known, F.col("end_id") - F.col("first_id")).alias("lead_rows"),
    )


def care_score(events: DataFrame, by: str | None = None) -> DataFrame:
    """The combined score per ``by`` and over all (NULL).  Nothing detected: 0; accuracy on normal events of 0.5 or less:
    that accuracy; else the weighted mean.  Groups without both kinds of events have NULL."""
    anomaly = F.col("label") == "anomaly"
    aggregates = [
        F.avg(F.when(anomaly, F.col("coverage"))).alias("coverage"), F.avg(F.when(~anomaly, F.col("accuracy"))).alias("accuracy"),
        f_beta(anomaly, F.col("detected")).alias("reliability"), F.avg(F.when(anomaly, F.col("earliness"))).alias("earliness"),
        F.count_if(anomaly).alias("anomaly_events"), F.count_if(~anomaly).alias("normal_events"),
        F.count_if(anomaly & F.col("detected")).alias("anomalies_detected"), F.count_if(~anomaly & F.col("detected")).alias("false_alarms"),
    ]
    out = events.rollup(by).agg(*aggregates) if by else events.agg(*aggregates)
    mean = sum(w * F.col(k) for k, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    both = (F.col("anomaly_events") > 0) & (F.col("normal_events") > 0)
    score = F.when(F.col("anomalies_detected") + F.col("false_alarms") == 0, 0.0).when(F.col("accuracy") <= 0.5, F.col("accuracy")).otherwise(mean)
    return out.withColumn("care", F.when(both, score))


def rule_grid(days: DataFrame, rules: DataFrame) -> DataFrame:
    """Alarm days of every count rule: ``days(event_id, day, episodes)`` with the small table ``rules(rule_id, least,
    persist)``; the rules are a stated list (some dozens; an error above ``MAX_RULES``), so each row of days meets each."""
    from windloom.operators.watch import checked_rules

    tried = days.join(checked_rules(rules)).withColumn("alert", F.col("episodes") >= F.col("least"))
    w = Window.partitionBy("rule_id", "event_id").orderBy("day")
    last = F.max(F.when(F.col("alert"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tried = tried.withColumn("__n", F.row_number().over(w)).withColumn("__last", last)
    warn = F.col("alert") & ((F.col("persist") <= 1) | F.coalesce(F.col("__n") - F.col("__last") <= F.col("persist"), F.lit(False)))
    return tried.groupBy("rule_id").agg(F.count_if("alert").alias("alerts"), F.count_if(warn).alias("warnings"), F.countDistinct(F.when(warn, F.col("event_id"))).alias("events_warned"))


def lead_times(events: DataFrame) -> DataFrame:
    """Quartiles of the lead of detected anomalies."""
    own = events.where("lead_rows is not null")
    return own.agg(F.count(F.lit(1)).alias("n"), *[F.percentile("lead_rows", q).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


def survival(leads: DataFrame, column: str, steps: list[int]) -> DataFrame:
    """Share of events with a lead of at least each step (a handful of steps, one expression each)."""
    total = leads.agg(*[F.avg((F.col(column) >= d).cast("double")).alias(f"d{d}") for d in steps])
    return total.unpivot([], [f"d{d}" for d in steps], "step", "share")

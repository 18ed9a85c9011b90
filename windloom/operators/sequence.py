"""Ordered state: CUSUM, counters, episodes, exponential means.

Where a recurrence has a closed form it is a window expression.  The others compose: what a stretch of rows does to the state
is a few numbers, whatever the state.  Rows are cut into parts by ranges of (key, order), the parts' few numbers are composed
in order of the parts, and each part then starts from the state it is handed: no task holds a key's history.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.session import stored


def _running(groups: list[str], order: list[str]):
    return Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cusum(rows: DataFrame, groups: list[str], order: list[str], increment: Column, name: str = "cusum") -> DataFrame:
    """S = max(0, S + increment): the running sum less its running minimum (at most 0)."""
    w = _running(groups, order)
    rows = rows.withColumn("__c", F.sum(increment).over(w))
    return rows.withColumn(name, F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(w))).drop("__c")


def poisson_cusum(days: DataFrame, groups: list[str], order: list[str], factor: float = 4.0, alpha: float = 0.001, beta: float = 0.1) -> DataFrame:
    """Daily CUSUM of ``episodes`` against the normal rate ``base_rate`` per monitored row; ``warn`` at Wald's boundary."""
    step = F.col("episodes") * math.log(factor) - (factor - 1) * F.col("base_rate") * F.col("monitored")
    return cusum(days, groups, order, step).withColumn("warn", F.col("cusum") >= math.log((1 - beta) / alpha))


def count_rule(days: DataFrame, groups: list[str], order: list[str], least: int, persist: int) -> DataFrame:
    """``alert``: enough episodes; ``warn``: an alert with another in the ``persist`` days before (1: any alert)."""
    rows = days.withColumn("alert", F.col("episodes") >= least)
    if persist <= 1:
        return rows.withColumn("warn", F.col("alert"))
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(-persist, -1)
    return rows.withColumn("warn", F.col("alert") & F.coalesce(F.bool_or("alert").over(before), F.lit(False)))


def trailing_any(rows: DataFrame, groups: list[str], order: list[str], flag: str, n: int, name: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn(name, F.bool_or(flag).over(w))


def episodes(rows: DataFrame, groups: list[str], order: list[str], over: Column, least: int = 3) -> DataFrame:
    """``in_episode``: in a run of at least ``least`` rows over the threshold; ``starts``: its first row."""
    from windloom.operators.qc import run_lengths

    w = Window.partitionBy(*groups).orderBy(*order)
    rows = run_lengths(rows, groups, order, over).withColumn("in_episode", F.col("run") >= least).drop("run")
    return rows.withColumn("starts", F.col("in_episode") & ~F.coalesce(F.lag("in_episode").over(w), F.lit(False)))


def episode_rate(rows: DataFrame, groups: list[str], calibration: Column) -> DataFrame:
    """Normal episodes per row over the calibration part: (starts + 0.5) / rows."""
    return rows.where(calibration).groupBy(*groups).agg(((F.count_if("starts") + 0.5) / F.count(F.lit(1))).alias("base_rate"))


def _by_parts(rows: DataFrame, groups: list[str], order: list[str], effect, effect_schema: str, follow, start: tuple, advance, out_schema: str) -> DataFrame:
    """A recurrence over the rows of each key in order.  ``effect(frame) -> tuple`` is what a stretch does to the state (columns
    of ``effect_schema``), ``follow(state, effect) -> state`` applies it, ``advance(frame, state) -> dict`` gives the new columns
    of a stretch entered in that state."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = stored(rows.repartitionByRange(n, *groups, *order).withColumn("__part", F.spark_partition_id()), "parts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [c.split()[0] for c in effect_schema.split(", ")]
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in groups)

    def stretches(pdf: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        """The rows of each key, in order, of a part that is sorted by (key, order)."""
        new = (pdf[groups] != pdf[groups].shift()) & ~(pdf[groups].isna() & pdf[groups].shift().isna())
        at = [*np.flatnonzero(new.any(axis=1).to_numpy() | (np.arange(len(pdf)) == 0)).tolist(), len(pdf)]
        for first, end in itertools.pairwise(at):
            yield tuple(None if pd.isna(x) else x for x in pdf[groups].iloc[first]), pdf.iloc[first:end]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        """The effects of a part's first and last keys: the others have all their rows in it."""
        found = list(stretches(pdf.sort_values([*groups, *order], kind="stable", na_position="first")))
        ends = found if len(found) < 3 else [found[0], found[-1]]
        return pd.concat([own[[*groups, "__part"]].iloc[:1].assign(**dict(zip(names, effect(own), strict=True))) for _, own in ends])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row a part of a key: their number is that of the partitions at most."""
        pdf, states, now = pdf.sort_values("__part"), [], start
        for made in pdf[names].itertuples(index=False, name=None):
            states.append([float(x) for x in now])
            now = follow(now, made)
        return pdf[[*groups, "__part"]].assign(__state=states)

    effects = parts.groupBy("__part").applyInPandas(summarise, f"{key_schema}, __part int, {effect_schema}")
    entry = effects.groupBy(*groups).applyInPandas(compose, f"{key_schema}, __part int, __state array<double>")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        entered = {tuple(None if pd.isna(x) else x for x in r[:-1]): tuple(r[-1]) for r in right[[*groups, "__state"]].itertuples(index=False, name=None)}
        pdf = left.sort_values([*groups, *order], kind="stable", na_position="first")
        made: dict[str, list] = {c.split()[0].strip("`"): [] for c in out_schema.split(", ")}
        for key, own in stretches(pdf):
            for name, values in advance(own, entered.get(key, start)).items():
                made[name] += values
        return pdf.drop(columns="__part").assign(**made)

    own = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return parts.groupBy("__part").cogroup(entry.groupBy("__part")).applyInPandas(run, f"{own}, {out_schema}")


def criticality(rows: DataFrame, groups: list[str], order: list[str], flag: str, normal: str, most: int = 1000) -> DataFrame:
    """Counter per row: up with a flag, down without, unchanged out of normal operation, kept within 0 and ``most``.

    A stretch of rows takes a counter c to min(high, max(low, c + shift)); such maps compose to maps of the same kind.
    """

    def steps(pdf: pd.DataFrame) -> list[int]:
        flags, live = pdf[flag].fillna(False).to_numpy(bool), pdf[normal].fillna(False).to_numpy(bool)
        return ((flags.astype(int) * 2 - 1) * live).tolist()

    def effect(pdf: pd.DataFrame) -> tuple:
        shift, low, high = 0, 0, most
        for d in steps(pdf):
            shift, low, high = shift + d, min(most, max(0, low + d)), min(most, max(0, high + d))
        return shift, low, high

    def advance(pdf: pd.DataFrame, state: tuple) -> dict:
        c, out = int(state[0]), []
        for d in steps(pdf):
            c = min(most, max(0, c + d))
            out.append(c)
        return {"criticality": out}

    follow = lambda state, e: (min(e[2], max(e[1], state[0] + e[0])),)
    return _by_parts(rows, groups, order, effect, "shift long, low long, high long", follow, (0,), advance, "criticality int")


def exponential_mean(rows: DataFrame, groups: list[str], order: list[str], value: str, span: int) -> DataFrame:
    """Adjusted exponential mean over non-null values, NULL until a third of the span has been seen.

    Numerator and denominator shrink by 1 - alpha at each value, so a stretch scales what came before by a power of that and
    adds its own.
    """
    keep, least, name = 1 - 2.0 / (span + 1), max(1, span // 3), f"{value}_ewm{span}"

    def walk(pdf: pd.DataFrame, state: tuple) -> tuple[list, tuple]:
        num, den, n = state
        out = []
        for x in pdf[value].to_numpy(float, na_value=float("nan")).tolist():
            if x == x:
                num, den, n = num * keep + x, den * keep + 1.0, n + 1
            out.append(num / den if n >= least else None)
        return out, (num, den, n)

    def effect(pdf: pd.DataFrame) -> tuple:
        num, den, n = walk(pdf, (0.0, 0.0, 0))[1]
        return num, den, int(n)

    follow = lambda s, e: (s[0] * keep ** e[2] + e[0], s[1] * keep ** e[2] + e[1], s[2] + e[2])
    return _by_parts(rows, groups, order, effect, "num double, den double, seen long", follow, (0.0, 0.0, 0), lambda pdf, s: {name: walk(pdf, s)[0]}, f"`{name}` double")


def first_crossing(rows: DataFrame, groups: list[str], order: str, value: str, threshold: float) -> DataFrame:
    """The first place at which ``value`` reaches the threshold (NULL: never)."""
    return rows.groupBy(*groups).agg(F.min(F.when(F.col(value) >= threshold, F.col(order))).alias("first_at"), F.max(value).alias("largest"))


def sensor_faults(days: DataFrame, peers: DataFrame, duplicate_r: float = 0.98, most_bad: float = 0.2, agree: float = 0.5) -> DataFrame:
    """``fault`` and ``check`` per (event_id, sensor, day) of ``days(event_id, sensor, day, warn, bad_share)``.

    ``peers(event_id, sensor, peer, r)``.  A fault: too many bad readings, or a warning while every near-duplicate peer (if
    any) is quiet.  To check: a warning with under half of the peers warning, and no fault.
    """
    other = days.select("event_id", F.col("sensor").alias("peer"), "day", F.col("warn").alias("peer_warn"))
    seen = days.select("event_id", "sensor", "day").join(peers, ["event_id", "sensor"]).join(other, ["event_id", "peer", "day"])
    twin = F.col("r") > duplicate_r
    stats = seen.groupBy("event_id", "sensor", "day").agg(F.count_if(twin).alias("__twins"), F.count_if(twin & F.col("peer_warn")).alias("__twin_warns"), F.avg(F.col("peer_warn").cast("double")).alias("__share"))
    rows = days.join(stats, ["event_id", "sensor", "day"], "left")
    lonely = F.col("warn") & (F.coalesce("__twins", F.lit(0)) > 0) & (F.coalesce("__twin_warns", F.lit(0)) == 0)
    rows = rows.withColumn("fault", (F.col("bad_share") > most_bad) | lonely)
    return rows.withColumn("check", F.col("warn") & F.coalesce(F.col("__share") < agree, F.lit(False)) & ~F.col("fault")).drop("__twins", "__twin_warns", "__share")


def component_alarms(days: DataFrame, least_sensors: int = 1, window_days: int = 3) -> DataFrame:
    """``(event_id, component, day)`` on alarm: some member warns today and enough did within the window (no more members
    are asked for than there are).  ``days(event_id, sensor, component, day, warn)`` holds eligible sensors."""
    recent = trailing_any(days, ["event_id", "sensor"], ["day"], "warn", window_days, "recent")
    out = recent.groupBy("event_id", "component", "day").agg(F.count_if("recent").alias("on"), F.bool_or("warn").alias("today"), F.count(F.lit(1)).alias("members"))
    return out.where(F.col("today") & (F.col("on") >= F.least(F.lit(least_sensors), F.col("members")))).select("event_id", "component", "day")

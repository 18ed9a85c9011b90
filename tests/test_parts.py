"""Neighbours of parts and exact percentiles against plain windows and Spark's own percentile."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators import parts, qc


@pytest.mark.parametrize("n", [7, 400])
def test_windows_over_parts_see_what_lies_around_them(spark, monkeypatch, n):
    monkeypatch.setattr(parts, "PART_ROWS", 3)
    df = spark.createDataFrame([(i % 2, i // 3, i, (i * 7) % 11) for i in range(n)], "g int, a int, b int, v int")
    w = Window.partitionBy("g", "__part").orderBy("a", "b")
    near = lambda w: [F.lag("v", k).over(w).alias(f"l{k}") for k in (1, 4)] + [F.lead("v", k).over(w).alias(f"n{k}") for k in (1, 2)]
    got = parts.with_neighbours(df, ["g"], ["a", "b"], 4, 2).select("b", "__own", "__part", *near(w)).where("__own").drop("__own")
    assert got.select("__part").distinct().count() > 2
    want = df.select("b", *near(Window.partitionBy("g").orderBy("a", "b")))
    assert sorted(got.drop("__part").collect()) == sorted(want.collect())


def test_percentiles_equal_sparks(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.5, rng.gauss(0, 1), float(rng.randrange(5))]), rng.randrange(3)) for g, n in ((0, 16000), (1, 300), (2, 1), (3, 2)) for _ in range(n)]
    df = spark.createDataFrame([*rows, (4, None, None)], "g int, x double, k long")
    wanted = {"a": ("x", 0.001), "b": ("x", 0.5), "c": ("x", 0.999), "d": ("k", 0.99), "e": ("x", 0.0), "f": ("k", 1.0)}
    want = df.groupBy("g").agg(*[F.percentile(c, p).alias(k) for k, (c, p) in wanted.items()])
    assert sorted(parts.percentiles(df, ["g"], wanted).collect()) == sorted(want.collect())


def test_no_window_of_the_checks_holds_a_sensor(spark, monkeypatch):
    monkeypatch.setattr(parts, "PART_ROWS", 200)
    rows = [(i, 7.5 if 2500 <= i < 2900 else 5.0 if i % 211 < 9 else float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, v double").select(F.lit(1).alias("s"), "i", "v", (F.col("i") < 1500).alias("r"))
    got = qc.sensor_checks(df, "s", ["i"], "v", "r")
    # The run of 400 rows lies in several parts and is one run.
    assert [r.i for r in got.where("stale").orderBy("i").collect()] == list(range(2500, 2900))
    sizes, stored = [], parts.stored
    monkeypatch.setattr(parts, "stored", lambda d, name: (out := stored(d, name), name == "parts" and sizes.append(out.groupBy("__part").count().agg(F.max("count")).first()[0]))[0])
    qc.sensor_checks(df, "s", ["i"], "v", "r").count()
    one = qc.profile(df, ["s"], ["i"], "v").first()
    assert one.n == 3000 and one.stuck == sum(rows[i][1] == rows[i - 1][1] == rows[i - 2][1] for i in range(2, 3000))
    assert len(sizes) == 2 and max(sizes) < 600


def test_rules_of_the_watch_meet_days_that_lie_by_case(spark):
    from windloom.plans import watch

    plan = watch._alarms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # One for the days' ends, sums and rates each and one by case, which no rule multiplies.
    assert "rule_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)

"""Cases of the third review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from windloom.functions import text as T


def test_numbers_are_printed_from_their_exact_binary_value(spark):
    texts = ["0.0625 2.0005 0.0015", "12345678901234567890123", "7 1" + "0" * 400, "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r.n for r in df.select("i", T.printed(T.numbers(F.col("t"))).alias("n")).orderBy("i").collect()]
    assert found == ["0.002 0.062 2.001", "12345678901234567741440.000", "7.000 inf", "", None]


def test_reordered_rows_pass_through_one_stream(spark, monkeypatch):
    from windloom.plans import streams

    runs, caught_up = [], streams.aggregates.caught_up
    monkeypatch.setattr(streams.aggregates, "caught_up", lambda rows, name, *a: runs.append(name) or caught_up(rows, name, *a))
    out = streams.stream_reordered(spark, "/root/testdata/sf0.001").collect()
    assert len(runs) == 1 and out and all(r.cusum is not None and r.criticality is not None for r in out)


def test_equal_downtimes_are_equal_in_any_order(spark):
    from windloom.operators import intervals

    lengths = [1, 7, 3600, 11, 100001, 13, 17, 5, 86399, 29]
    orders = [[*lengths[k:], *lengths[:k]] for k in range(10)] + [[*lengths[k:], *lengths[:k]][::-1] for k in range(10)]
    low, high = (f(orders, key=lambda o: reduce(lambda t, s: t + s / 3600, o, 0.0)) for f in (min, max))
    rows = [(1, m, 0, s) for m, own in (("a", low), ("b", high)) for s in own]
    df = spark.createDataFrame(rows, "turbine int, message string, start_s long, end_s long").coalesce(1)
    assert [r.message for r in intervals.top_causes(df, ["turbine"]).orderBy("position").collect()] == ["a", "b"]
    assert intervals.top_causes(df, ["turbine"]).select("hours").distinct().count() == 1


def test_recommended_turbine_does_not_depend_on_rounding_noise(spark):
    from windloom.operators import rules

    eff = spark.createDataFrame([(1, 0.1 + 0.2), (2, 0.3)], "turbine int, capacity_factor double")
    assert rules.recommend(eff, eff.where("false")).first().turbine == 1


def test_texts_are_cut_some_at_a_time(spark, monkeypatch):
    from windloom.operators import retrieval

    df = spark.createDataFrame([(i, "A sentence of some words. " * (20 * i) if i % 5 else None) for i in range(23)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(retrieval, "TEXT_ROWS", 4)
    want = [(r.doc_id, k, s, c) for r in df.collect() if r.text for k, (s, c) in enumerate(retrieval.chunk_bounds(r.text))]
    assert [tuple(r) for r in retrieval.chunks(df).collect()] == want


def test_quantile_by_bins_is_exact(spark, monkeypatch):
    from windloom.operators import studies

    monkeypatch.setattr(studies, "QUANTILE_BINS", 3)
    for values in ([5.0], [1.0, 1.0, 1.0], [2.0, -1.0, 1e9, 3.5, 3.5, 0.1, None], [float(i * i % 31) for i in range(40)]):
        df = spark.createDataFrame([(v,) for v in values], "o double")
        for share in (0.0, 0.37, 0.8, 1.0):
            assert studies.quantile(df, "o", share) == df.agg(F.percentile("o", share)).first()[0]
    assert studies.quantile(df.where("false"), "o", 0.8) is None


def test_rows_at_exactly_two_deviations_are_no_outliers(spark):
    import random
    from statistics import median

    from windloom.operators import qc

    rng, rows, want, ties = random.Random(5), [], set(), 0
    for g in range(3000):
        q = [rng.randint(1, 50) for _ in range(rng.choice((4, 5, 9, 25, 32)))] if g % 2 else rng.sample([rng.randint(1, 50), *[rng.randint(1, 25)] * 3], 4)
        n, m, v = len(q), 2 * median(q), len(q) * sum(x * x for x in q) - sum(q) ** 2
        # Twice the median is whole, so (2 q - m)^2 / 4 > 4 v / n / (n - 1) is decided in whole numbers.
        over = [(2 * x - m) ** 2 * n * (n - 1) - 16 * v for x in q]
        if v and 0 in over:
            ties += over.count(0)
            rows += [(g, i, 500.0, x / 2) for i, x in enumerate(q)]
            want |= {(g, i) for i, o in enumerate(over) if o > 0}
    df = spark.createDataFrame(rows, "turbine int, i int, power double, wind double").repartition(3, "i")
    out = qc.bin_outliers(df, ["turbine"], "power", "wind", 100.0, 0.0, 1000.0)
    assert ties > 100 and {(r.turbine, r.i) for r in out.where("outlier").collect()} == want


def test_details_at_a_limit_do_not_depend_on_the_order_of_summing(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    import pandas as pd

    from windloom.plans import followups

    rng, lines, events, want = random.Random(7), [], [], {}
    for t in range(60):
        # 80 prices whose capacity factor has a 5 in the seventh place and nothing after it.
        cents = [rng.randint(90_000, 10_500_000) for _ in range(80)]
        cents[0] += (410 - sum(cents)) % 820
        want[t] = (8 * sum(cents) // (41 * 80) + 1) // 2 / 1e6
        lines += [(t, c / 100) for c in cents]
        # 66 directions with a mean of exactly 150 or 210 degrees, three degrees off.
        k = [rng.randint(25, 75) for _ in range(66)]
        while d := (125, 175)[t % 2] * 22 - sum(k):
            i = rng.randrange(66)
            k[i] = min(99, max(0, k[i] + (1 if d > 0 else -1)))
        events += [(t, f'{{"k": {x}}}') for x in k]
    rng.shuffle(lines)
    rng.shuffle(events)
    at = [datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(len(events))]
    pd.DataFrame({"l_suppkey": [t for t, _ in lines], "l_extendedprice": [p for _, p in lines]}).assign(
        l_shipdate=pd.Timestamp("1997-01-01").as_unit("us"), l_orderkey=range(len(lines)), l_linenumber=1, l_partkey=1, l_quantity=20.0
    ).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"user_id": [t for t, _ in events], "props": [p for _, p in events]}).assign(
        ts=pd.Series(at).astype("datetime64[us]"), event_id=range(len(events)), event_type="view", value=1.0
    ).to_parquet(tmp_path / "events.parquet")
    out = followups.turbine_details(spark, str(tmp_path)).collect()
    assert {r.turbine: r.capacity_factor for r in out} == want
    assert {r.turbine: r.position for r in out} == {t: 1 + sum(v > w for v in want.values()) for t, w in want.items()}
    assert {r.status for r in out} == {"flag"}

"""Audit of how sources differ: chi-square distances between the word distributions of all sources of a language.

A language keeps the terms that at least ``least_docs`` of its documents hold.  A source's count n of a kept term becomes the share
p = 1 + floor(1e9 (n + 1) / (N + V)), N being the source's count of all kept terms and V their number, and two shares p, q differ by
floor((p - q)^2 / q): whole numbers throughout.

Most terms have few occurrences in few sources, so the columns of counts repeat: terms are grouped by their sparse vector of
(source, count), every pair of sources is evaluated once for each distinct vector, and multiplied by the number of its terms.
A pair of which neither source has the term is not met at all.  With f the difference and z for "no occurrence", the sum
over the V terms of f(p, q) is

    V f(zp, zq) + sum over terms of p's source [f(p, zq) - f(zp, zq)] + the same for q's
                + sum over terms of both [f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)]

where the two middle sums need each source's distinct counts only, and the last the distinct vectors, whose pairs
are added up inside the tasks.  Original terms are ranked at the end, by their own shares against the language's.

Texts are counted per task before anything is shuffled.  Defined cases: null texts, languages and sources count as empty strings;
a group (language, source) without terms takes part with counts of zero; a language without kept terms has distances of zero and no
terms; repeated rows count again, also as documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.llm.common import slices, store, text_bytes

#: Documents that a kept term is in; shares are out of so many; ranks of terms that are reported.
LEAST_DOCS, UNIT, TOP_TERMS = 3, 1_000_000_000, 200
#: A task hands its counts on when it holds so many bytes of terms; pairs of a source vector evaluated at once.
HELD_BYTES, PAIRS_AT_ONCE = 48 << 20, 1 << 19


def _letters() -> bytes:
    """What each byte of a text becomes: letters (A-Z in lower case) and bytes from 0x80 on stay, others part terms."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in range(ord("a"), ord("z") + 1):
        table[b] = table[b - 32] = b
    return bytes(table)


_KEPT = _letters()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term in every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                terms = list(n)
                for a in range(0, len(terms), 16384):
                    some = terms[a : a + 16384]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([in_docs[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in slices(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch), strict=True):
                terms = text.translate(_KEPT).split()
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                in_docs.update(set(terms))
                if len(n) > before:  # about: new terms have the text's mean length
                    size += (len(n) - before) * (240 + 2 * len(text) // max(1, len(terms)))
            if size > HELD_BYTES:
                yield from handed_on()
                size = 0
        yield from handed_on()

    rows = docs.select(_filled(docs, "lang"), _filled(docs, "source"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(docs: DataFrame, name: str) -> Column:
    return (F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")).alias(name)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 (n + 1) / (total + terms)) without overflow; of no terms at all: that of one."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 1), F.greatest(wide(total) + wide(terms), F.lit(1).cast("decimal(20,0)")))
    return F.lit(1).cast("long") + over


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are below 2^31, so that the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """``(lang, source, item, both)``: the last sum above, from ``vectors(lang, mult, parts)`` with parts of
    (source, p, z).  A task adds up what its batches have before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=8192):
            lists = batch.column(2)
            per, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
            start = np.cumsum(per) - per
            lang = batch.column(0).dictionary_encode()
            source = flat.field(0).dictionary_encode()
            of_lang, of_source = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
            p, z, mult = flat.field(1).to_numpy(), flat.field(2).to_numpy(), batch.column(1).to_numpy()
            n = len(source.dictionary)
            keys, sums = [], []
            for k in np.unique(per[per > 1]).tolist():
                own = np.flatnonzero(per == k)
                for a in range(0, len(own), max(1, PAIRS_AT_ONCE // (k * k))):
                    some = own[a : a + max(1, PAIRS_AT_ONCE // (k * k))]
                    at = start[some][:, None] + np.arange(k)
                    at_p, at_q = np.broadcast_to(at[:, :, None], (len(some), k, k)), np.broadcast_to(at[:, None, :], (len(some), k, k))
                    v = np.repeat(some, k * k - k)
                    off = ~np.eye(k, dtype=bool)
                    i, j = at_p[:, off].ravel(), at_q[:, off].ravel()
                    f = lambda x, y: (x - y) ** 2 // y
                    value = (f(p[i], p[j]) - f(p[i], z[j]) - f(z[i], p[j]) + f(z[i], z[j])) * mult[v]
                    key, into = np.unique((of_lang[v] * n + of_source[i]) * n + of_source[j], return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, into, value)
                    keys.append(key)
                    sums.append(total)
            if not keys:
                continue
            key, into = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, into, np.concatenate(sums))
            columns = [lang.dictionary.take(pa.array(key // (n * n))), source.dictionary.take(pa.array(key // n % n)), source.dictionary.take(pa.array(key % n)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "both"])

    return vectors.mapInArrow(run, "lang string, source string, item string, both long").groupBy("lang", "source", "item").agg(_whole_sum(F.col("both")).alias("both"))


def _times(count: str, c: Column) -> Column:
    return F.col(count).cast("decimal(18,0)") * c.cast("decimal(19,0)")


def _whole_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has the distance of every source to every other of its language,
    part ``term`` the terms that a source uses more than its language, those that stand out most first (ranks to ``top``)."""
    cells = store(term_counts(docs), "cells")
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = store(terms.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sizes = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("group_n"))
    groups = docs.select(_filled(docs, "lang"), _filled(docs, "source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "terms", "lang_n"]).withColumn("z", share(F.lit(0).cast("long"), F.col("group_n"), F.col("terms")))
    groups = store(groups, "groups")  # as many rows as there are groups

    vectors = kept.groupBy("lang", "counts").agg(F.count("*").alias("mult")).withColumn("vector", F.monotonically_increasing_id())
    vectors = store(vectors, "vectors")
    entries = vectors.select("lang", "vector", "mult", F.explode("counts").alias("c")).select("lang", "vector", "mult", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    entries = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("terms")))
    entries = store(entries.select("lang", "vector", "mult", "source", "p", "z"), "entries")
    shared = _pair_sums(entries.groupBy("lang", "vector", "mult").agg(F.collect_list(F.struct("source", "p", "z")).alias("parts")).select("lang", "mult", "parts"))

    own, other = groups.select("lang", "source", "terms", F.col("z").alias("zp")), groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zq"))
    pairs = own.join(other, "lang").where("source <> item")
    both_none = apart(F.col("zp"), F.col("zq"))
    distinct = entries.groupBy("lang", "source", "p").agg(F.sum("mult").alias("mult"))
    ones = distinct.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(_whole_sum(_times("mult", apart(F.col("p"), F.col("zq")) - both_none)).alias("first"))
    back = distinct.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "mult").join(pairs, ["lang", "item"])
    others = back.groupBy("lang", "source", "item").agg(_whole_sum(_times("mult", apart(F.col("zp"), F.col("q")) - both_none)).alias("second"))
    keys = ["lang", "source", "item"]
    sums = pairs.join(ones, keys, "left").join(others, keys, "left").join(shared, keys, "left")
    value = _times("terms", both_none)
    for part in ("first", "second", "both"):
        value = value + F.coalesce(F.col(part), F.lit(0))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = sums.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))

    used = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    used = used.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("terms"))).withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("terms")))
    used = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    term = used.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pair.unionByName(term)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


QUERIES = {"op12_source_divergence": op12_source_divergence}

ORACLES = {
    "op12_source_divergence": r"""
with doc as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
),
held as (select d, lang, source, unnest(terms) as term from doc),
kept as (select lang, term, count(*) as total from held group by lang, term having count(distinct d) >= 3),
cell as (select lang, source, term, count(*) as n from held join kept using (lang, term) group by lang, source, term),
lang_size as (select lang, count(*) as terms, sum(total) as lang_n from kept group by lang),
grp as (
  select lang, source, coalesce(sum(n), 0) as group_n, coalesce(any_value(terms), 0) as terms, coalesce(any_value(lang_n), 0) as lang_n
  from (select distinct lang, source from doc) left join cell using (lang, source) left join lang_size using (lang) group by lang, source
),
share as (
  select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (group_n + terms)::hugeint as p,
    1 + (1000000000::hugeint * (total + 1)) // (lang_n + terms)::hugeint as q
  from grp join kept using (lang) left join cell using (lang, source, term)
),
pair as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
every_pair as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
),
used as (select lang, source, term as item, (p - q) * (p - q) // q as value from share where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from every_pair
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from used
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
""",
}

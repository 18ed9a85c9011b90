"""Text, document and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import text as T
from windloom.operators import retrieval, rules
from windloom.plans.relational import rounded
from windloom.plans.views import ctes, interval
from windloom.session import table


def component_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", T.component(F.concat_ws(" ", "p_name", "p_type")).alias("component"), T.subsystem(F.col("p_name")).alias("subsystem"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), T.component(F.col("text")).alias("component"), T.subsystem(F.col("text")).alias("subsystem"))
    return rows.unionByName(docs).groupBy("component", "subsystem").agg(F.count(F.lit(1)).alias("n"))


def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.printed(T.numbers(F.col("text"))).alias("numbers"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("digest"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interval(spark, sf_dir).select("event_id", T.duration_text(F.col("end_s") - F.col("start_s")).alias("text"))
    return rows.withColumn("seconds", T.duration_seconds(F.col("text")))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks(table(spark, sf_dir, "documents"))


def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(retrieval.search(queries, v, 10), distance=6)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), (F.col("doc_id") % 7).alias("page"), F.col("doc_id").alias("chunk"), "text",
        F.when(F.col("lang") == "en", F.array(F.lit("*"))).otherwise(F.array("lang", "source")).alias("applies_to"), (F.length("text") % 1000).alias("distance"),
    )


def scoped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.in_scope(_chunks(spark, sf_dir), "de").select("chunk")


def best_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_pages(retrieval.in_scope(_chunks(spark, sf_dir), "fr"), 4)


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents hit that are short enough to be given whole, each with its paragraphs in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\.\n")).alias("chunk", "text"))
    c = docs.select("doc_id", F.floor(F.col("chunk") / 4).alias("page"), "chunk", "text", (F.length("text") % 50).alias("distance"))
    out = retrieval.whole_documents(c, c.where("distance = 0").select("doc_id"))
    return out.select("doc_id", "characters", F.size("texts").alias("chunks"), F.md5(F.array_join("texts", "|").cast("binary")).alias("digest"))


def verified_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents looked up on pages of the same source: cited page, other page, or none."""
    specs = table(spark, sf_dir, "part").select(F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("doc_id"), F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value"), (F.col("p_partkey") % 7).alias("page"))
    return retrieval.verified_numbers(specs.distinct(), _chunks(spark, sf_dir))


def spec_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    printed = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").cast("string").alias("model"), F.lit("size").alias("field"), (F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).cast("string").alias("value"))
    configured = p.select(F.col("p_partkey").cast("string").alias("model"), F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value"))
    return retrieval.cross_check(printed, configured)


def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.array(F.lit("the"), F.lit("[0-9]")).alias("expect"), F.array(F.lit("zz+")).alias("forbid"))
    return retrieval.graded(rows).select("conv_id", "turn", "facts_found", "facts_total", "forbidden_found", F.col("pass").alias("passed"))


def incident_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windloom.operators.intervals import significant

    return retrieval.incident_documents(significant(interval(spark, sf_dir), ["error", "purchase"]))


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers asked for in several spellings."""
    c = table(spark, sf_dir, "customer")
    turbines = c.select(F.concat(F.lit("T-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("turbine"))
    asked = c.select(F.concat(F.lit("t "), F.col("c_custkey").cast("string")).alias("asked"))
    asked = asked.unionByName(c.select(F.concat(F.lit("machine no. "), F.col("c_custkey").cast("string")).alias("asked")))
    return rules.resolve_turbine(turbines, asked.unionByName(spark.createDataFrame([("nothing",), ("T-x999999999",)], "asked string")))


def checked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite a page for a part's size; of the context's three pages one prints it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("answer_id"), F.col("p_size"))
    answers = p.select("answer_id", F.concat(F.lit("By Sheet 7 the size is "), F.col("p_size").cast("string"), F.lit(" mm, p. "), (F.col("p_size") % 3 + 1).cast("string"), F.lit("; see also p.9.")).alias("answer"))
    pages = p.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"))
    text = F.when(F.col("answer_id") % 3 + 1 == F.col("page"), F.concat(F.lit("size: "), F.col("p_size").cast("string"))).otherwise("0 of 1000")
    pages = pages.select("answer_id", F.col("page").cast("long").alias("place"), F.lit("d").alias("doc_id"), F.lit("Sheet 7").alias("title"), "page", text.alias("text"))
    out = retrieval.checked_citations(answers, pages)
    return out.select("answer_id", "text", F.concat_ws(",", F.transform("cited", lambda c: c["page"].cast("string"))).alias("cited"))


def graded_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("set"), F.col("text").alias("answer"), F.array(F.lit("the"), F.lit("[0-9]")).alias("expect"), F.array(F.lit("qu")).alias("forbid"))
    return retrieval.tallies(retrieval.graded(rows), "set")


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source with citation labels."""
    pages = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("doc_id"), (F.col("doc_id") % 7).alias("page"), F.col("source").alias("title"), F.concat(F.lit("http://x/"), "source").alias("url"), "text")
    out = retrieval.page_documents(pages).groupBy("doc_id", "page", "citation.label", "citation.url")
    return out.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters"))


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cases = c.select(
        F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("farm"), F.when(F.col("c_custkey") % 2 == 0, "anomaly").otherwise("normal").alias("label"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("description"), (F.col("c_custkey") % 5 > 1).alias("detected"), (F.col("c_custkey") % 40).alias("lead_days"),
    )
    return retrieval.case_documents(cases)


_NAMES = (
    checked_citations, graded_tallies, page_documents, case_documents, component_keywords, numbers_in_text, clean_text, durations, fingerprints, chunk_documents, knn_l2, scoped_chunks, best_pages, whole_documents, verified_specs, spec_cross_check,
    graded_answers, incident_documents, resolved_names,
)
QUERIES = {f.__name__: f for f in _NAMES}


def _case(text: str, rules_: list) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({text}, '{k}')" for k in keys) + f" then '{name}'" for name, keys in rules_) + " else 'other' end"


_CHUNKS = "ch as (select source as doc_id, doc_id % 7 as page, doc_id as chunk, text, case when lang = 'en' then ['*'] else [lang, source] end as applies_to, length(text) % 1000 as distance from documents)"
_NUMBERS = r"list_sort(list_distinct(list_transform(regexp_extract_all(%s, '([0-9][0-9,]*(?:\.[0-9]+)?)', 1), lambda t: try_cast(replace(t, ',', '') as double))))"
_BEST = "bp as (select doc_id, page, arg_min(chunk, distance * 1000000000::bigint + chunk) as chunk, min(distance) as distance from ch %s group by 1, 2)"

_FRENCH = "where list_has_any(applies_to, ['*', 'fr'])"

ORACLES = {
    "checked_citations": "select p_partkey as answer_id, 'By Sheet 7 the size is ' || p_size || ' mm, p.' || (p_partkey % 3 + 1) || '; see also p.9.' as text, (p_partkey % 3 + 1)::varchar as cited from part",
    "graded_tallies": "with a as (select conv_id % 5 as set, regexp_matches(text, '(?i)the')::int + regexp_matches(text, '[0-9]')::int as f, regexp_matches(text, '(?i)qu') as b from conversations) select set, count(*) as answers, count_if(f = 2 and not b) as passed, sum(f)::bigint as facts_found, 2 * count(*) as facts_total, count_if(b) as with_forbidden from a group by rollup (set)",
    "page_documents": "__CHUNKS, c as (select doc_id, length(t) as n from p where length(t) >= 80) select source || '-' || doc_id as doc_id, doc_id % 7 as page, source || ', p.' || (doc_id % 7) as label, 'http://x/' || source as url, count(*) as chunks, sum(n)::bigint as characters from c join documents using (doc_id) group by 1, 2, 3, 4",
    "case_documents": "select c_custkey as doc_id, 'Case ' || c_custkey || ' of farm ' || c_nationkey || '; ' || case when c_custkey % 2 = 0 then 'fault: ' || case when c_custkey % 3 > 0 then c_mktsegment else 'cause not stated' end else 'no fault' end || '; ' || case when c_custkey % 5 > 1 then 'alarm ' || (c_custkey % 40) || ' days before' else 'no alarm' end as text from customer",
    "component_keywords": f"""with t as (select p_name || ' ' || p_type as a, p_name as b from part union all select text, text from documents),
k as (select {_case("lower(' ' || a || ' ')", T.COMPONENT_RULES)} as component, case when length(b) > 0 then {_case("lower(b)", T.SUBSYSTEM_RULES)} end as subsystem from t) select component, subsystem, count(*) as n from k group by 1, 2""",
    "numbers_in_text": f"select doc_id, array_to_string(list_transform({_NUMBERS % 'text'}, lambda v: printf('%.3f', v)), ' ') as numbers from documents",
    "clean_text": r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t' || chr(160) || ']+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) as digest from documents""",
    "durations": f"{ctes('v_interval')} select event_id, printf('%d:%02d:%02d', (end_s - start_s) // 3600, (end_s - start_s) // 60 % 60, (end_s - start_s) % 60) as text, (end_s - start_s)::double as seconds from v_interval",
    "fingerprints": "select doc_id, sha256(text) as sha from documents",
    "chunk_documents": """with recursive d as (select doc_id, text, length(text) as n from documents where length(text) > 0),
w as (select doc_id, text, n, 0::bigint as start, substr(text, 1, 1200) as w from d
  union all select doc_id, text, n, nx, substr(text, nx + 1, 1200) from (select *, greatest(start + 1, stop - 150)::bigint as nx from (select *, case when start + 1200 >= n then n when greatest(c1, c2) > 600 then start + greatest(c1, c2) + 1 else start + 1200 end as stop from
    (select *, case when strpos(reverse(w), ' .') > 0 then length(w) - strpos(reverse(w), ' .') - 1 else -1 end as c1, case when strpos(reverse(w), chr(10) || chr(10)) > 0 then length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 else -1 end as c2 from w)) where stop < n)),
e as (select *, case when start + 1200 >= n then n when greatest(c1, c2) > 600 then start + greatest(c1, c2) + 1 else start + 1200 end as stop from
  (select *, case when strpos(reverse(w), ' .') > 0 then length(w) - strpos(reverse(w), ' .') - 1 else -1 end as c1, case when strpos(reverse(w), chr(10) || chr(10)) > 0 then length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 else -1 end as c2 from w)),
p as (select doc_id, start, trim(substr(text, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from e)
select doc_id, (row_number() over (partition by doc_id order by start) - 1)::int as chunk, start::int as start, t as text from p where length(t) >= 80""",
    "knn_l2": """with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0), d as (select query_id, vec_id, list_sum(list_transform(list_zip(q, embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as distance from q, embeddings),
k as (select *, row_number() over (partition by query_id order by distance, vec_id) as position from d) select query_id, vec_id, round(distance, 6) as distance, position from k where position <= 10""",
    "scoped_chunks": f"with {_CHUNKS} select chunk from ch where list_has_any(applies_to, ['*', 'de'])",
    "best_pages": f"with {_CHUNKS}, {_BEST % _FRENCH} select * from bp order by distance, doc_id, page limit 4",
    "whole_documents": "with s as (select doc_id, unnest(string_split(text, '.' || chr(10))) as text, generate_subscripts(string_split(text, '.' || chr(10)), 1) - 1 as chunk from documents), h as (select distinct doc_id from s where length(text) % 50 = 0) select doc_id, sum(length(text))::bigint as characters, count(*) as chunks, md5(string_agg(text, '|' order by chunk)) as digest from s where doc_id in (select doc_id from h) group by 1 having sum(length(text)) <= 20000",
    "verified_specs": f"""with {_CHUNKS}, pg as (select doc_id, page as p, {_NUMBERS % "string_agg(text, ' ' order by text)"} as nums from ch group by 1, 2), sp as (select distinct 'src' || (p_partkey % 20) as doc_id, 'size' as field, p_size::varchar as value, p_partkey % 7 as page from part),
j as (select sp.*, p, list_contains(nums, value::double) as ok from sp left join pg on pg.doc_id = sp.doc_id)
select doc_id, field, value, case when bool_or(ok and p = page) then page else min(p) filter (ok) end as page, bool_or(coalesce(ok, false)) as verified from j group by doc_id, field, value, j.page""",
    "spec_cross_check": "select p_partkey::varchar as model, 'size' as field, p_size::varchar as value, case when p_partkey % 3 > 0 then (p_size + (p_partkey % 5 = 0)::int)::varchar end as printed, case when p_partkey % 3 = 0 then 'missing' when p_partkey % 5 = 0 then 'differs' else 'matches' end as status from part",
    "graded_answers": "with a as (select conv_id, turn, regexp_matches(text, '(?i)the')::int + regexp_matches(text, '[0-9]')::int as f, regexp_matches(text, '(?i)zz+')::int as b from conversations) select conv_id, turn, f as facts_found, 2 as facts_total, b as forbidden_found, f = 2 and b = 0 as passed from a",
    "incident_documents": f"""{ctes('v_interval')}, s as (select *, end_s - start_s as d from v_interval where message in ('error', 'purchase') and end_s - start_s >= 3600 order by d desc, event_id limit 60)
select event_id as doc_id, printf('Turbine %d reported %s for %.1f hours, starting %s.', turbine, message, d / 3600, strftime(make_timestamp(start_s * 1000000), '%Y-%m-%d %H:%M')) as text from s""",
    "resolved_names": "select 't ' || c_custkey as asked, 'T-' || lpad(c_custkey::varchar, 12, '0') as turbine from customer union all select 'machine no. ' || c_custkey, 'T-' || lpad(c_custkey::varchar, 12, '0') from customer union all values ('nothing', null), ('T-x999999999', null)",
}
ORACLES["page_documents"] = ORACLES["page_documents"].replace("__CHUNKS", ORACLES["chunk_documents"].partition("\nselect doc_id, (row_number()")[0])

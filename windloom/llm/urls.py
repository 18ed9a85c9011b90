"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every (host, path) pair is expanded into host suffixes (cut at dots) times path prefixes; expressions meet the rules by an
equi-join on the first four bytes of their SHA-256, the full digests are compared after that, and of the rules that
fit the longest (host and path together; then the longer host; then ``block``) gives the verdict.

Only suffixes of as many labels and prefixes of as many characters as some rule has are made, which loses nothing.
Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets the default verdict;
repeated rows and repeated rules are allowed; an empty rule table gives the default everywhere; a rule whose path is
empty fits every path; null rules are ignored; other columns of ``pages`` are kept whatever their names, but columns
called host, path, rule or verdict are replaced by the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm.common import unused

#: The rules of the query (fixed values): host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (with ``url``) plus ``host, path, rule, verdict``; ``rules(host, path, verdict)`` may be of any size."""
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    rules = rules.select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict",
        F.sha2(F.concat_ws("\x00", "host", "path"), 256).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, 8))
    # One row: how many labels and characters rules have, as two short sorted arrays.
    shapes = rules.agg(F.array_sort(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels"), F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    host, path = host_and_path(F.col("url"))
    pairs = pages.select(host.alias("host"), path.alias("path")).distinct()
    parts = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(parts) >= n, F.substring_index("host", ".", -n)) for n in shapes["labels"]]) if shapes["labels"] else F.array().cast("array<string>")
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in shapes["lengths"]]) if shapes["lengths"] else F.array().cast("array<string>")
    made = pairs.select("host", "path", F.explode(suffixes).alias("e_host")).where("e_host is not null")
    made = made.select("host", "path", "e_host", F.explode(prefixes).alias("e_path")).where("e_path is not null")
    made = made.withColumn("full", F.sha2(F.concat_ws("\x00", "e_host", "e_path"), 256)).withColumn("short", F.substring("full", 1, 8))
    fits = made.join(rules, "short").where("full = digest")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("verdict"))
    chosen = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), rank).alias("best"))
    own_host, own_path, for_host, for_path, best = unused(pages, "__wl_host", "__wl_path", "__wl_for_host", "__wl_for_path", "__wl_best")
    chosen = chosen.select(F.col("host").alias(for_host), F.col("path").alias(for_path), F.col("best").alias(best))
    own = pages.withColumns({own_host: host, own_path: path})
    # Pages without a rule (nulls among them) stay; a page's host and path are never null.
    joined = own.join(chosen, (F.col(own_host) == F.col(for_host)) & (F.col(own_path) == F.col(for_path)), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")],
        F.col(own_host).alias("host"), F.col(own_path).alias("path"), F.col(f"{best}.rule").alias("rule"), F.coalesce(F.col(f"{best}.verdict"), F.lit(default)).alias("verdict"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url under the four fixed rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op7_url_filters": op7_url_filters}

ORACLES = {
    "op7_url_filters": r"""
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), own as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), rules(r_host, r_path, r_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
  select page_id, host, path, r_host || r_path as rule, r_verdict,
         row_number() over (partition by page_id order by length(r_host) + length(r_path) desc) as k
  from own left join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from fits where k = 1
"""
}

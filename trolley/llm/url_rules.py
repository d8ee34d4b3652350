"""URL filters: prefix rules as intervals of reversed-host keys, found by a sorted sweep.

A host is written with its labels reversed and each ended by a dot (``www.example.com`` ->
``com.example.www.``). All subdomains of a rule's host then form one interval of the sorted
keys, and the intervals of different rules are nested or disjoint. The sweep goes through
rules and urls in key order and keeps a stack of the rules it has entered, one slot per
label depth; a slot is active while its key is a prefix of the url's key.

DataFrame functions only. Urls are dealt over ``salts`` sweeps by row number, so no host
forms a hot group, and the (small) rule table goes to every sweep through the shuffle, not
by broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import others, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               keep: list[str] | None = None, salts: int | None = None) -> DataFrame:
    """One row per row of ``pages``: its ``keep`` columns (all by default; a column that is
    called like one of the new ones is left out), host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The
    longest fitting rule (characters of host and path, then of the host) wins; among equal
    rules with different verdicts the greater string does, so ``block`` beats ``allow``.
    No fitting rule: rule null, verdict ``default``. Null urls and urls without ``://`` have
    an empty host and path. Rules with a null or empty host or a null verdict are ignored,
    a null path counts as empty. Repeated rows stay repeated; empty tables give no rows."""
    spark = pages.sparkSession
    new = {"host", "path", "rule", "verdict"}
    keep = others(pages, new) if keep is None else [c for c in keep if c.lower() not in new]
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    by_host = (rules.filter("host is not null and host != '' and verdict is not null")
               .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
               .groupBy("host")
               .agg(F.sort_array(F.collect_set(F.struct(F.length("path").alias("n"), "path", "verdict")), asc=False).alias("paths"))
               .select(reversed_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("depth"), "host", "paths"))
    depth = by_host.agg(F.max("depth")).first()[0] or 0

    entered = by_host.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("kind"),
                             "depth", F.struct("key", "host", "paths").alias("open"))
    seen = (pages.select(F.struct(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).alias("page"))
            .select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"),
                    reversed_key(F.col("page.host")).alias("key"), F.lit(1).alias("kind"), "page"))
    w = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slots = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("open")), ignorenulls=True).over(w).alias(f"slot{d}")
             for d in range(1, depth + 1)]
    swept = (entered.unionByName(seen, allowMissingColumns=True)
             .select("kind", "key", "page", *slots).filter("kind = 1"))

    def fitting(d: int) -> Column:
        slot = F.col(f"slot{d}")
        hit = F.get(F.filter(slot["paths"], lambda p: F.col("page.path").startswith(p["path"])), F.lit(0))
        return F.when(F.col("key").startswith(slot["key"]) & hit.isNotNull(),
                      F.struct((F.length(slot["host"]) + hit["n"]).alias("n"), F.length(slot["host"]).alias("m"),
                               F.concat(slot["host"], hit["path"]).alias("rule"), hit["verdict"].alias("verdict")))
    best = (reduce(lambda a, b: F.greatest(a, b), map(fitting, range(1, depth + 1))) if depth > 1 else
            fitting(1) if depth else F.lit(None).cast("struct<rule:string,verdict:string>"))
    return (swept.withColumn("best", best)
            .select(*(F.col("page")[c].alias(c) for c in keep), "page.host", "page.path",
                    F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_frame(spark, RULES), keep=["page_id"])


SQL = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, row_number() OVER () AS n,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT n, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
  FROM p, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""

"""URL filter: host-suffix and path-prefix expressions, joined to rules on short digests.

A rule is (host, path, verdict). It fits its host and every subdomain, where the URL's path starts with the
rule's path; the longest fitting rule (host plus path, in characters) decides, ties going to ``block`` and then
to the smaller rule string. URLs that no rule fits get ``default``.

Each distinct (host, path) is expanded once, so a host that holds a third of all rows is expanded as often as it
has paths. Every rule is keyed by its host and its path up to the last slash; a URL whose path starts with the
rule's also starts with that, so equality on those keys loses no rule. The join takes the first 8 hex digits of
the key's SHA-256; the full digest and the rest of the path are confirmed after it.

Null URLs and URLs without ``://`` have empty host and path and match no rule; nor does an empty host. Rules with a null host or path fit
nothing. Repeated rows stay repeated, and repeated rules count once. host, path, rule and verdict replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query op7.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _expressions(host: str, path: str) -> F.Column:
    """All host suffixes crossed with all path prefixes that end in a slash, and the empty path."""
    suffixes = f"transform(sequence(1, size(split({host}, '[.]'))), i -> array_join(slice(split({host}, '[.]'), i, size(split({host}, '[.]'))), '.'))"
    prefixes = f"transform(sequence(1, size(split({path}, '/'))), i -> if(i = 1, '', concat(array_join(slice(split({path}, '/'), 1, i - 1), '/'), '/')))"
    return F.expr(f"array_distinct(flatten(transform({suffixes}, s -> transform({prefixes}, p -> concat(s, '\\n', p)))))")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) distinct: adds rule and verdict for those that a rule fits; others are left out."""
    keyed = rules.select(
        F.col("host").alias("r_host"),
        F.col("path").alias("r_path"),
        F.col("verdict").alias("r_verdict"),
        F.sha2(F.concat(F.col("host"), F.lit("\n"), F.regexp_extract("path", r"^(?s).*/|^", 0)), 256).alias("r_digest"),
    ).where("r_digest is not null").withColumn("short", F.substring("r_digest", 1, 8))
    wide = (
        urls.select("host", "path", F.explode(_expressions("host", "path")).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    fits = wide.join(keyed, "short").where((F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    order = F.struct(-F.length(rule), F.when(F.col("r_verdict") == "block", 0).otherwise(1), rule)
    return fits.groupBy("host", "path").agg(F.min_by(F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best")).select("host", "path", "best.*")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    host, path = split_url(F.col(url))
    split = pages.drop(*{"rule", "verdict"}.difference({url})).withColumns({"host": host, "path": path})
    #: A join that reads an aggregate where it was made can't be split for a hot URL; one that reads a table can. Files of URLs are far smaller than
    #: the URLs in memory, so Spark isn't left to broadcast them by the files' size.
    found = stored(match_rules(split.where("host <> ''").select("host", "path").distinct(), rules), "matched-urls")
    return split.join(found.hint("merge"), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return filter_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, coalesce(regexp_extract(r, '^[^/?#]*'), '') AS raw, r FROM rest),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(r, length(raw) + 1), '^[^?#]*'), '') AS path FROM parts),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ranked AS (
  SELECT u.*, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, v DESC) AS k
  FROM urls u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM ranked WHERE k = 1
"""

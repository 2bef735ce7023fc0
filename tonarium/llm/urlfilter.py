"""URL filters: allow and block rules over hosts and path prefixes.

Each URL is expanded into expressions, one for each host suffix and each prefix
of its path that has the length of some rule's path.  An expression's digest
is SHA-256 over host, separator and path; expressions meet rules in an equi-join on the digests' first 32
bits, full digests confirm, and of the confirmed rules the longest decides.
All of it is DataFrame expressions.

Rules are broadcast only up to BROADCAST_ROWS of them; beyond that the join
shuffles and adaptive execution splits a common prefix.  The rows of one URL
are reduced to its best rule before anything is shuffled.

Cases: a null url, or one without ``://``, has an empty host and path and fits
no rule; repeated rows each get their verdict; rules of the same host and path
count once, and block wins among them; of two rules as long as each other that
fit one url, the one of the longer host wins (its path is the shorter);
without rules every verdict is the default; null rules are ignored; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Rules that may be sent to every executor: about 20 MB.
BROADCAST_ROWS = 100_000
#: Stands between host and path; no URL holds it.
SEPARATOR = "\x00"
#: Hexadecimal digits of a short hash prefix.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the production list.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (ASCII lower case) and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
        }
    )


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else
    null), verdict (the rule's, else ``default``)."""
    pages = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    listed = rules.where("host is not null and path is not null and verdict is not null")
    # host and path stay apart: "b" with "c/" is not "bc" with "/"
    listed = listed.groupBy(F.concat_ws(SEPARATOR, "host", "path").alias("rule"), F.length("path").alias("n")).agg(F.max("verdict").alias("rule_verdict"))
    listed = written(listed, "url-rules")
    lengths = [r.n for r in listed.select("n").distinct().collect()]  # at most the longest path
    listed = listed.select("rule", "rule_verdict", F.sha2("rule", 256).alias("rule_digest"), F.substring(F.sha2("rule", 256), 1, PREFIX).alias("short"))
    if not lengths:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(
        F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: F.when(n <= F.length("path"), F.substring(F.col("path"), F.lit(1), n))),
        lambda p: p.isNotNull(),
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, F.lit(SEPARATOR), p), 256))))
    tried = pages.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", F.explode_outer(expressions).alias("digest"))
    met = tried.join(listed, F.substring("digest", 1, PREFIX) == F.col("short"), "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("n"), F.instr("rule", SEPARATOR).alias("host_n"), F.col("rule_verdict").alias("verdict"), "rule"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select("page_id", "host", "path", F.replace(F.col("best.rule"), F.lit(SEPARATOR), F.lit("")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under the production rules."""
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE = """
WITH rules(host, path, verdict) AS (VALUES %s),
parsed AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT p.r, u.host || u.path AS rule, u.verdict,
         row_number() OVER (PARTITION BY p.r ORDER BY length(u.host || u.path) DESC) AS k
  FROM parsed p JOIN rules u
    ON (p.host = u.host OR suffix(p.host, '.' || u.host)) AND starts_with(p.path, u.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.r = p.r AND f.k = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

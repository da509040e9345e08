"""URL filter rules by hashed host-suffix and path-prefix expressions.

Every URL expands into its host suffixes combined with its path prefixes, as deep and as
long as the rule table goes, since longer ones fit no rule; a rule is one such expression.
Expressions meet rules by an equi-join on a short prefix of their
SHA-256 digest, the full digest confirms the match, and the longest rule decides. URLs
without a rule get the default verdict.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule;
empty host labels stay as they are; a very long URL has no more expressions than the rules
ask for; repeated rows are judged one by one; of two rules with one expression the greater
verdict ("block") wins; an empty table gives an empty result, an empty rule table the
default verdict; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule as host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEFAULT = "allow"
#: Hex digits of the digest that the join compares.
SHORT = 8
#: Copies of the rule table, so that a hot expression is joined in as many tasks.
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class Reach(NamedTuple):
    """How far a rule table goes: labels and characters of its hosts, characters of its paths."""

    labels: int
    host: int
    path: int


def reach(rules: DataFrame) -> Reach:
    """One row of greatest sizes, the only thing of the rules that the driver sees."""
    host = F.regexp_extract("rule", "^[^/]*", 0)
    sizes = rules.select(F.size(F.split(host, r"\.")).alias("labels"), F.length(host).alias("host"), (F.length("rule") - F.length(host)).alias("path"))
    row = sizes.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in Reach._fields]).first()
    return Reach(*row)


def expressions(host: Column, path: Column, far: Reach) -> Column:
    """The host suffixes at label borders, each with the path prefixes that end in `/` and the whole path,
    up to the rules' sizes."""
    labels = F.split(F.substring_index(host, ".", -max(far.labels, 1)), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.filter(hosts, lambda h: F.length(h) <= far.host)
    steps = F.split(F.substring(path, 1, far.path), "/")
    prefixes = F.when(
        F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.length(path) <= far.path, F.array(path)).otherwise(F.array().cast("array<string>"))
    prefixes = F.array_union(prefixes, whole)
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page.

    A page's matches are gathered by row, never by host, so a hot host spreads; rules are
    keyed by digest and copied per salt, so a hot expression does too.
    """
    digest = lambda c: F.sha2(c, 256)
    known = rules.select("verdict", "rule", digest(F.col("rule")).alias("full")).select(
        F.substring("full", 1, SHORT).alias("_short"), F.col("full").alias("_full"), F.col("rule").alias("_rule"),
        F.col("verdict").alias("_verdict"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    found = expressions(F.col("host"), F.col("path"), reach(rules))
    asked = rows.select("*", F.explode_outer(found).alias("expr")).select(
        "page_id", "host", "path", "_row", digest(F.col("expr")).alias("full"), F.pmod("_row", F.lit(SALTS)).cast("int").alias("salt")
    )
    on = (F.substring("full", 1, SHORT) == F.col("_short")) & (F.col("salt") == F.col("_salt"))
    confirmed = F.col("full") == F.col("_full")
    best = F.max(F.when(confirmed, F.struct(F.length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))))
    return (
        asked.join(known, on, "left")
        .groupBy("_row", "page_id", "host", "path")
        .agg(best.alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def kept_pages(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_ids whose verdict is allow."""
    return verdicts(pages, rules, default).filter("verdict = 'allow'").select("page_id")


SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS r FROM u),
p AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.r, rules.verdict, rh || rp AS rule, row_number() OVER (PARTITION BY p.r ORDER BY length(rh || rp) DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.r = m.r AND m.k = 1
"""

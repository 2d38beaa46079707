"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL yields every (host suffix, path prefix) expression that a rule could have; an
expression's 32-bit hash prefix is equi-joined with the rules' prefixes, the full SHA-256
digests confirm, and the longest rule wins (ties: the longer host, then block before allow).

Defined results: a null URL or one without ``://`` has an empty host and path; no rule fits it
and the default verdict holds. Repeated rows each get their own result. Rules with an empty
host fit nothing. Any other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small, table

#: Rules of the registered query: (action, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules as a local relation of (action, rule_host, rule_path)."""
    rows = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for a, h, p in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("action", "rule_host", "rule_path")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _host_path(df: DataFrame, url: str) -> DataFrame:
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    df = df.withColumn("__rest", rest)
    return df.withColumns({
        "host": ascii_lower(F.regexp_extract("__rest", r"^[^/?#]*", 0)),
        "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1),
    }).drop("__rest")


def _digest(host: Column, path: Column) -> Column:
    # host and path are separated by a byte that a host can't hold
    return F.sha2(F.concat(host, F.lit("/\u0001"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (null if none fits) and verdict.

    Expansions are bounded by the rules, not by the URL: only as many labels as the longest
    rule host and only path lengths that occur in the rules, which loses no match. The rules
    are broadcast if counted to be few; else the join shuffles on the hash prefix, where the
    rule side has few rows a key and AQE splits hot keys of the URL side.
    """
    rules = rules.where((F.col("rule_host") != "") & F.col("rule_path").isNotNull()).dropDuplicates(["action", "rule_host", "rule_path"])
    shape = rules.agg(
        F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()  # one row: the lengths are a handful of integers below the longest rule path
    labels, lengths = shape["labels"] or 0, shape["lengths"] or []
    keyed = rules.select(
        _digest(F.col("rule_host"), F.col("rule_path")).alias("__rule_digest"),
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("length"),
            F.length("rule_host").alias("host_length"),
            F.col("action").alias("action"),
            F.concat("rule_host", "rule_path").alias("rule"),
        ).alias("__rule"),
    ).withColumn("__prefix", F.substring("__rule_digest", 1, PREFIX_HEX))

    urls = _host_path(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url")
    urls = urls.select(F.monotonically_increasing_id().alias("__row"), "__id", "host", "path")
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.greatest(F.size(parts) - labels + 1, F.lit(1)), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    ) if labels else F.array().cast("array<string>")
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.struct(n.alias("n"), F.substring(F.col("path"), 1, n).alias("p"))), lambda x: F.length(x["p"]) == x["n"]) if lengths else F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("p")))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda x: _digest(h, x["p"]))))
    asked = urls.select("__row", "__id", "host", "path", F.explode_outer(pairs).alias("__digest"))
    asked = asked.withColumn("__prefix", F.substring("__digest", 1, PREFIX_HEX))
    met = asked.join(small(keyed), "__prefix", "left")
    fits = F.when(F.col("__digest") == F.col("__rule_digest"), F.col("__rule"))
    best = met.groupBy("__row").agg(
        F.any_value("__id").alias(id_col), F.any_value("host").alias("host"), F.any_value("path").alias("path"), F.max(fits).alias("__best"),
    )
    return best.select(
        id_col, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.action"), F.lit(default)).alias("verdict")
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


def _oracle() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return f"""
WITH rules(action, rhost, rpath) AS (VALUES {rules}),
cut AS (
  SELECT page_id, row_number() OVER () AS rn,
         CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rn,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ranked AS (
  SELECT p.*, r.action, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY rn ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC, r.action DESC) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT_VERDICT}') AS verdict FROM ranked WHERE k = 1
"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": _oracle()}

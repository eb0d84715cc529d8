"""Allow and block rules on hosts and paths, by a sorted sweep over reversed hosts.

With its labels reversed a host is a key in whose order a domain and all its subdomains are one
interval, and the intervals of rules nest. Rule starts, rule ends and page keys are merged in key
order. Running down that order, the depth counts the rules that are open, and the rule that was
opened last at each depth up to the current one is the stack of active rules; a page takes from
its stack the longest rule whose path its own path starts with.

A sweep covers one range of keys and one of many salts of the pages, so neither a common host nor
a common domain meets in one task. Rules are repeated for each salt of their own range only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import table

#: The rules that the registered query applies: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT_VERDICT = "allow"
#: About one range of keys for so many rule hosts.
RULES_PER_RANGE = 4096

_RULE = "array<struct<rule:string,host:string,path:string,verdict:string>>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _after(key: Column) -> Column:
    """The first key behind all that start with ``key``: a slash is next to a dot and in no host."""
    return F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def _nesting(hosts: DataFrame) -> int:
    """How many rule hosts lie inside each other at most."""
    labels = F.split(F.substring("key", F.lit(1), F.length("key") - 1), "\\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )
    chains = hosts.select(F.col("key").alias("own"), F.explode(above).alias("key")).join(hosts.select("key"), "key")
    return chains.groupBy("own").count().agg(F.max("count")).first()[0] or 0


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; rows are repeated or null as they come.

    A null url, or one without ``://``, has an empty host and path. ``rules`` has host, path and
    verdict; rules with a null in them are ignored. Among rules that fit, the longest ``host/path``
    wins, then the longer host, then block. Without a fitting rule, rule is null and the verdict
    is ``default``. Columns of ``pages`` with one of the four names are replaced. No pages: no rows.
    """
    spark = pages.sparkSession
    known = rules.select("host", "path", "verdict").dropna()
    rule = F.struct(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    hosts = known.groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_set(rule).cast(_RULE).alias("rules"))
    depths = _nesting(hosts)
    cuts = hosts.filter(F.pmod(F.xxhash64("key"), F.lit(RULES_PER_RANGE)) == 0).select("key").orderBy("key")
    splitters = F.array(*(F.lit(r["key"]) for r in cuts.collect())).cast("array<string>")
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def range_of(key: Column) -> Column:
        return F.size(F.filter(splitters, lambda s: s <= key))

    # A rule opens again at the start of every range it reaches into.
    spans = hosts.select("key", _after(F.col("key")).alias("end"), "rules")
    spans = spans.select("*", F.explode(F.sequence(range_of(F.col("key")), range_of(F.col("end")))).alias("range"))
    opens = F.greatest("key", F.coalesce(F.get(splitters, F.col("range") - 1), F.lit("")))
    spans = spans.withColumn("open", opens).filter("open < end")
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    edge = F.explode(
        F.array(
            F.struct(F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step")),
            F.struct(F.col("open").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step")),
        )
    )
    events = spans.select("range", "salt", F.length("key").alias("size"), "rules", edge.alias("e"))
    events = events.select("range", "salt", "e.*", "size", "rules")

    body = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")))
    points = pages.select(body.alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    at = host_key(F.col("host"))
    points = points.select(
        "page", "host", "path", at.alias("at"), range_of(at).alias("range"),
        F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(2).alias("kind"), F.lit(0).alias("step"), F.lit(0).alias("size"),
    )
    order = Window.partitionBy("range", "salt").orderBy("at", "kind", "size")
    sweep = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.unionByName(events, allowMissingColumns=True).withColumn("depth", F.sum("step").over(sweep))
    opened = F.col("kind") == 1
    slots = [
        F.last(F.when(opened & (F.col("depth") == d), F.col("rules")), ignorenulls=True).over(sweep).alias(f"slot{d}")
        for d in range(1, depths + 1)
    ]
    swept = swept.select("*", *slots).filter("kind = 2")
    none = F.array().cast(_RULE)
    stack = F.flatten(F.array(none, *(F.when(F.col("depth") >= d, F.col(f"slot{d}")).otherwise(none) for d in range(1, depths + 1))))
    fitting = F.filter(stack, lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(F.length(r["rule"]), F.length(r["host"]), r["verdict"] == "block", r["rule"].alias("rule"), r["verdict"].alias("verdict")),
    )
    return swept.withColumn("best", F.array_max(ranked)).select(
        "page.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fixed = (F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES)
    rules = spark.range(1).select(F.inline(F.array(*fixed)))
    return match_rules(pages, rules).drop("url")


def _sql() -> str:
    ranked = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ranked)
    rest = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
    return f"""
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE '{DEFAULT_VERDICT}' END AS verdict
FROM (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce({rest}, '') AS rest FROM pages)
)
"""


OP6_SQL = _sql()

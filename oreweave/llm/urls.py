"""Operator 7, URL filters.

Each URL is expanded into expressions, every suffix of its host that has as many labels as some rule's host with every prefix of
its path that is as long as some rule's path; these meet the rules on the first hexadecimal digits of a digest, whole digests
are compared, and of the rules left the longest decides.

Edge cases. A null url, or one without ``://``, has an empty host and path and meets no rule but one with
an empty host. Repeated rows are judged once and returned as often as they came; of rules that are as long and tie, the longer
host decides, then ``block``. URLs of any length are read whole. An empty table gives an empty result. Columns but ``page_id``
and ``url`` are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, small, stored

#: Host, path and verdict of the rules that the query applies.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, labels: list[int]) -> Column:
    """The ends of a host that have as many labels as one of ``labels``."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: n <= F.size(p)), lambda n: F.array_join(F.slice(p, F.size(p) - n + 1, n), ".")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", digits: int = 8, few: int = 100_000) -> DataFrame:
    """``page_id, url`` and rules ``host, path, verdict`` to ``page_id, host, path, rule, verdict``.

    ``rules`` are broadcast only if at most ``few``. Of equal rules ``block`` wins. The lengths of the rules' paths and the
    numbers of labels of their hosts are held in an array each; a page gives as many expressions as these have pairs, however long its host.
    """
    spark = pages.sparkSession
    ruled = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("_h"), F.length("path").alias("_p"), F.size(F.split("host", r"\.")).alias("_l"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("_digest"), F.col("verdict").alias("_verdict"))
    ruled = stored(ruled.groupBy("rule", "_h", "_p", "_l", "_digest").agg(F.max("_verdict").alias("_verdict")).withColumn("_key", F.substring("_digest", 1, digits)), "rules")
    numbers = lambda c: sorted(r[0] for r in ruled.select(c).distinct().collect())
    lengths, labels = numbers("_p"), numbers("_l")
    once = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("_n"))
    fit = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes(F.col("host"), labels), lambda h: F.transform(fit, lambda n: F.concat_ws("\n", h, F.substring(F.col("path"), F.lit(1), n)))))
    wide = once.withColumn("_said", F.explode_outer(F.array_distinct(pairs))).withColumn("_full", F.sha2("_said", 256)).withColumn("_short", F.substring("_full", 1, digits))
    met = wide.join(small(ruled, few), (F.col("_short") == F.col("_key")) & (F.col("_full") == F.col("_digest")), "left")
    best = met.groupBy("page_id", "host", "path", "_n").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(F.col("_h") + F.col("_p"), "_h", "_verdict", "rule"))).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).drop("_copy")


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


SQL = r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from {pages}
)
select page_id, host, path,
  case when ('.' || host) like '%.example.com' and starts_with(path, '/en/7') then 'example.com/en/7'
       when ('.' || host) like '%.example.net' and starts_with(path, '/de/8') then 'example.net/de/8'
       when ('.' || host) like '%.com' and starts_with(path, '/en/') then 'com/en/'
       when ('.' || host) like '%.net' and starts_with(path, '/de/') then 'net/de/'
       when ('.' || host) like '%.org' and starts_with(path, '/es/') then 'org/es/' end as rule,
  case when ('.' || host) like '%.example.com' and starts_with(path, '/en/7') then 'allow'
       when ('.' || host) like '%.example.net' and starts_with(path, '/de/8') then 'block'
       when ('.' || host) like '%.com' and starts_with(path, '/en/') then 'block'
       when ('.' || host) like '%.net' and starts_with(path, '/de/') then 'allow'
       when ('.' || host) like '%.org' and starts_with(path, '/es/') then 'block' else 'allow' end as verdict
from p
"""

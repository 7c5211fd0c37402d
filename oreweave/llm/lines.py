"""Operator 4, line dedup by distinct-site spread. DataFrame operations only.

Lines are compared by a 128-bit hash of their words. For each hash the sites (here: sources) are gathered in a
HyperLogLog sketch that merges before and after the shuffle. Lines whose estimate is near the threshold are
counted exactly. A line on at least ``min_sites`` sites is boilerplate: it stays in its first place (smallest id,
then earliest line) and goes everywhere else.

Edge cases. A null text has no lines and stays null. Lines of fewer than ``min_words`` words are never counted
or taken out. A null site counts as one site of its own. Rows that repeat an id and a text share their
decisions; of rows that tie for a line's first place, those of the text with the smallest hash keep it. A document that
loses all its words is ``emptied``. Texts of any length are read whole, a row at a time. An empty table gives an
empty result. Columns named as the three results give way to them; all others are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, rest_of, small, stored, text_hash

_SPACES = r"[\x20\x09-\x0D]+"
#: log2 of the registers of a sketch; its relative standard error is about 1.04 / sqrt(registers), here 3 %.
LG_K = 10
#: Estimates within this share of the threshold are counted exactly: more than six standard errors.
BAND = 0.2


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, _SPACES, " "))


def _hashed(text: Column, min_words: int) -> Column:
    """For each line: its place, its words and its hash; the hash is null where the line is too short to count."""

    def one(line: Column, at: Column) -> Column:
        return let(normal(line), lambda x: let(F.when(x == "", 0).otherwise(F.size(F.split(x, " "))), lambda n: F.struct(at.alias("at"), n.alias("words"), F.when(n >= min_words, F.xxhash64(x)).alias("h1"), F.when(n >= min_words, F.xxhash64(F.lit(1), x)).alias("h2"))))

    return F.transform(F.split(text, "\n"), one)


def spread_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, min_words: int = 3) -> DataFrame:
    """Boilerplate lines: ``h1, h2`` and their first place ``first_id, first_t, first_at``."""
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"), text_hash(F.col("text")).alias("t"), F.explode(F.filter(_hashed(F.col("text"), min_words), lambda x: x["h1"].isNotNull())).alias("x"))
    rows = rows.select("doc_id", "site", "t", "x.at", "x.h1", "x.h2")
    sketched = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "t", "at")).alias("first"))
    sketched = sketched.withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= min_sites * (1 - BAND)).select("h1", "h2", "sites", "first")
    sketched = stored(sketched, "line-spread")
    near = sketched.filter(F.col("sites") < min_sites * (1 + BAND)).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    exact = rows.join(small(near, 200_000), (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2")
    sure = sketched.filter(F.col("sites") >= min_sites * (1 + BAND)).select("h1", "h2", "first")
    checked = sketched.join(exact, ["h1", "h2"]).select("h1", "h2", "first")
    return sure.unionByName(checked).select("h1", "h2", F.col("first.doc_id").alias("first_id"), F.col("first.t").alias("first_t"), F.col("first.at").alias("first_at"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, min_words: int = 3, few: int = 200_000) -> DataFrame:
    """Every row of ``docs`` with its ``text`` cut, and ``n_lines``, ``n_removed``, ``emptied``, which replace columns of these names.

    The boilerplate lines are broadcast only if at most ``few``. What comes back from that join is one short row a
    document that loses lines.
    """
    common = spread_lines(docs, site, min_sites, min_words).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first_id", "first_t", "first_at")
    common = small(stored(common, "boilerplate"), few)
    keyed = docs.select("doc_id", "text", text_hash(F.col("text")).alias("t"), rest_of(docs, "text").alias("rest"))
    at = keyed.select(F.col("doc_id").alias("in_id"), F.col("t").alias("in_t"), F.explode(F.filter(_hashed(F.col("text"), min_words), lambda x: x["h1"].isNotNull())).alias("x"))
    hit = at.join(common, (F.col("x.h1") == F.col("c1")) & (F.col("x.h2") == F.col("c2")))
    hit = hit.filter(~(F.col("in_id").eqNullSafe(F.col("first_id")) & (F.col("in_t") == F.col("first_t")) & (F.col("x.at") == F.col("first_at"))))
    gone = hit.select("in_id", "in_t", F.col("x.at").alias("at")).distinct().groupBy("in_id", "in_t").agg(F.sort_array(F.collect_list("at")).alias("gone"))
    out = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("t") == F.col("in_t")), "left")
    kept = let(F.split("text", "\n"), lambda lines: F.array_join(F.array_compact(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x))), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    made = out.select("rest", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    own = [F.col("rest").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed", "emptied")]
    return made.select(*own, "text", "n_lines", "n_removed", emptied.alias("emptied"))


SQL_PARTS = r"""
{p}_d as (select row_number() over () as r, * from {docs}),
{p}_l as (
  select r, doc_id, source, text, x, i, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')) as line
  from (select r, doc_id, source, text, unnest(string_split(text, chr(10))) as x, unnest(range(0, len(string_split(text, chr(10))))) as i from {p}_d where text is not null)
),
{p}_c as (
  select line, min({{'d': doc_id, 't': text, 'i': i}}) as first from {p}_l where line <> '' and len(string_split(line, ' ')) >= 3
  group by line having count(distinct coalesce('s' || source, '')) >= 10
),
{p}_k as (
  select r, count(*) as n_lines, count(*) filter (where gone) as n_removed, string_agg(x, chr(10) order by i) filter (where not gone) as kept
  from (select l.*, c.line is not null and not (l.doc_id is not distinct from c.first.d and l.text = c.first.t and l.i = c.first.i) as gone from {p}_l l left join {p}_c c on c.line = l.line) group by r
),
{p} as (
  select d.* exclude (r, text), case when d.text is null then null else coalesce(kept, '') end as text, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
    (coalesce(n_removed, 0) > 0 and not regexp_matches(coalesce(kept, ''), '[^\x20\x09-\x0D]')) as emptied
  from {p}_d d left join {p}_k k using (r)
)
"""
SQL = "with " + SQL_PARTS.replace("{p}", "cut") + " select doc_id, n_lines, n_removed, emptied, md5(coalesce(text, '')) as kept_md5 from cut"

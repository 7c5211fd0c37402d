"""Operator 8, quality rules. DataFrame operations only.

Each text gets base measures; then each normalised line (A-Z lowered, runs of spaces as one) is counted over the
documents of its host. Lines in more documents than the limits allow are taken out, and a document that loses
too large a share of its words that way is rejected.

Edge cases. A null or wordless text has no words, zero measures and fails. A null host is a host of its own.
Documents are told apart by id and text: copies of a text under other ids count, rows that repeat both count once. Rows that
tie or repeat are judged alike. Texts of any length are measured whole. An empty table gives an empty result. Columns beside
those named are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small, stored, text_hash, words_of

SYMBOLS = r"[#*$%&|<>]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normal_line(line: Column) -> Column:
    """What lines are compared by."""
    return F.translate(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), _UPPER, _LOWER)


def repeated_words(words: Column, k: int = 3) -> Column:
    """Words inside runs of ``k`` words that the text has more than once, the first included.

    Run hashes are sorted with their places; a run is repeated if a neighbour in that order is equal. The places
    then cover ``k`` words each, less where the next one begins sooner. Linear but for the sorting.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(k)]).alias("h"), i.alias("i")))
    same = lambda runs, j, d: F.coalesce(F.get(runs, j + d)["h"] == F.get(runs, j)["h"], F.lit(False))
    places = lambda runs: F.sort_array(F.filter(F.transform(runs, lambda r, j: F.when(same(runs, j, -1) | same(runs, j, 1), r["i"])), lambda i: i.isNotNull()))
    cover = lambda at: F.aggregate(F.transform(at, lambda i, j: F.least(F.lit(k), F.coalesce(F.get(at, j + 1) - i, F.lit(k)))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(words) > k, let(F.sort_array(hashes(words)), lambda runs: let(places(runs), cover))).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """One struct with the word count and the four base measures."""

    def of(w: Column) -> Column:
        n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
        worded = let(F.filter(lines_of(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(
            n(F.size(w)).alias("n_words"),
            n(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
            n(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            n(worded).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def rate_quality(docs: DataFrame, host: str = "source", least_docs: int = 50, most_share: float = 0.02, least_kept: float = 0.5, min_words: int = 50, most_repeated: int = 50, few: int = 1_000_000) -> DataFrame:
    """``doc_id, text`` and a host to ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_gone, text, kept``:
    ``n_gone`` words stood in lines taken out, ``text`` is what stays.

    A line is taken out of a host that has it in at least ``least_docs`` documents and in more than ``most_share`` of its
    documents; a document is rejected if less than ``least_kept`` of its words stay. The frequent lines are
    broadcast only if at most ``few``.
    """
    read = docs.select("doc_id", F.col(host).alias("host"), "text")
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    line = lambda x: F.xxhash64(normal_line(x))
    lines = F.transform(F.filter(lines_of(F.col("text")), worded), lambda x: let(normal_line(x), lambda y: F.struct(F.xxhash64(y).alias("line"), F.size(F.split(y, " ")).alias("words"))))
    # a text's lines once, with the number of documents that have it
    full = read.filter(worded(F.col("text"))).withColumn("t", text_hash(F.col("text")))
    ids = full.select("host", "t", "doc_id").distinct().groupBy("host", "t").agg(F.count("*").alias("docs"))
    texts = full.select("host", "t", lines.alias("lines")).groupBy("host", "t").agg(F.first("lines").alias("lines"))
    texts = stored(texts.alias("x").join(ids.alias("y"), F.col("x.host").eqNullSafe(F.col("y.host")) & (F.col("x.t") == F.col("y.t"))).select("x.host", "x.t", "lines", "docs"), "quality-lines")
    per_host = texts.groupBy("host").agg(F.sum("docs").alias("docs"))
    found = texts.select("host", "docs", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).groupBy("host", "line").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs)
    common = found.alias("f").join(per_host.alias("h"), F.col("f.host").eqNullSafe(F.col("h.host"))).filter(F.col("n") > F.col("docs") * most_share)
    common = small(stored(common.select(F.col("f.host").alias("of_host"), F.col("line").alias("of_line")), "quality-common"), few)
    hit = texts.select("host", "t", F.explode("lines").alias("x")).join(common, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("x.line") == F.col("of_line")))
    gone = hit.groupBy(F.col("host").alias("in_host"), F.col("t").alias("in_t")).agg(F.sum("x.words").alias("n_gone"), F.collect_set("x.line").alias("gone"))
    base = read.select("doc_id", "host", "text", text_hash(F.col("text")).alias("t"), measures(F.col("text")).alias("m")).select("doc_id", "host", "text", "t", "m.*")
    base = base.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    out = base.join(gone, F.col("host").eqNullSafe(F.col("in_host")) & (F.col("t") == F.col("in_t")), "left").withColumn("n_gone", F.coalesce("n_gone", F.lit(0)).cast("long"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~(worded(x) & F.array_contains("gone", line(x)))), "\n")
    depleted = (F.col("n_gone") > 0) & (F.col("n_words") - F.col("n_gone") < F.col("n_words") * least_kept)
    measured = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_gone"]
    return out.select(*measured, F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), (~F.col("base_failed") & ~depleted).alias("kept"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from {docs}
), runs as (select r, i, [w[i], w[i + 1], w[i + 2]] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from runs) where n > 1),
covered as (select r, sum(least(3, coalesce(nxt - i, 3)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nxt from twice) group by r),
lined as (select distinct source, doc_id, text, translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line
  from (select source, doc_id, text, unnest(lines) as x from d)),
hosts as (select source, count(*) as texts from (select distinct source, doc_id, text from d where len(lines) > 0) group by source),
often as (select l.source, l.line from (select source, line, count(*) as n from lined group by all) l join hosts h on h.source is not distinct from l.source where n >= 50 and n > texts * 0.02::double),
parts as (select r, source, translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line from (select r, source, unnest(lines) as x from d)),
gone as (select r, sum(len(string_split(p.line, ' '))) as n from parts p join often o on o.source is not distinct from p.source and o.line = p.line group by r)
select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words,
  (len(w) < 50 or 100 * coalesce(c.n, 0) > 50 * len(w)) as base_failed,
  (not (len(w) < 50 or 100 * coalesce(c.n, 0) > 50 * len(w)) and not (coalesce(g.n, 0) > 0 and len(w) - coalesce(g.n, 0) < len(w) * 0.5::double)) as kept
from d left join covered c using (r) left join gone g using (r)
"""

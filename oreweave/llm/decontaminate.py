"""Operator 6, benchmark decontamination. DataFrame operations only.

A window has as many words as a benchmark item (a shorter document is one window). Words have A-Z lowered; a shingle
is five words, or all words of a shorter item. A window can reach the similarity only if it holds ``need`` shingles of an item,
so among any ``n - need + 1`` of the item's it holds one; the rarest in the documents are taken as the item's anchors.
One scan finds the places of all items' shingles, documents with an anchor of an item are its candidates, and
their places give the window starts that can reach ``need``. These bounds are exact. Each such window
gets a 64-bit SimHash of all its shingles and is held against the item's fingerprint by blocks: two fingerprints within
the radius agree in one of ``radius + 1`` blocks of bits at least. Pairs within the radius are verified by weighted-shingle
similarity, the sum of the smaller over the sum of the larger counts of each shingle.

Edge cases. Null, empty and wordless texts and items match nothing. Texts of any length are searched whole. Rows that repeat an id
and a text are reported once. Equal items, and items that tie, are each reported. Empty tables give an empty result. Columns
but ``doc_id``, ``item_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small, stored, text_hash, words_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text: Column, k: int) -> Column:
    """Hashes of the runs of k words, in order; as many as there are words less k - 1."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return let(words_of(F.translate(text, _UPPER, _LOWER)), lambda w: F.when(F.size(w) >= k, runs(w)).otherwise(F.array().cast("array<bigint>")))


def simhash(hashes: Column) -> Column:
    """Bit b is set if most of the hashes have it. Four counts of 16 bits share a long."""

    def lanes(h: Column, j: int) -> Column:
        x = F.shiftrightunsigned(h, 4 * j)
        return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x.bitwiseAND(F.lit(1 << b)), 15 * b) for b in range(4)])

    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(16)])
    sums = F.aggregate(hashes, zero, lambda a, h: F.struct(*[(a[f"c{j}"] + lanes(h, j)).alias(f"c{j}") for j in range(16)]))
    bit = lambda s, n, i: F.when(F.shiftrightunsigned(s[f"c{i // 4}"], 16 * (i % 4)).bitwiseAND(F.lit(65535)) * 2 > n, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
    return let(sums, lambda s: reduce(lambda a, b: a.bitwiseOR(b), [bit(s, F.size(hashes), i) for i in range(64)]))


def blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each of the radius + 1 blocks."""
    n = radius + 1
    bounds = [64 * i // n for i in range(n + 1)]
    return list(zip(bounds, [b - a for a, b in zip(bounds, bounds[1:], strict=False)], strict=False))


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of hashes."""
    times = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h))))
    return let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, k: int = 5, radius: int = 24, few: int = 1_000_000) -> DataFrame:
    """``doc_id, text`` and ``item_id, text`` to ``doc_id, t, item_id, similarity`` (``t``: hash of the text), one row for each pair
    that reaches ``least`` in some window, with its best similarity.

    A fingerprint differs from its item's in about 11 bits of 64 at a similarity of 0.75, and in more than 24 hardly
    ever. What is broadcast has at most ``few`` rows and the bytes that :func:`common.small` allows.
    """
    n_words = F.size(words_of(F.col("text")))
    items = benchmark.select("item_id", "text", n_words.alias("size")).filter("size > 0").withColumn("k", F.least(F.lit(k), F.col("size")))
    hashed = reduce(lambda a, j: F.when(F.col("k") == j, shingles(F.col("text"), j)).otherwise(a), range(1, k + 1), F.lit(None).cast("array<bigint>"))
    items = items.select("item_id", "size", "k", hashed.alias("ih"))
    items = stored(items.withColumn("fp", simhash(F.col("ih"))).withColumn("need", F.ceil(F.size("ih") * least).cast("int")).withColumn("i", F.xxhash64("item_id", "ih")).dropDuplicates(["item_id", "ih"]), "benchmark")
    kinds = sorted(r[0] for r in items.select("k").distinct().collect())  # k numbers at most
    if not kinds:
        none = F.lit(None).cast(benchmark.schema["item_id"].dataType)
        return docs.select("doc_id", text_hash(F.col("text")).alias("t"), none.alias("item_id"), F.lit(0.0).alias("similarity")).filter("false")
    # places of any item's shingles: one scan, no row more than there are words
    keyed = docs.select("doc_id", "text", text_hash(F.col("text")).alias("t"))
    parts = stored(items.select("i", "k", "need", F.size("ih").alias("runs"), F.explode(F.array_distinct("ih")).alias("sh")), "benchmark-shingles")
    known = small(stored(parts.select(F.col("k").alias("ik"), "sh").distinct(), "benchmark-known"), few)
    at = reduce(DataFrame.unionByName, [keyed.select("doc_id", "t", F.lit(j).alias("k"), F.posexplode(shingles(F.col("text"), j)).alias("p", "h")) for j in kinds])
    places = stored(at.join(known, (F.col("h") == F.col("sh")) & (F.col("k") == F.col("ik"))).select("doc_id", "t", "k", "p", "sh"), "places")
    # anchors: of n different shingles the n - need' + 1 rarest, need' being what different ones must at least be met
    rare = parts.join(places.groupBy("k", "sh").agg(F.count("*").alias("df")), ["k", "sh"], "left")
    ranked = rare.groupBy("i", "k", "need", "runs").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sh"))).alias("all"))
    spare = F.col("runs") - F.col("need") + 1  # a window that meets none of so many runs, repeats of a shingle counted one by one, falls short
    anchors = small(stored(ranked.select("i", "k", F.explode(F.slice("all", F.lit(1), F.least(spare, F.size("all")))).alias("a")).filter("a.df > 0").select("i", "k", F.col("a.sh").alias("sh")), "anchors"), few)
    pairs = places.join(anchors, ["k", "sh"]).select("doc_id", "t", "i", "k").distinct()
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.t") == F.col(f"{b}.t")) & (F.col(f"{a}.k") == F.col(f"{b}.k"))
    met = pairs.alias("x").join(places.alias("y"), same("x", "y")).select("x.doc_id", "x.t", "x.i", "x.k", "y.p", "y.sh")
    met = met.join(small(parts, few), ["i", "k", "sh"])
    # places of an item's shingles in a document, in order; any ``need`` of them in a row that lie within one window make its starts candidates
    placed = met.groupBy("doc_id", "t", "i", "k", "need", "runs").agg(F.sort_array(F.collect_set("p")).alias("ps")).filter(F.size("ps") >= F.col("need"))
    last = lambda n: F.get("ps", n + F.col("need") - 1)
    starts = F.flatten(F.transform("ps", lambda p, n: F.when(last(n) - p < F.col("runs"), F.sequence(F.greatest(F.lit(0), last(n) - F.col("runs") + 1), p)).otherwise(F.array().cast("array<int>"))))
    found = placed.select("doc_id", "t", F.struct("i", "k", "runs", F.array_distinct(starts).alias("starts")).alias("w")).filter(F.size("w.starts") > 0)
    found = found.groupBy(F.col("doc_id").alias("in_id"), F.col("t").alias("in_t")).agg(F.collect_list("w").alias("windows"))
    flat = stored(found.select("in_id", "in_t", F.explode("windows").alias("w")).select("in_id", "in_t", "w.*"), "windows")
    looked = keyed.join(small(flat.select("in_id", "in_t").distinct(), few), F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("t") == F.col("in_t")), "left_semi").dropDuplicates(["doc_id", "t"])
    grams = reduce(DataFrame.unionByName, [looked.select("doc_id", "t", F.lit(j).alias("k"), shingles(F.col("text"), j).alias("g")) for j in kinds])
    own = grams.alias("x").join(flat.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.in_id")) & (F.col("x.t") == F.col("y.in_t")) & (F.col("x.k") == F.col("y.k")))
    first = lambda s: F.greatest(F.lit(1), F.least(s + 1, F.size("g") - F.col("runs") + 1))
    held = F.transform(F.array_distinct(F.transform("starts", first)), lambda s: F.struct(F.slice(F.col("g"), s, F.col("runs")).alias("wh")))
    cuts = own.select("doc_id", "t", "i", F.explode(held).alias("w")).select("doc_id", "t", "i", "w.wh").withColumn("wfp", simhash(F.col("wh")))
    near = cuts.join(small(items.select("i", "item_id", "ih", "fp"), few), "i")
    apart = F.col("wfp").bitwiseXOR(F.col("fp"))
    agree = reduce(lambda a, b: a | b, [_block(apart, *c) == 0 for c in blocks(radius)])
    near = near.filter(agree & (F.bit_count(apart) <= radius))
    return near.select("doc_id", "t", "item_id", similarity(F.col("wh"), F.col("ih")).alias("similarity")).filter(F.col("similarity") >= least).groupBy("doc_id", "t", "item_id").agg(F.max("similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, k: int = 5, radius: int = 24, few: int = 1_000_000) -> DataFrame:
    """:func:`matches` as ``doc_id, item_id, similarity``: of several texts with one id the best counts."""
    return matches(docs, benchmark, least, k, radius, few).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


SQL_PARTS = r"""
{p}_i as (select item_id, w, len(w) as n, least(5, len(w)) as k from (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from {benchmark}) where len(w) > 0),
{p}_ig as (select item_id, n, k, w[q:q + k - 1] as g, count(*) as c from (select *, unnest(range(1, n - k + 2)) as q from {p}_i) group by all),
{p}_d as (select doc_id, w, len(w) as n from (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from {docs})),
{p}_dg as (select doc_id, n, k, p, w[p:p + k - 1] as g from (select *, unnest(range(1, n::bigint - k + 2)) as p from {p}_d, (select distinct k from {p}_i) where n >= k)),
{p}_m as (select d.doc_id, d.n as dn, d.p, i.item_id, i.n, i.k, i.g, i.c from {p}_dg d join {p}_ig i on d.k = i.k and d.g = i.g),
{p}_ok as (select doc_id, item_id from {p}_m group by all having count(distinct p) >= 0.75 * max(n - k + 1)),
{p}_s as (select distinct doc_id, item_id, dn, n, k, unnest(range(greatest(1, p - (n - k)), least(p, greatest(1, dn - n + 1)) + 1)) as s from {p}_m semi join {p}_ok using (doc_id, item_id)),
{p}_b as (select s.doc_id, s.item_id, s.s, s.dn, s.n, s.k, m.g, least(count(*), max(m.c)) as c from {p}_s s join {p}_m m on m.doc_id is not distinct from s.doc_id and m.item_id = s.item_id and m.p between s.s and s.s + s.n - s.k group by all),
{p}_x as (select doc_id, item_id, max(hits / (least(dn, n) - k + 1 + n - k + 1 - hits)) as similarity from (select doc_id, item_id, s, dn, n, k, sum(c)::double as hits from {p}_b group by all) group by all having max(hits / (least(dn, n) - k + 1 + n - k + 1 - hits)) >= 0.75)
"""
SQL = "with " + SQL_PARTS.replace("{p}", "hit") + " select doc_id, item_id, similarity from hit_x"

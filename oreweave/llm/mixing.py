"""Operator 1, mixing sources to target weights. DataFrame operations only.

Sizes are added up by source, each source gets a target and so a repetition rate, and each document is
taken ``floor(rate)`` times and once more if a seeded hash of its id falls below the rate's fraction. Sizes of texts are
far from equal, so one seed may miss a target by a tenth and more: each source uses that one of ``SEEDS`` fixed seeds whose
words over all its documents come nearest its target.

:func:`mix_sources` has the decisions, a row a document; :func:`emit_mix` has the mix itself, a row a copy.

Edge cases. A null text has size 0: it is copied like others of its source, but its copies add no words. A null source is
a source of its own, last in order. A null id hashes as the empty text; rows that repeat an id share its decision. Words of texts
of any length are counted whole. Sources whose ceilings tie stop in order of name; of seeds that come as near, the first is used. An
empty table gives an empty result. A source of size 0 has target 0, so that none of its documents is emitted. ``mix_sources``
looks at no further columns; ``emit_mix`` carries all, whatever their names, untouched but for one named ``copy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, n_words_of, rest_of, small, stored

#: The hash that draws extra copies has 12 hexadecimal digits.
_DRAWS = 1 << 48
SEEDS = 32


def _digest(doc_id: Column, name: str) -> Column:
    """Two numbers below ``_DRAWS`` from the id and a name; seed k draws the first plus k times the second."""
    digest = F.md5(F.concat(F.lit(name + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.array(*[F.conv(F.substring(digest, at, 12), 16, 10).cast("long") for at in (1, 13)])


def draw(pair: Column, seed: Column) -> Column:
    """A number in [0, 1)."""
    return ((F.get(pair, 0) + seed * F.get(pair, 1)) % F.lit(_DRAWS)) / F.lit(float(_DRAWS))


def targets(sizes: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources by code point, null last, weigh 1 to ``cycle``, repeating. They share the total by weight; a target
    stops at ``most`` times its source and the excess is shared anew by weight. The fixed point is a water
    level: in order of ceiling per weight, the first source whose ceiling the level of the rest does not
    reach, and all after it, get level times weight. One row a source passes through one window: it is as
    long as the list of sources, not the corpus.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = (
        sizes.withColumn("weight", ((F.row_number().over(ordered) - 1) % cycle + 1).cast("long"))
        .withColumn("ceiling", F.col("source_size") * most)
        .withColumn("brim", F.col("ceiling") / F.col("weight"))
    )
    before = Window.orderBy("brim", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("full", F.coalesce(F.sum("ceiling").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = (F.sum("source_size").over(everything) - F.col("full")) / (F.sum("weight").over(everything) - F.col("gone"))
    w = w.withColumn("level", F.when(level <= F.col("brim"), level)).withColumn("level", F.max("level").over(everything))
    return w.select("source", "source_size", F.least(F.col("ceiling").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _seeded(sized: DataFrame, name: str, most: int, cycle: int, few: int) -> DataFrame:
    """``doc_id, source, size``, stored, to ``_source, source_size, target, _whole, _part, _seed``."""
    rate = F.coalesce(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")), F.lit(0.0))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most, cycle)
    by_source = stored(by_source.select(F.col("source").alias("_source"), "source_size", "target", F.floor(rate).alias("_whole"), (rate - F.floor(rate)).alias("_part")), "targets")
    rated = sized.withColumn("_pair", _digest(F.col("doc_id"), name)).join(small(by_source, few), F.col("source").eqNullSafe(F.col("_source")))
    extra = [F.coalesce(F.sum(F.when(draw(F.col("_pair"), F.lit(k)) < F.col("_part"), F.col("size"))), F.lit(0)).alias(f"e{k}") for k in range(SEEDS)]
    tried = rated.groupBy("_source", "source_size", "target", "_whole", "_part").agg(*extra)
    missed = [F.struct(F.abs(F.col("_whole") * F.col("source_size") + F.col(f"e{k}") - F.col("target")).alias("by"), F.lit(k).alias("k")) for k in range(SEEDS)]
    return small(stored(tried.select("_source", "source_size", "target", "_whole", "_part", F.array_min(F.array(*missed))["k"].alias("_seed")), "seeds"), few)


def _decided(docs: DataFrame, seeded: DataFrame, name: str) -> DataFrame:
    """``docs`` with the columns of ``seeded`` and ``_copies``, from the id and the source alone."""
    copies = F.col("_whole") + F.when(draw(F.col("_pair"), F.col("_seed")) < F.col("_part"), 1).otherwise(0)
    return docs.withColumn("_pair", _digest(F.col("doc_id"), name)).join(seeded, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies.cast("long"))


def _sizes(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size")), "sizes")


def mix_sources(docs: DataFrame, name: str = "mix", most: int = 3, cycle: int = 3, few: int = 10_000) -> DataFrame:
    """The counts: ``doc_id, source, text`` to ``doc_id, source, size, source_size, target, copies, taken``.

    The table of sources is broadcast only if it has at most ``few`` rows. ``name`` names the set of seeds.
    """
    sized = _sizes(docs)
    mixed = _decided(sized, _seeded(sized, name, most, cycle, few), name)
    return mixed.select("doc_id", "source", "size", "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("size")).alias("taken"))


def emit_mix(docs: DataFrame, name: str = "mix", most: int = 3, cycle: int = 3, few: int = 10_000) -> DataFrame:
    """The mix: each row of ``docs`` as often as its copies in :func:`mix_sources`, with a number from 1 in ``copy`` (which a column of that name gives way to)."""
    sized = _sizes(docs)
    rates = _seeded(sized, name, most, cycle, few).drop("source_size", "target")
    dropped(sized)
    taken = _decided(docs.select("doc_id", "source", rest_of(docs).alias("rest")), rates, name).filter("_copies > 0")
    kept = [F.col("rest").getField(c).alias(c) for c in docs.columns if c != "copy"]
    return taken.select(*kept, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {docs}
), by_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight, source_size * 3 as ceiling from by_source
), brims as (select *, ceiling::double / weight::double as brim from weighed),
levels as (
  select *,
    cast(sum(source_size) over () - coalesce(sum(ceiling) over before, 0) as double)
      / cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as double) as level
  from brims window before as (order by brim, source nulls last rows between unbounded preceding and 1 preceding)
), targets as (
  select source, source_size, least(ceiling::double, (select max(level) from levels where level <= brim) * weight) as target from levels
), rated as (
  select s.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate, md5('mix:' || coalesce(doc_id::varchar, '')) as h
  from sized s join targets t on s.source is not distinct from t.source
), drawn as (
  select *, (('0x' || substr(h, 1, 12))::bigint + k * ('0x' || substr(h, 13, 12))::bigint) % 281474976710656 / cast(281474976710656 as double) as draw
  from rated, (select unnest(range(32)) as k)
), seeds as (
  select source, arg_min(k, {{'m': miss, 'k': k}}) as k from (
    select source, k, abs(floor(any_value(rate)) * any_value(source_size) + coalesce(sum(case when draw < rate - floor(rate) then size end), 0) - any_value(target)) as miss from drawn group by source, k
  ) group by source
)
select doc_id, source, size, source_size, target, copies, (copies * size)::bigint as taken
from (select d.*, (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end)::bigint as copies from drawn d join seeds z on d.source is not distinct from z.source and d.k = z.k)
"""

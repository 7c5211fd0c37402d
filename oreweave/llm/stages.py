"""Filtering stages over tables with the columns of ``documents``.

All stages hold the columns they do not decide by in one struct, so that columns of any name, helpers' names included, come back as they
were. Texts of any length are worked on whole, empty tables give empty results, and rows that repeat are treated alike
unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, lines, mixing
from .common import rest_of, stored, text_hash


def _unpacked(docs: DataFrame, *but: str):
    """The columns of ``docs`` out of ``rest`` and, for the named ones, from the top."""
    return [F.col(c) if c in but else F.col("rest").getField(c).alias(c) for c in docs.columns]


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Drop documents without a language or whose best one has under ``least`` of the words. A null text has no language; of
    languages with equal shares the first by name counts."""
    read = docs.select("doc_id", "text", "lang", rest_of(docs, "text").alias("rest"))
    return langid.identify(read).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*_unpacked(docs, "text"))


def cut_lines(docs: DataFrame) -> DataFrame:
    """Take boilerplate lines out, bring ``n_chars`` up to date, and drop documents of nothing else. A null text stays; of places a
    line could stay in, the one of the smallest id, then hash of the text, then line."""
    read = docs.select("doc_id", "source", "text", rest_of(docs, "text").alias("rest"))
    cut = lines.dedup_lines(read).filter(F.coalesce(~F.col("emptied"), F.lit(True)))
    out = _unpacked(docs, "text")
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
        out = [size.alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, out, strict=True)]
    return cut.select(*out)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; documents without words stay. Of several
    rows with that id the one whose text has the smallest hash stays, of equal ones any."""
    near = stored(jaccard.near_duplicates(docs), "groups")
    first = near.filter((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min(F.struct("t", "doc_id")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("first_id"), F.col("x.t").alias("first_t"))
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("t"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"), rest_of(docs).alias("rest"))
    one = keyed.filter("worded").join(first, (F.col("t") == F.col("first_t")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").groupBy("doc_id", "t").agg(F.first("rest").alias("rest"))
    return one.select("rest").unionByName(keyed.filter("not worded").select("rest")).select(*_unpacked(docs))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drop documents that hold a benchmark item. Told by id and text together, so that a clean document with the id, or without an
    id as another, stays."""
    hit = decontaminate.matches(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_t")).distinct()
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("t"), rest_of(docs).alias("rest"))
    return keyed.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("t") == F.col("hit_t")), "left_anti").select(*_unpacked(docs))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, a row a copy with its number in ``copy``."""
    return mixing.emit_mix(docs)

"""Constant pools: what addresses a function's instructions name, and what stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import python as P


def references(blocks: DataFrame) -> DataFrame:
    """``binary_id, func_addr, ord, addr``: each constant address a function names, in order of first use."""
    insns = blocks.select("binary_id", "func_addr", "block_ord", F.posexplode("insns").alias("insn_ord", "insn"))
    named = insns.select("binary_id", "func_addr", F.struct("block_ord", "insn_ord").alias("at"), C.constant_address(F.col("insn")).alias("addr")).filter("addr is not null")
    first = named.groupBy("binary_id", "func_addr", "addr").agg(F.min("at").alias("at"))
    order = (F.row_number().over(Window.partitionBy("binary_id", "func_addr").orderBy("at")) - 1).cast("int")
    return first.withColumn("ord", order).select("binary_id", "func_addr", "ord", "addr")


def memory_at(wanted: DataFrame, segments: DataFrame, most: int = 4096, page: int = 1 << 16) -> DataFrame:
    """``wanted`` with ``bytes``: from the address up to the first NUL, the segment's end or ``most`` bytes; empty outside all segments.

    Segments are listed under each page they cover, so this is an equi-join on the page and not a range join.
    """
    last = F.col("vaddr") + F.octet_length("bytes") - 1
    pages = F.sequence(F.floor(F.col("vaddr") / page), F.floor(last / page))
    paged = segments.filter(F.octet_length("bytes") > 0).select("binary_id", F.explode(pages).alias("_page"), "vaddr", F.col("bytes").alias("_bytes"))
    met = wanted.withColumn("_page", F.floor(F.col("addr") / page)).join(paged, ["binary_id", "_page"], "left")
    inside = (F.col("addr") >= F.col("vaddr")) & (F.col("addr") < F.col("vaddr") + F.octet_length("_bytes"))
    raw = F.when(inside, F.substring("_bytes", (F.col("addr") - F.col("vaddr") + 1).cast("int"), F.lit(most)))
    text = F.decode(raw, "ISO-8859-1")
    cut = F.encode(F.substring_index(text, "\0", 1), "ISO-8859-1")
    out = met.withColumn("_cut", cut).groupBy(*wanted.columns).agg(F.max("_cut").alias("_cut"))
    return out.withColumn("bytes", F.coalesce("_cut", F.lit(b""))).drop("_cut")


def constant_pool(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """``binary_id, func_addr, ord, addr, bytes, text, kind, placeholder``."""
    read = memory_at(references(blocks), segments)
    # bytes that are no UTF-8 are passed over, which no native function does
    return classified(read.withColumn("text", P.utf8_text("bytes")))


def classified(pool: DataFrame) -> DataFrame:
    """With ``kind`` and ``placeholder`` from ``bytes``, ``text`` and ``addr``."""
    return pool.withColumn("kind", C.blob_kind(F.col("bytes"), F.col("text"))).withColumn("placeholder", C.placeholder(F.col("kind"), F.col("addr")))

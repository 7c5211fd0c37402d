"""Undefined symbols of binaries and the headers that declare them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import fixed


def header_map(spark: SparkSession) -> DataFrame:
    """``header_ord, header, symbol``; a fixed table of about a hundred rows, from a local relation."""
    rows = [f"({i}, '{h}', '{s}')" for i, (h, symbols) in enumerate(fixed.HEADER_MAP.items()) for s in symbols]
    return spark.sql(f"select * from values {', '.join(rows)} as t(header_ord, header, symbol)")


def undefined_symbols(lines: DataFrame) -> DataFrame:
    """``binary_id, symbol``: last fields of symbol-table lines with ``UND``, as they stand."""
    last = F.element_at(F.filter(F.split("line", r"\s+"), lambda f: f != ""), -1)
    found = lines.filter(F.col("line").contains("UND")).select("binary_id", last.alias("symbol"))
    return found.filter(F.col("symbol").isNotNull() & ~F.col("symbol").isin("UND", "UNDEF"))


def external_symbols(lines: DataFrame) -> DataFrame:
    """Distinct, without versions, none that start with two underscores."""
    base = undefined_symbols(lines).select("binary_id", C.symbol_base(F.col("symbol")).alias("symbol"))
    return base.filter(~F.col("symbol").startswith("__")).distinct()


def needed_headers(symbols: DataFrame) -> DataFrame:
    """``binary_id, header_ord, header``. The map is a hundred fixed rows, so it may be broadcast."""
    return symbols.join(F.broadcast(header_map(symbols.sparkSession)), "symbol").select("binary_id", "header_ord", "header").distinct()


def header_blocks(binaries: DataFrame, symbols: DataFrame) -> DataFrame:
    """``binary_id, header_block`` for every binary; empty where no header is needed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("header_ord", "header"))), lambda x: F.concat(F.lit("#include "), x["header"]))
    text = needed_headers(symbols).groupBy("binary_id").agg(F.concat(F.lit("HEADERS:\n"), F.array_join(ordered, "\n"), F.lit("\n")).alias("header_block"))
    return binaries.select("binary_id").distinct().join(text, "binary_id", "left").select("binary_id", F.coalesce("header_block", F.lit("")).alias("header_block"))

"""What several operators share: native expressions, tables and size-checked broadcasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import let  # noqa: F401
from ..plans.store import dropped, stored  # noqa: F401

#: A word: any run of characters other than space and TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The array of words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column, salt: int = 0) -> Column:
    """64 bits of a text; null and the empty text differ from all others and share one value."""
    return F.xxhash64(F.lit(salt), F.coalesce(text, F.lit("")))


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a column's value takes in a broadcast."""
    fixed = lambda k: 16 + 8 * len(k.fields) if isinstance(k, T.StructType) else 8
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(name), F.lit(0)) * fixed(kind.elementType) + 16
    return F.lit(fixed(kind))


def small(df: DataFrame, rows: int, most_bytes: int = 64_000_000) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows and ``most_bytes`` (both counted, so pass a stored table); else
    leave the join to shuffle and adaptive skew handling."""
    size = reduce(lambda a, b: a + b, [_bytes(f.name, f.dataType) for f in df.schema.fields], F.lit(0))
    n, held = df.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= most_bytes else df


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rest_of(docs: DataFrame, *but: str) -> Column:
    """All columns of ``docs`` but some as one struct, so that no helper column can clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but])


def within(rows: list, most: int) -> list:
    """Of rows with a ``size`` those that fit into ``most`` in their order; the smallest of all if none does."""
    taken, held = [], 0
    for r in rows:
        if held + r["size"] <= most:
            taken.append(r)
            held += r["size"]
    return taken or sorted(rows, key=lambda r: r["size"])[:1]

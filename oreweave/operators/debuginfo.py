"""C type names and signatures from tables of debug-information entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dies as entries
from ..plans import fixed

#: Entries that are one Arrow group's work, but for larger objects.
GROUP_ROWS = 200_000


def _by_objects(dies: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """Entries of an object meet in one shuffle, some objects at once; what refers to what is looked up there."""
    dies = dies.select(*columns)
    groups = max(1, -(-dies.count() // GROUP_ROWS))
    return dies.withColumn("_group", F.pmod(F.xxhash64("o_path"), F.lit(groups))).groupBy("_group").applyInArrow(make, schema)


def type_names(dies: DataFrame, depth: int = fixed.MAX_TYPE_DEPTH) -> DataFrame:
    """``o_path, die_off, type_name`` of every entry; a reference more than ``depth`` steps deep is unknown."""
    return _by_objects(dies, ["o_path", "die_off", "tag", "name", "type_off"], lambda rows: entries.names(rows, depth), "o_path string, die_off bigint, type_name string")


def signatures(dies: DataFrame) -> DataFrame:
    """``o_path, ord, func_name, signature_hint`` of top-level functions (``parent_off`` of a unit) that have a name."""
    return _by_objects(dies, ["o_path", "die_off", "parent_off", "ord", "tag", "name", "type_off"], lambda rows: entries.signatures(rows), "o_path string, ord int, func_name string, signature_hint string")


def lookup(signed: DataFrame) -> DataFrame:
    """``func_name, hints``: all signatures of a name, by object and order."""
    each = F.array_sort(F.collect_list(F.struct("o_path", "ord", "signature_hint")))
    return signed.groupBy("func_name").agg(each.alias("hints"))


def first_signature(signed: DataFrame) -> DataFrame:
    """``func_name, signature_hint``: the first of each name."""
    return signed.groupBy("func_name").agg(F.min(F.struct("o_path", "ord", "signature_hint")).alias("x")).select("func_name", F.col("x.signature_hint").alias("signature_hint"))


def _dir(path):
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def best_by_containment(matches: DataFrame) -> DataFrame:
    """``func_name, binary_path, o_path, ord``: for each function of a binary the first object whose folder's path contains the binary's
    folder or lies in it, else the first at all."""
    a, b = _dir(F.col("o_path")), _dir(F.col("binary_path"))
    near = F.when(b.contains(a) | a.contains(b), 1).otherwise(0)
    w = Window.partitionBy("func_name", "binary_path").orderBy(near.desc(), "ord")
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_by_depth(matches: DataFrame) -> DataFrame:
    """As above, by the number of separators on the way from the binary's folder to the object."""
    a, b = F.filter(F.split("o_path", "/"), lambda x: x != ""), F.filter(F.split(_dir(F.col("binary_path")), "/"), lambda x: x != "")
    same = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)), lambda x: x))
    depth = F.size(a) + F.size(b) - 2 * same - 1
    w = Window.partitionBy("func_name", "binary_path").orderBy(depth, "ord")
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

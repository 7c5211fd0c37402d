"""Ground-truth labels: real C text, its literals as placeholders, its signature ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import python as P
from ..plans import fixed


def source_dir(binary_path: Column) -> Column:
    """Where the sources of a binary's directory lie: the first ``/COMPILED/`` becomes ``/C_COMPILE/``."""
    at = F.instr(binary_path, "/COMPILED/")
    moved = F.when(at > 0, F.concat(F.substring(binary_path, F.lit(1), at - 1), F.lit("/C_COMPILE/"), F.substring(binary_path, at + 10, F.length(binary_path)))).otherwise(binary_path)
    return F.regexp_replace(moved, r"/[^/]*\z", "/")


def real_code(functions: DataFrame, sources: DataFrame) -> DataFrame:
    """``functions`` (``binary_path, name``) with ``real_src``: from the first source by name, in the one directory, that holds the
    function. ``sources``: ``dir, file, content``. A native test for the name runs before the Python search."""
    wanted = functions.filter("name is not null and name <> '' and not startswith(name, '__')").select("binary_path", "name").distinct()
    met = wanted.withColumn("dir", source_dir(F.col("binary_path"))).join(sources.filter(F.col("file").endswith(".c")), "dir").filter(F.col("content").contains(F.col("name")))
    found = met.withColumn("real_src", P.function_text("content", "name")).filter("real_src is not null")
    first = found.groupBy("binary_path", "name").agg(F.min_by("real_src", "file").alias("real_src"))
    return functions.join(first, ["binary_path", "name"], "left")


def pools(pool: DataFrame, *key: str) -> DataFrame:
    """``key`` and ``pool``: literals and placeholders in order of first use; data is left out."""
    each = F.array_sort(F.collect_list(F.when(F.col("kind") != "DAT", F.struct("ord", "text", "placeholder"))))
    return pool.groupBy(*key).agg(F.transform(each, lambda x: F.struct(x["text"].alias("text"), x["placeholder"].alias("placeholder"))).alias("pool"))


def annotate(sources: DataFrame) -> DataFrame:
    """``real_src`` and ``pool`` to ``annotated``: exact spellings, then similar ones, then streams."""
    return sources.withColumn("annotated", P.annotated("real_src", "pool"))


def annotate_exact(source: Column, pool: Column) -> Column:
    """Only literals spelled as they are, natively."""
    longest = F.array_sort(F.transform(pool, lambda x, i: F.struct((-F.length(x["text"])).alias("n"), i.alias("i"), x["text"].alias("text"), x["placeholder"].alias("placeholder"))))
    done = F.aggregate(longest, source, lambda s, x: F.when(x["text"] == "", s).otherwise(F.replace(s, F.concat(F.lit('"'), x["text"], F.lit('"')), x["placeholder"])))
    return F.replace(F.replace(done, F.lit("stderr"), F.lit("STREAM_STDERR")), F.lit("stdout"), F.lit("STREAM_STDOUT"))


def final_label(annotated: Column, signature: Column) -> Column:
    """Signature and body, whichever there are, else a note that there is none."""
    parts = lambda c: F.when(F.coalesce(c, F.lit("")) != "", C.strip(c))
    return F.coalesce(F.nullif(F.concat_ws("\n", parts(signature), parts(annotated)), F.lit("")), F.lit(fixed.NO_LABEL))


def pool_matches(pool: DataFrame, literals: DataFrame, *key: str, least: float = 0.8) -> DataFrame:
    """Pool texts and quoted literals of the same function that are more than ``least`` similar: the first literal for each."""
    met = pool.join(literals, list(key)).withColumn("ratio", P.similarity("text", "literal")).filter(F.col("ratio") > least)
    w = Window.partitionBy(*key, "ord").orderBy("literal_ord")
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

"""Assembly listings, prompts and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def listings(blocks: DataFrame) -> DataFrame:
    """``binary_id, func_addr, assembly`` from block rows with ``insns`` and, where there are none, ``own`` text."""
    own = F.col("own") if "own" in blocks.columns else F.lit(None).cast("string")
    row = F.struct("block_ord", F.col("block_addr").alias("addr"), F.transform("insns", lambda x: x["text"]).alias("lines"), own.alias("own"))
    return blocks.groupBy("binary_id", "func_addr").agg(C.listing(F.collect_list(row)).alias("assembly"))


def function_data(functions: DataFrame, assembly: DataFrame, count: Column) -> DataFrame:
    """``functions`` with ``assembly`` and ``token_count``; none of either counts as empty and 0."""
    out = functions.join(assembly.withColumnRenamed("func_addr", "addr"), ["binary_id", "addr"], "left").withColumn("assembly", F.coalesce("assembly", F.lit("")))
    return out.withColumn("token_count", F.coalesce(count, F.lit(0)).cast("bigint"))


def context_parts(context: DataFrame) -> DataFrame:
    """``binary_id, target, callers, callees``: blocks in order of selection, the first of each name in either list.

    ``context``: ``sel_ord, role, name, assembly`` and optionally ``append_mode, c_approx``. C text stands for assembly only in the mode
    of that name; entries without code fall out, and any role but caller counts as callee.
    """
    if "c_approx" in context.columns:
        code = F.when((F.col("append_mode") == "c_approx") & (F.coalesce("c_approx", F.lit("")) != ""), F.col("c_approx")).otherwise(F.col("assembly"))
    else:
        code = F.col("assembly")
    rows = context.select("binary_id", "target", "sel_ord", (F.col("role") == "caller").alias("by"), F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown_function")).alias("name"), code.alias("code")).filter("code is not null and code <> ''")
    first = rows.groupBy("binary_id", "target", "by", "name").agg(F.min(F.struct("sel_ord", "code")).alias("x"))
    text = lambda word: F.transform(F.array_sort(F.collect_list(F.when(F.col("by") == (word == "Caller"), F.struct("x.sel_ord", "name", "x.code")))), lambda b: F.concat(F.lit(f"{word}: "), b["name"], F.lit("\n"), C.strip(b["code"])))
    return first.groupBy("binary_id", "target").agg(text("Caller").alias("callers"), text("Callee").alias("callees"))


def prompts(targets: DataFrame, context: DataFrame, headers: DataFrame) -> DataFrame:
    """``binary_id, target, model_input`` for each row of ``targets`` (``binary_id, target, name, assembly``)."""
    out = targets.join(context_parts(context), ["binary_id", "target"], "left").join(headers, "binary_id", "left")
    group = lambda word, c: F.when(F.size(c) > 0, F.array_join(F.concat(F.array(F.lit(word)), c), "\n\n"))
    parts = [
        F.when(F.coalesce("header_block", F.lit("")) != "", C.rstrip(F.col("header_block"))),
        F.concat(F.lit("Target: "), F.coalesce("name", F.lit("None")), F.lit("\n"), C.strip(F.coalesce("assembly", F.lit("")))),
        group("BY", F.col("callers")),
        group("TO", F.col("callees")),
    ]
    return out.select("binary_id", "target", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("model_input"))


def context_overview(context: DataFrame) -> DataFrame:
    """``binary_id, target, overview``: a comment line for each chosen function, in order of selection."""
    mode = F.col("append_mode") if "append_mode" in context.columns else F.lit("assembly")
    line = F.concat(F.lit(";;; Function: "), F.coalesce("name", F.lit("unknown_function")), F.lit(" (degree "), F.col("degree").cast("string"), F.lit(", role "), F.col("role"), F.lit(", mode "), F.coalesce(mode, F.lit("assembly")), F.lit(")\n"))
    each = F.array_sort(F.collect_list(F.struct("sel_ord", line.alias("t"))))
    return context.groupBy("binary_id", "target").agg(F.concat(F.array_join(F.transform(each, lambda x: x["t"]), ""), F.lit("\n")).alias("overview"))


def candidate_listing(context: DataFrame) -> DataFrame:
    """``binary_id, target, listing``: each function under a comment line with its assembly, in order of ``sel_ord``."""
    block = F.concat(F.lit(";;; Function: "), F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown_function")), F.lit(" (degree "), F.col("degree").cast("string"), F.lit(")\n"), F.coalesce("assembly", F.lit("")), F.lit("\n\n"))
    each = F.array_sort(F.collect_list(F.struct("sel_ord", block.alias("t"))))
    return context.groupBy("binary_id", "target").agg(F.array_join(F.transform(each, lambda x: x["t"]), "").alias("listing"))


def text_files(targets: DataFrame, context: DataFrame, prompted: DataFrame) -> DataFrame:
    """``binary_id, target, file, content``: the texts kept for each target beside its prompt."""
    named = lambda df, file, column: df.select("binary_id", "target", F.lit(file).alias("file"), F.coalesce(column, F.lit("")).alias("content"))
    parts = [
        named(context_overview(context), "selected_context_functions.txt", "overview"),
        named(candidate_listing(context), "context_candidate_assembly.txt", "listing"),
        named(prompted, "final_model_input.txt", "model_input"),
        named(targets, "target_assembly.txt", "assembly"),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_texts(files: DataFrame, path: str) -> None:
    """The texts of :func:`text_files` as a table, a folder for each kind of file."""
    files.write.mode("overwrite").partitionBy("file").parquet(path)


def legacy_prompts(targets: DataFrame, context: DataFrame) -> DataFrame:
    """The older layout: each context function under a comment line, separated by marks, the target last."""
    head = F.concat(F.lit(";;; Context: "), F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown_function")), F.lit(" (degree "), F.col("degree").cast("string"), F.lit(", role "), F.col("role"), F.lit(")\n"), F.col("assembly"))
    rows = context.filter("assembly is not null and assembly <> ''").groupBy("binary_id", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sel_ord", head.alias("t")))), lambda x: x["t"]), "\n<SEP>\n").alias("c"))
    tail = F.concat(F.lit("\n<TARGET_SEP>\n;;; Target: "), F.col("name"), F.lit("\n"), F.coalesce("assembly", F.lit("")))
    return targets.join(rows, ["binary_id", "target"], "left").select("binary_id", "target", F.concat(F.coalesce("c", F.lit("")), tail).alias("model_input"))


def samples(targets: DataFrame, prompted: DataFrame, labels: DataFrame | None, mode: str) -> DataFrame:
    """``binary_path, target_function_name, model_input, label_c_code, context_role``; labels only in mode ``train``."""
    out = targets.join(prompted, ["binary_id", "target"])
    out = out.join(labels, ["binary_id", "target"], "left") if labels is not None and mode == "train" else out.withColumn("label_c_code", F.lit(None).cast("string"))
    return out.select("binary_path", F.col("name").alias("target_function_name"), "model_input", "label_c_code", C.context_role(F.lit(mode)).alias("context_role"))

"""Repository dumps: compressed JSON lines to source files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import python as P
from ..plans import fixed

_PARSED = "repo_name string, files array<struct<file_path: string, file_content: string>>"


def read_lines(spark: SparkSession, paths: str | list[str], tolerant: bool = False) -> DataFrame:
    """``value`` (bytes), ``src_file, block, seq``: lines in the order of their files.

    Compression follows from the suffix. ``tolerant`` keeps what could be read of a broken file; otherwise it fails.
    """
    read = spark.read.option("ignoreCorruptFiles", str(tolerant).lower()).text(paths)
    return read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _parse(raw: bytes, strict: bool) -> tuple[str | None, list | None]:
    """Name and files of one line, as far as they are sound; no name: the line is dropped.

    A file without path or content key, or whose path is no text, ends its repository. Content that is no text leaves an
    empty file and, if ``strict``, ends it too.
    """
    try:
        repo = json.loads(bytes(raw).decode("utf-8", "ignore"))
        name, listed = repo["repo_name"], repo["file_array"]
        if not isinstance(name, str):
            return None, None
    except (ValueError, TypeError, KeyError, RecursionError):
        return None, None
    files = []
    for f in listed if isinstance(listed, list) else []:
        if not isinstance(f, dict) or "file_content" not in f or not isinstance(f.get("file_path"), str):
            break
        sound = isinstance(f["file_content"], str)
        files.append({"file_path": f["file_path"], "file_content": f["file_content"].encode("utf-8", "ignore").decode() if sound else ""})
        if strict and not sound:
            break
    return name, files


def parse_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``lines`` with ``repo_name`` and ``files``; lines that do not parse are dropped."""

    @F.pandas_udf(_PARSED)
    def parsed(raw: pd.Series) -> pd.DataFrame:
        rows = [_parse(x, strict) for x in raw]
        return pd.DataFrame({"repo_name": [r[0] for r in rows], "files": [r[1] for r in rows]}, dtype=object)

    out = lines.withColumn("_p", parsed("value"))
    return out.filter("_p.repo_name is not null").select("src_file", "block", "seq", "_p.repo_name", "_p.files")


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The fast way, by Spark's own reader: near to :func:`parse_lines`, but it takes some lines that are no strict JSON."""
    read = spark.read.schema(fixed.REPO_DUMP + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    named = read.filter("_corrupt is null and repo_name is not null")
    return named.select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "repo_name", F.col("file_array").alias("files"))


def files_of(repos: DataFrame) -> DataFrame:
    """One row a file: ``repo, repo_name, path, is_escaping, content`` and what orders writes."""
    rows = repos.select("src_file", "block", "seq", "repo_name", F.posexplode("files").alias("file_idx", "f"))
    path = P.normal_path(F.col("f.file_path"))
    out = rows.select(C.repo_key(F.col("repo_name")).alias("repo"), "repo_name", path.alias("path"), F.col("f.file_content").alias("content"), "src_file", "block", "seq", "file_idx")
    return out.withColumn("is_escaping", F.col("path").startswith("/") | (F.col("path") == "..") | F.col("path").startswith("../"))


def last_writes(files: DataFrame) -> DataFrame:
    """Of files with one path the one written last; what goes before is merged ahead of the shuffle."""
    order = F.struct(*[c for c in ("src_file", "block", "seq", "file_idx") if c in files.columns])
    return files.groupBy("repo", "path").agg(F.max_by(F.struct("repo_name", "content", "is_escaping"), order).alias("x")).select("repo", "path", "x.repo_name", "x.content", "x.is_escaping")


def write_tree(files: DataFrame, path: str) -> None:
    """The source tree as a table, clustered by repository."""
    files.repartition("repo").sortWithinPartitions("repo", "path").write.mode("overwrite").parquet(path)


def repositories(files: DataFrame, start: str | None = None) -> DataFrame:
    """Distinct repositories; with ``start`` from that one on by name."""
    out = files.select("repo").distinct()
    return out if start is None else out.filter(F.col("repo") >= start)


def include_dirs(files: DataFrame) -> DataFrame:
    """``repo, dir``: every directory below a repository's own."""
    return files.select("repo", F.explode(C.parent_dirs(F.concat_ws("/", "repo", "path"))).alias("dir")).filter(F.col("dir") != F.col("repo")).distinct()


def with_suffix(files: DataFrame, suffix: str) -> DataFrame:
    return files.filter(F.col("path").endswith(suffix))


def quoted_sources(files: DataFrame) -> DataFrame:
    """Sources and headers with quoted includes, in one pass."""
    touched = F.col("path").endswith(".c") | F.col("path").endswith(".h")
    return files.withColumn("content", F.when(touched, C.quote_includes(F.col("content"))).otherwise(F.col("content")))


def compile_units(files: DataFrame, source_root: str, dest_root: str, arg_max: int = fixed.ARG_MAX) -> DataFrame:
    """``repo, c_path, o_path, options, cmd, skipped``: a unit for each ``.c`` file; commands too long for a shell are skipped."""
    dirs = include_dirs(files).groupBy("repo").agg(F.array_sort(F.collect_list("dir")).alias("dirs"))
    units = with_suffix(files, ".c").select("repo", F.concat_ws("/", F.lit(source_root), "repo", "path").alias("c_path")).join(dirs, "repo", "left")
    flags = C.include_flags(F.transform(F.coalesce("dirs", F.array().cast("array<string>")), lambda d: F.concat(F.lit(source_root + "/"), d)))
    units = units.withColumn("o_path", C.mirrored(F.col("c_path"), F.lit(source_root), F.lit(dest_root), ".o"))
    units = units.withColumn("options", C.compile_options(F.col("c_path"), F.col("o_path"), flags)).withColumn("cmd", C.compile_command(F.col("options")))
    return units.select("repo", "c_path", "o_path", "options", "cmd", (~C.fits_shell(F.col("cmd"), arg_max)).alias("skipped"))


def resume_from(listing: DataFrame, start: str) -> DataFrame:
    """``repo, listed``: entries of a listing from the first one of that name on, in listing order; none if it is missing."""
    first = listing.filter(F.col("repo") == start).agg(F.min("listed").alias("_from"))
    return listing.join(F.broadcast(first), F.col("listed") >= F.col("_from")).drop("_from")

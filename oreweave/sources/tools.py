"""External tools behind extractors. Each takes a table of inputs and gives a table; where a tool is missing, its rows say so."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import fixed


def read_binaries(spark: SparkSession, path: str, glob: str = "*.o") -> DataFrame:
    """``path, content`` of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def run(args: list[str], timeout: int = 60) -> tuple[int, str, str]:
    """Return code, output and errors; -1 if the tool is missing or takes too long."""
    if shutil.which(args[0]) is None:
        return -1, "", f"{args[0]}: not found"
    try:
        done = subprocess.run(args, capture_output=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        return -1, "", "timeout"
    return done.returncode, done.stdout.decode("utf-8", "ignore"), done.stderr.decode("utf-8", "ignore")


def lines_of(files: DataFrame, args: list[str], merge_errors: bool = False) -> DataFrame:
    """``path, line_no, line``: what a tool prints about each file's bytes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with tempfile.NamedTemporaryFile() as f:
                    f.write(content)
                    f.flush()
                    _, out, err = run([*args, f.name])
                lines = (out + (err if merge_errors else "")).splitlines()
                yield pd.DataFrame({"path": path, "line_no": range(len(lines)), "line": lines}).astype({"line_no": "int32"})

    return files.select("path", "content").mapInPandas(each, "path string, line_no int, line string")


def nm_lines(objects: DataFrame) -> DataFrame:
    """``o_path, pos, line``; the tool's complaints come as lines too."""
    return lines_of(objects, ["nm"], merge_errors=True).select(F.col("path").alias("o_path"), F.col("line_no").alias("pos"), "line")


def readelf_lines(binaries: DataFrame) -> DataFrame:
    """``binary_id, line_no, line`` of the symbol tables."""
    return lines_of(binaries, ["readelf", "-s"]).select(F.col("path").alias("binary_id"), "line_no", "line")


_DIE = re.compile(r"<(\d+)><([0-9a-f]+)>: Abbrev Number: \d+ \((DW_TAG_\w+)\)")
_NAME = re.compile(r"DW_AT_name\s*:\s*(?:\(.*?\):\s*)?(.*?)\s*$")
_TYPE = re.compile(r"DW_AT_type\s*:\s*(?:\(.*?\)\s*)?<0x([0-9a-f]+)>")


def parse_dies(lines: list[str]) -> list[dict]:
    """Rows of debug-information entries from the text dump; the first attribute of a name is the one that counts."""
    rows: list[dict] = []
    above: dict[int, int] = {}
    for line in lines:
        if m := _DIE.search(line):
            depth, off = int(m[1]), int(m[2], 16)
            above[depth] = off
            rows.append({"die_off": off, "parent_off": above.get(depth - 1) if depth else None, "ord": len(rows), "tag": m[3], "name": None, "type_off": None})
        elif rows and rows[-1]["name"] is None and (m := _NAME.search(line)):
            rows[-1]["name"] = m[1]
        elif rows and rows[-1]["type_off"] is None and (m := _TYPE.search(line)):
            rows[-1]["type_off"] = int(m[1], 16)
    return rows


def debug_entries(objects: DataFrame) -> DataFrame:
    """``o_path, die_off, parent_off, ord, tag, name, type_off`` of each object; none without debug information."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["o_path", "die_off", "parent_off", "ord", "tag", "name", "type_off"]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with tempfile.NamedTemporaryFile() as f:
                    f.write(content)
                    f.flush()
                    _, out, _ = run(["readelf", "--debug-dump=info", f.name])
                rows = pd.DataFrame(parse_dies(out.splitlines()), columns=names[1:])
                rows.insert(0, "o_path", path)
                yield rows.astype({"die_off": "Int64", "parent_off": "Int64", "ord": "Int32", "type_off": "Int64"})

    return objects.select("path", "content").mapInPandas(each, fixed.DIES)


def run_commands(commands: DataFrame, column: str = "cmd", timeout: int = fixed.TIMEOUT_S) -> DataFrame:
    """``commands`` with ``rc`` and ``stderr``. Commands come from the tables, so run only those you trust; skipped ones get null."""
    schema = commands.schema.simpleString()[7:-1] + ", rc: int, stderr: string"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(None, None) if "skipped" in b and s else run(["sh", "-c", c], timeout)[::2] for c, s in zip(b[column], b["skipped"] if "skipped" in b else [False] * len(b), strict=True)]
            yield b.assign(rc=pd.array([d[0] for d in done], dtype="Int32"), stderr=[d[1] for d in done])

    return commands.mapInPandas(each, schema.replace(":", " "))


def error_log(results: DataFrame) -> DataFrame:
    """One entry for each command that failed."""
    return results.filter("rc <> 0").select("repo", F.concat_ws("\n", "cmd", "c_path", "stderr").alias("entry"))


def strip_comments(sources: DataFrame) -> DataFrame:
    """``repo, path, content`` through the C preprocessor's comment removal; unchanged where that fails."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                with tempfile.NamedTemporaryFile("w", suffix=".c", encoding="utf-8", errors="ignore") as f:
                    f.write(content or "")
                    f.flush()
                    rc, text, _ = run(["gcc", "-fpreprocessed", "-dD", "-E", "-P", f.name])
                out.append(text if rc == 0 else content)
            yield b.assign(content=out)

    return sources.select("repo", "path", "content").mapInPandas(each, "repo string, path string, content string")


def extract(binaries: DataFrame, load: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows from each binary by a loader of one's own (a disassembler, say); one that fails gives a row with ``status``.

    ``schema`` begins with ``binary_id string, status string``.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [{"binary_id": path, "status": "ok", **r} for r in load(bytes(content))]
                except Exception:
                    rows = [{"binary_id": path, "status": "load_failed"}]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return binaries.select("path", "content").mapInPandas(each, schema)


def arg_max() -> int:
    """Longest command of this system."""
    rc, out, _ = run(["getconf", "ARG_MAX"])
    return int(out) if rc == 0 and out.strip().isdigit() else os.sysconf("SC_ARG_MAX")

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oreweave.functions import python as P
from oreweave.operators import callgraph, debuginfo, labels
from oreweave.sources import elf, ingest, tools


def test_fast_reader_agrees_on_sound_lines(spark, tmp_path):
    rows = [{"repo_name": f"o/r{i % 3}", "file_array": [{"file_path": f"d{i}/x.c", "file_content": "a"}, {"file_path": "y.h", "file_content": str(i)}]} for i in range(9)]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    exact = ingest.files_of(ingest.parse_lines(ingest.read_lines(spark, str(tmp_path)))).select("repo", "path", "content")
    fast = ingest.files_of(ingest.read_json(spark, str(tmp_path))).select("repo", "path", "content")
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, fast.collect()))


def test_units_and_listing(spark):
    files = spark.createDataFrame([("r", "a/b/x.c", "1"), ("r", "a/y.h", "#include <z.h>"), ("q", "top.c", "#include <z.h>")], "repo string, path string, content string")
    units = {r["c_path"]: r["cmd"] for r in ingest.compile_units(files, "S", "O").collect()}
    assert units["S/r/a/b/x.c"] == 'ulimit -f 5242880 && timeout 60 gcc -c -gdwarf -O1 -o "O/r/a/b/x.o" "S/r/a/b/x.c" -I"S/r/a" -I"S/r/a/b"'
    assert units["S/q/top.c"].endswith('-o "O/q/top.o" "S/q/top.c" ')
    assert {r["content"] for r in ingest.quoted_sources(files).collect()} == {"1", '#include "z.h"'}
    listing = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "repo string, listed int")
    assert sorted(r["repo"] for r in ingest.resume_from(listing, "a").collect()) == ["a", "c"]
    assert ingest.resume_from(listing, "zz").count() == 0
    assert ingest.last_writes(files.withColumns({"file_idx": F.lit(0), "repo_name": F.lit("r"), "is_escaping": F.lit(False)})).count() == 3


def test_write_tree(spark, tmp_path):
    files = spark.createDataFrame([("r", "x.c", "1"), ("q", "y.c", "2")], "repo string, path string, content string")
    ingest.write_tree(files, str(tmp_path / "tree"))
    assert spark.read.parquet(str(tmp_path / "tree")).count() == 2


def test_tokens(spark):
    df = spark.createDataFrame([("a b  c",), ("",), (None,)], "t string")
    assert [r["n"] for r in df.select(P.token_counter(lambda: str.split)("t").alias("n")).collect()] == [3, 0, 0]
    found = Path("/opt/tokenizers/byte_bpe_50k.json")
    if found.exists():
        assert P.tokenizer_file(str(found))()("mov eax, 1")


def test_extract_and_missing_tools(spark):
    df = spark.createDataFrame([("p", bytearray(b"\1\2")), ("q", bytearray(b""))], "path string, content binary")

    def load(data):
        if not data:
            raise ValueError
        return [{"addr": b} for b in data]

    rows = {(r["binary_id"], r["status"], r["addr"]) for r in tools.extract(df, load, "binary_id string, status string, addr long").collect()}
    assert rows == {("p", "ok", 1), ("p", "ok", 2), ("q", "load_failed", None)}
    assert tools.run(["no-such-tool"])[0] == -1
    assert tools.arg_max() > 0


def test_first_source_by_name_and_fallbacks(spark):
    funcs = spark.createDataFrame([("/w/COMPILED/r/executable0", "f"), ("/w/COMPILED/r/executable0", "__g"), ("/w/COMPILED/r/executable0", "none")], "binary_path string, name string")
    src = spark.createDataFrame([("/w/C_COMPILE/r/", "b.c", "int f(void) { return 2; }"), ("/w/C_COMPILE/r/", "a.c", "int f(void) { return 1; }"), ("/w/C_COMPILE/r/", "a.h", "int f(void) { return 0; }"), ("/w/C_COMPILE/r/sub/", "0.c", "int f(void) { return 3; }")], "dir string, file string, content string")
    got = {r["name"]: r["real_src"] for r in labels.real_code(funcs, src).collect()}
    assert got == {"f": "int f(void) { return 1; }", "__g": None, "none": None}


def test_deep_pointers(spark):
    rows = [("a", i, 0, i, "DW_TAG_pointer_type", None, i + 1) for i in range(1, 13)] + [("a", 13, 0, 13, "DW_TAG_base_type", "int", None)]
    dies = spark.createDataFrame(rows, "o_path string, die_off long, parent_off long, ord int, tag string, name string, type_off long")
    names = {r["die_off"]: r["type_name"] for r in debuginfo.type_names(dies).collect()}
    assert names[12] == "int *" and names[3] == "int" + " *" * 10 and names[2] == "UNKNOWN_TYPE" + " *" * 11


@pytest.mark.parametrize("corrected, role", [(False, "caller"), (True, "callee")])
def test_roles(spark, corrected, role):
    edges = spark.createDataFrame([("b", 1, 2)], "binary_id string, src long, dst long")
    targets = spark.createDataFrame([("b", 1)], "binary_id string, target long")
    assert [tuple(r) for r in callgraph.neighbours(edges, 2, targets, corrected).collect()] == [("b", 1, 2, role, 1)]


def test_elf_tables(spark, tmp_path):
    if not shutil.which("as") or not shutil.which("ld"):
        pytest.skip("binutils are missing")
    (tmp_path / "a.s").write_text('.globl _start\n.type _start, @function\n_start:\n call helper\n ret\n.type helper, @function\nhelper:\n ret\n.section .rodata\n.globl text\ntext: .string "literal text"\n')
    (tmp_path / "b.s").write_text(".globl f\n.type f, @function\nf:\n call puts\n ret\n")
    for n in "ab":
        assert tools.run(["as", str(tmp_path / f"{n}.s"), "-o", str(tmp_path / f"{n}.o")])[0] == 0
    assert tools.run(["ld", str(tmp_path / "a.o"), "-o", str(tmp_path / "a.out")])[0] == 0
    (tmp_path / "junk.o").write_bytes(b"\x7fELF junk")
    objects = tools.read_binaries(spark, str(tmp_path), "{a.out,*.o}")
    base = lambda r: Path(r["binary_id"]).name
    rows = elf.functions(objects).collect()
    assert {(base(r), r["name"], r["status"]) for r in rows} == {("a.out", "_start", "ok"), ("a.out", "helper", "ok"), ("a.o", "_start", "ok"), ("a.o", "helper", "ok"), ("b.o", "f", "ok"), ("junk.o", None, "load_failed")}
    listed = {r["line"].split()[-1]: int(r["line"].split()[0], 16) for r in tools.nm_lines(objects.filter("path like '%a.out'")).collect()}
    assert all(listed[r["name"]] == r["addr"] for r in rows if base(r) == "a.out")
    assert {(base(r), r["symbol"]) for r in elf.undefined(objects).filter("status = 'ok'").collect()} == {("b.o", "puts")}
    loaded = [r for r in elf.segments(objects).collect() if base(r) == "a.out"]
    held = next(r for r in loaded if r["vaddr"] <= listed["text"] < r["vaddr"] + len(r["bytes"]))
    at = listed["text"] - held["vaddr"]
    assert bytes(held["bytes"])[at : at + 13] == b"literal text\0"

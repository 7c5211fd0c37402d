import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreweave.functions import columns as C
from oreweave.functions import python as P
from oreweave.sources import tools


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "code, want",
    [
        ("#include<a.h>", '#include "a.h"'),
        ("#include   <a/b.h>", '#include "a/b.h"'),
        ("# include <a.h>", "# include <a.h>"),
        ("#include <a.h> #include <b.h>", '#include "a.h" #include "b.h"'),
        ("#include <a.h>", '#include "a.h"'),
        ("#include\n<a.h>", '#include "a.h"'),
        ("#include <a b>", '#include "a b"'),
    ],
)
def test_includes(spark, code, want):
    assert one(spark, C.quote_includes(F.col("c")), c=code) == want


@pytest.mark.parametrize("text, kind", [("hello world", "STR"), ("%d items", "FMT"), ("%5.2f", "STR"), ("rm x", "CMD"), ("perform it", "CMD"), ("a;b", "CMD"), ("%ld", "STR"), ("IPTABLES", "CMD")])
def test_literal_kind(spark, text, kind):
    assert one(spark, C.literal_kind(F.col("t")), t=text) == kind


@pytest.mark.parametrize("data, want", [(b"", False), (b"abcdefg\x01\x01\x01", True), (b"abcdef\x01\x01\x01\x01", False), (b"\x0b\x0c", False), (b"a\t\n\r", True)])
def test_printable(spark, data, want):
    assert one(spark, C.is_printable(F.col("d")), d=data) is want


@pytest.mark.parametrize("symbol, want", [("printf@@GLIBC_2.2.5", "printf"), ("puts@GLIBC_2.2.5", "puts"), ("plain", "plain")])
def test_symbol_base(spark, symbol, want):
    assert one(spark, C.symbol_base(F.col("s")), s=symbol) == want


@pytest.mark.parametrize("kind, addr, want", [("STR", 0x4019E7, "STRx4019e7"), ("DAT", 0x404000, "DATx404000")])
def test_placeholder(spark, kind, addr, want):
    assert one(spark, C.placeholder(F.col("k"), F.col("a")), k=kind, a=addr) == want


@pytest.mark.parametrize(
    "name, plt, blocks, insns, target, want",
    [(None, False, 9, 99, False, False), ("", False, 9, 99, True, False), ("f", False, 1, 1, True, True), ("main", True, 1, 1, False, True), ("_start", False, 9, 99, False, False), ("f", True, 9, 99, False, False), ("__x", False, 9, 99, False, False), ("f", False, 2, 8, False, False), ("f", False, 2, 9, False, True), ("f", False, 3, 1, False, True), ("f", False, 0, 0, False, False)],
)
def test_user_like(spark, name, plt, blocks, insns, target, want):
    col = C.is_user_like(F.col("n").cast("string"), F.col("p"), C.is_tiny(F.col("b"), F.col("i")), F.col("t"))
    assert one(spark, col, n=name, p=plt, b=blocks, i=insns, t=target) is want


@pytest.mark.parametrize(
    "code, tags, want",
    [("int x;", [0], "int x;\n//executable0"), ("int x;", [10, 1], "int x;\n//executable1, executable10"), ("int x;\n//executable10", [1], "int x;\n//executable10"), ("", [2], "\n//executable2"), ("a\n//executable0\n", [3], "a\n//executable0, executable3"), ("a", [0, 0], "a\n//executable0")],
)
def test_program_tags(spark, code, tags, want):
    assert one(spark, C.with_program_tags(F.col("c"), F.array(*[F.lit(t) for t in tags])), c=code) == want


@pytest.mark.parametrize("path, want", [("S/r/a/b.c", "O/r/a/b.o"), ("S/r/x.tar.c", "O/r/x.tar.o"), ("S/r/none", "O/r/none.o")])
def test_mirror(spark, path, want):
    assert one(spark, C.mirrored(F.col("p"), F.lit("S"), F.lit("O/"), ".o"), p=path) == want


def test_constant_address(spark):
    def address(*operands):
        ops = ", ".join(f"named_struct('type', '{t}', 'imm', cast({i} as bigint), 'base', {b}, 'disp', cast({d} as bigint))" for t, i, b, d in operands)
        insn = f"named_struct('address', cast(8192 as bigint), 'size', 7, 'operands', array({ops}))"
        return spark.range(1).selectExpr(f"{insn} as i").select(C.constant_address(F.col("i")).alias("x")).first()["x"]

    assert address(("IMM", 0x1000, "null", "null")) is None
    assert address(("IMM", 0x1001, "null", "null")) == 0x1001
    assert address(("MEM", "null", "'rip'", 16)) == 8192 + 7 + 16
    assert address(("MEM", "null", "null", 0x5000)) == 0x5000
    assert address(("MEM", "null", "'rbp'", 0x5000), ("IMM", 0x2000, "null", "null")) == 0x2000


def test_normal_path_and_function_search(spark):
    paths = ["./a//b", "x/../../y", "/abs/./p", "a/.."]
    got = [r["x"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(P.normal_path("p").alias("x")).collect()]
    assert got == [posixpath.normpath(p) for p in paths]
    source = 'int other(void);\nstatic int f(int a) { if (a) { puts("}"); } return \'{\'; }\nint g() { return 0; }'
    assert P.find_function(source, "f") == 'static int f(int a) { if (a) { puts("}"); } return \'{\'; }'
    assert P.find_function(source, "other") is None
    assert P.find_function(source, "__f") is None


def test_annotation():
    src = 'p("hello\\n"); p("hello wurld"); fprintf(stderr, "");'
    out = P.annotate(src, [("hello world", "STRx2"), ("hello\n", "STRx1")])
    assert out == 'p(STRx1); p(STRx2); fprintf(STREAM_STDERR, "");'
    assert P.annotate('x("");', [("  ", "STRx3")]) == "x(STRx3);"


@given(st.text(alphabet='ab{}"\'\\ \n', max_size=60))
@settings(max_examples=200, deadline=None)
def test_braces_by_a_plain_scan(text):
    text = "{" + text
    depth, quote, i, want = 0, "", 0, None
    while i < len(text):
        ch = text[i]
        if quote:
            if ch == quote:
                quote = ""
            elif ch == "\\":
                i += 1
        elif ch in "\"'":
            quote = ch
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                want = i + 1
                break
        i += 1
    assert P._body_end(text, 0) == want


def test_debug_dump():
    dump = """ <0><b>: Abbrev Number: 1 (DW_TAG_compile_unit)
    <c>   DW_AT_name        : (indirect string, offset: 0x0): a.c
 <1><2d>: Abbrev Number: 2 (DW_TAG_base_type)
    <30>   DW_AT_name        : int
 <1><34>: Abbrev Number: 3 (DW_TAG_subprogram)
    <35>   DW_AT_name        : f
    <39>   DW_AT_type        : <0x2d>""".splitlines()
    rows = tools.parse_dies(dump)
    assert [(r["die_off"], r["parent_off"], r["tag"], r["name"], r["type_off"]) for r in rows] == [(0xB, None, "DW_TAG_compile_unit", "a.c", None), (0x2D, 0xB, "DW_TAG_base_type", "int", None), (0x34, 0xB, "DW_TAG_subprogram", "f", 0x2D)]

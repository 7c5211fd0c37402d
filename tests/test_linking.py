import random
import re

import pytest
from pyspark.sql import functions as F

from oreweave import adapters, queries
from oreweave.functions import columns as C
from oreweave.functions import python as P
from oreweave.operators import linking


@pytest.mark.parametrize("batch", [1, 7, 500_000])
@pytest.mark.parametrize("most_rows", [0, 20, 1000])
def test_edges_by_joins(spark, monkeypatch, batch, most_rows):
    monkeypatch.setattr(linking, "BATCH", batch)
    rng = random.Random(4)
    rows = {(f"r{r}", f"{o}.o", rng.randrange(6), t, f"s{rng.randrange(9)}") for r in range(3) for o in range(3 + 4 * r) for t in "UTTU"} | {("r1", f"{o}.o", 3, "T", "main") for o in range(3)} | {("r9", "x.o", 0, "U", "s1"), ("r8", "y.o", 0, "T", "s1")}
    s = spark.createDataFrame(sorted(rows), "repo string, o_path string, pos int, sym_type string, name string")
    got = sorted(map(tuple, linking.link_edges(s, most_rows).collect()))
    assert len(got) > 30 and got == sorted(map(tuple, linking._joined(s).collect()))


def test_pairs_are_not_shuffled(spark):
    s = spark.createDataFrame([("r", "a.o", 0, "U", "f"), ("r", "b.o", 0, "T", "f")], "repo string, o_path string, pos int, sym_type string, name string")
    for df in (linking.link_edges(s), linking.link_closure(s)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]


def odd_symbols(spark):
    rng = random.Random(9)
    rows = {(f"r{r}", f"{o}.o", rng.randrange(6), t, f"s{rng.randrange(3 * o + 3)}") for r in range(4) for o in range(3 + 5 * r) for t in "UTU"}
    rows |= {(f"r{r}", f"{o}.o", 3, t, "main") for r in range(4) for o in range(0, 9, 2) for t in "TU"[: 1 + o % 3]} | {("r9", "x.o", 0, "T", "main"), (None, "y.o", 0, "T", "main"), ("r7", "n.o", 0, "U", "s1")}
    return spark.createDataFrame(sorted(rows, key=str), "repo string, o_path string, pos int, sym_type string, name string")


@pytest.mark.parametrize("limits", [{}, {"most_rows": 40}, {"most_objects": 0}])
def test_programs_in_groups(spark, limits):
    s = odd_symbols(spark)
    want = linking.programs(s, linking.reached(s, **limits)).cache()
    got = linking.plans(s, **limits)
    assert got.count() > 10 and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    texts = ["int x;\n", "", None, "a\n//executable1\n", "//executable10, executable2", "//x"]
    sources = spark.createDataFrame([(r, f"{o}.o", texts[(o + i) % 6]) for i, r in enumerate(["r0", "r1", "r2", "r3", "r5", "r9", None]) for o in [*range(20), "x", "y"] if isinstance(o, int)] + [("r9", "x.o", "q")], "repo string, o_path string, content string")
    tagged = linking.tagged_by_symbols(sources, s, **limits)
    want = linking.tagged_sources(sources, want)
    assert sorted(map(str, tagged.collect())) == sorted(map(str, want.select(tagged.columns).collect()))
    assert tagged.filter("content like '%, executable%'").count() > 3


def test_tags_one_at_a_time(spark):
    """Both forms against the step for each program that they replace."""

    def plain(code, indices):
        for i in sorted(indices):
            name, last = f"executable{i}", re.search(r"[^\n]*\n?\Z", code)[0]
            if not last.startswith("//executable"):
                code += f"\n//{name}"
            elif name not in last:
                code = f"{code[: len(code) - len(last)]}{last.strip()}, {name}"
        return code

    codes = ["", "\n", "int x;\n", "a\n//executable1", "a\n//executable12, executable3 \n", "//executable\n\n", "//executable7\u2003\n", "b\n\n"]
    rows = [(c, i) for c in codes for i in ([], [0], [1, 2], [12, 1, 3], [3, 12, 100, 10], [5, 5])]
    df = spark.createDataFrame(rows, "code string, indices array<int>").select("code", "indices", C.with_program_tags(F.col("code"), F.col("indices")).alias("tagged"))
    for code, indices, tagged in df.collect():
        names = [f"executable{i}" for i in sorted(set(indices))]
        assert tagged == plain(code, indices) == P.with_program_tags(code, names, ", ".join(names))


def test_lists_of_programs_are_not_shuffled(spark, sf_dir):
    for name in ("link_programs", "program_tags"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_symbols_are_dealt_by_object_once(spark, sf_dir):
    plan = adapters.symbols(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Union")].count("Exchange") == 1

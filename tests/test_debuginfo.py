import random

from oreweave import adapters
from oreweave.operators import debuginfo

COLS = "o_path string, die_off bigint, parent_off bigint, ord int, tag string, name string, type_off bigint"


def plain_name(by, path, off, left):
    """By recursion, with ``left`` steps to go."""
    tag, name, to = by[path, off]
    if tag not in ("DW_TAG_pointer_type", "DW_TAG_const_type", "DW_TAG_volatile_type", "DW_TAG_restrict_type"):
        if tag in ("DW_TAG_structure_type", "DW_TAG_union_type", "DW_TAG_enumeration_type"):
            return f"{tag[7:]} {'/*anon*/' if name is None else name}"
        return name if name is not None else {"DW_TAG_base_type": "UNKNOWN_BASE", "DW_TAG_typedef": "typedef_anon"}.get(tag, "UNKNOWN_TYPE")
    pointer = tag == "DW_TAG_pointer_type"
    inner = ("void" if pointer else "UNKNOWN_TYPE") if to is None else "UNKNOWN_TYPE" if left == 0 or (path, to) not in by else plain_name(by, path, to, left - 1)
    return inner + " *" if pointer else {"DW_TAG_const_type": "const ", "DW_TAG_volatile_type": "volatile "}.get(tag, "") + inner


def test_type_names_of_random_entries(spark, monkeypatch):
    monkeypatch.setattr(debuginfo, "GROUP_ROWS", 50)
    rng = random.Random(1)
    tags = ["DW_TAG_pointer_type", "DW_TAG_const_type", "DW_TAG_volatile_type", "DW_TAG_restrict_type", "DW_TAG_base_type", "DW_TAG_typedef", "DW_TAG_union_type", "DW_TAG_member"]
    rows = [(f"o{o}", i * 7, 0, i, rng.choice(tags[: 3 + i % 6]), rng.choice([None, "n"]), rng.choice([None, rng.randrange(42) * 7, rng.randrange(42) * 7])) for o in range(9) for i in range(40)]
    by = {(r[0], r[1]): (r[4], r[5], r[6]) for r in rows}
    for depth in (0, 3, 10):
        got = {(r["o_path"], r["die_off"]): r["type_name"] for r in debuginfo.type_names(spark.createDataFrame(rows, COLS), depth).collect()}
        assert got == {k: plain_name(by, *k, depth) for k in by}


def test_entries_meet_once(spark, sf_dir):
    for df in (debuginfo.type_names(adapters.dies(spark, sf_dir)), debuginfo.signatures(adapters.dies(spark, sf_dir))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_signatures_of_odd_entries(spark):
    rows = [("a", 0, None, 0, "DW_TAG_compile_unit", None, None), ("a", 1, 0, 1, "DW_TAG_subprogram", "f", 99), ("a", 3, 1, 3, "DW_TAG_formal_parameter", "y", None), ("a", 2, 1, 2, "DW_TAG_formal_parameter", None, 5), ("a", 5, 0, 5, "DW_TAG_base_type", "int", None), ("a", 6, 5, 6, "DW_TAG_subprogram", "inner", 5), ("b", 1, 0, 1, "DW_TAG_subprogram", "no_unit", None), (None, 0, None, 0, "DW_TAG_member", None, None)]
    got = [tuple(r) for r in debuginfo.signatures(spark.createDataFrame(rows, COLS)).collect()]
    assert got == [("a", 1, "f", "UNKNOWN_TYPE f(int param, UNKNOWN_TYPE y);")]

"""Searches by blocks of targets against the operators on rows."""

import random
import time
from functools import partial

import pytest
from pyspark.sql import functions as F
from test_operators import plain_hops

from oreweave import adapters, queries
from oreweave.functions import hoods
from oreweave.operators import callgraph, selection
from oreweave.plans import store


def graph(spark, seed=5):
    rng = random.Random(seed)
    edges = [(b, rng.randrange(40) * 700, rng.randrange(40) * 700) for b in ("b", "c") for _ in range(110)]
    names = ["printf", "main", "_start", "__x", "", None, "f", "g", "h"]
    functions = [(b, i * 700, rng.choice(names), rng.random() < 0.1, 1 + i % 4, 6 + i % 5, rng.choice([0, 5, 30, 30, 140, 600])) for b in ("b", "c") for i in range(42) if i % 13]
    cols = "binary_id string, addr bigint, name string, is_plt boolean, n_blocks int, n_insns int, token_count bigint"
    return spark.createDataFrame(functions, cols), spark.createDataFrame(edges + edges[:9], "binary_id string, src bigint, dst bigint")


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("most", [1, 3, 1000])
def test_hops_by_blocks(spark, k, most):
    edges = {(1, 2), (2, 3000), (3000, 1), (3000, 4), (4, 4), (4, 5), (5, 2), (6, 1), (5, 6), (7, 7), (2, 1)}
    df = spark.createDataFrame([("b", *e) for e in edges], "binary_id string, src long, dst long")
    got = {(r["target"], r["addr"], role, r[role]) for r in callgraph.hops(df, k, most=most).collect() for role in callgraph.ROLES if r[role]}
    assert got == plain_hops(edges, k)


@pytest.mark.parametrize("corrected", [False, True])
def test_candidates_by_joins(spark, corrected):
    functions, edges = graph(spark)
    got = selection.candidates(functions, edges, corrected=corrected)
    first = callgraph.first_roles(callgraph.neighbours(edges, corrected=corrected))
    want = callgraph.calls_target(callgraph.user_like(first, functions), edges)
    want = want.join(callgraph.leaf_flags(functions, edges), ["binary_id", "addr"]).join(callgraph.callee_counts(functions, edges), ["binary_id", "addr"])
    want = want.withColumn("score", selection.score(F.col("calls_target"), F.col("n_callees"), F.col("degree"), F.col("token_count"))).select(got.columns)
    assert got.count() > 500 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("budget", [300, 700, 100_000])
def test_made_in_place_equal_those_of_rows(spark, budget):
    functions, edges = graph(spark, budget)
    cands = selection.candidates(functions, edges).cache()
    targets = functions.withColumnRenamed("addr", "target")
    chosen = selection.select_context(targets, cands, budget).cache()
    cands_known = cands.join(targets.select("binary_id", "target"), ["binary_id", "target"], "left_semi")
    pairs = [
        (selection.bundles_of(functions, edges), selection.bundles(cands)),
        (selection.degree_levels_of(functions, edges), selection.degree_levels(cands)),
        (selection.important_of(functions, edges), selection.important(cands)),
        (selection.groups_of(functions, edges, budget // 4), selection.take_group(cands, budget // 4)),
        (selection.context_of(functions, edges, budget), chosen),
        (selection.picked_of(functions, edges, budget), selection.picked_rows(chosen, cands_known)),
        (callgraph.counted(edges), callgraph.role_counts(callgraph.neighbours(edges))),
    ]
    for got, want in pairs:
        assert got.count() > 20 and sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


@pytest.mark.parametrize("name", "neighbours_k candidates_dedup role_counts candidates_filtered candidate_bundle calls_target candidate_score degree_level top5_important degree_group_fold selected_rows".split())
def test_pairs_are_not_shuffled(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Join" not in above


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: {f for f in (x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())) if f.endswith(".data")}
    df = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.collect_list("id").alias("ids"))
    before = files()
    kept = store.stored(df, "test")
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 5000 and df.count() == 5000
    assert spark.conf.get(store.CLEANUP) == "false"


def test_edges_need_no_further_order(spark, sf_dir):
    read = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    want = read.selectExpr("l_partkey as src", f"{adapters.EDGE_STEP} as dst").filter("dst is not null")
    got = adapters.edges(spark, sf_dir)
    assert not any("l_extendedprice" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" not in x)
    assert sorted(map(tuple, got.select("src", "dst").collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture
def far(monkeypatch):
    """Searches read stored pages; few cells at once, so that those found are merged in between and in batches."""
    monkeypatch.setattr(callgraph, "search", partial(callgraph.search, most_dealt=0, most_times=0))
    monkeypatch.setattr(hoods, "FOUND", 3000)


@pytest.mark.parametrize("corrected", [False, True])
def test_lists_are_not_dealt_to_blocks_without_locality(spark, far, monkeypatch, corrected):
    functions, edges = graph(spark)
    some = edges.filter("src % 3 = 0").selectExpr("binary_id", "src as target")
    makes = [
        lambda: selection.candidates(functions, edges, corrected=corrected),
        lambda: selection.candidates(functions, edges, 3, some, corrected),
        lambda: callgraph.neighbours(edges, 3, corrected=corrected),
        lambda: selection.picked_of(functions, edges, 700, corrected=corrected),
        lambda: selection.groups_of(functions, edges, 90, corrected=corrected),
        lambda: selection.bundles_of(functions, edges, corrected=corrected),
    ]
    got = [make() for make in makes]
    plan = got[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    got = [sorted(map(str, x.collect())) for x in got]
    monkeypatch.undo()
    want = [sorted(map(str, make().collect())) for make in makes]
    assert got == want and min(map(len, got)) > 20


def test_found_cells_are_merged_in_bounds(monkeypatch):
    monkeypatch.setattr(hoods, "CELLS", 16)
    monkeypatch.setattr(hoods, "PIECE", 500)
    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(150)}
    node = range(30)
    out, into = ([sorted({b for a, b in es if a == n}) for n in node] for es in (edges, {(b, a) for a, b in edges}))
    near = hoods.pa.table({"n": list(node), "kind": [1] * 30, "outs": out, "ins": into})
    page = lambda ns: next(hoods.packed(iter(hoods.pa.table({"binary_id": ["b"] * len(ns), "page": [ns[0]] * len(ns), "n": ns, "own": [True] * len(ns), "outs": [out[n] for n in ns], "ins": [into[n] for n in ns]}).to_batches()), ["n", "own", "outs", "ins"], {"b": (0, 5)}))
    rows = hoods.pa.Table.from_batches([page(ns).append_column("step", hoods.pa.array([step] * page(ns).num_rows)) for step in range(3) for ns in (list(range(12)), list(range(12, 30)))])
    for c, value in (("lo", 0), ("hi", 29), ("base", 0), ("bits", 5)):
        rows = rows.append_column(c, hoods.pa.array([value] * rows.num_rows))
    batch = rows.combine_chunks().to_batches()[0]
    near = near.append_column("binary_id", hoods.pa.array(["b"] * 30))
    cells = lambda space: sorted((t, a, r) for x in hoods.by_role(hoods.Block(space)) for t, a, r in zip(x["target"].tolist(), x["addr"].tolist(), zip(x["calls"].tolist(), x["degree"].tolist()), strict=True))
    want = cells(hoods.Near(near, 3, False))
    for found in (40, 100_000):
        monkeypatch.setattr(hoods, "FOUND", found)
        assert cells(hoods.Far(iter([batch]), 3, False)) == want and len(want) > 500
    with pytest.raises(RuntimeError):
        cells(hoods.Far(iter([batch.slice(batch.num_rows // 2), batch]), 3, False))

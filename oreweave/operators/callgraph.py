"""Call-graph operators over edge lists ``binary_id, src, dst``, for all targets of all binaries at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..functions import hoods
from ..plans import fixed
from ..plans.store import small, stored


def role_rank(role: Column) -> Column:
    return F.when(role == "caller", 0).otherwise(1)


def adjacency(edges: DataFrame, corrected: bool = False) -> DataFrame:
    """``binary_id, n, f, role``: neighbours of each node by either direction.

    As in the reference a successor has the role ``caller``; ``corrected`` gives roles their plain meaning.
    """
    out, into = ("callee", "caller") if corrected else ("caller", "callee")
    e = edges.select("binary_id", "src", "dst").distinct()
    return e.select("binary_id", F.col("src").alias("n"), F.col("dst").alias("f"), F.lit(out).alias("role")).unionByName(
        e.select("binary_id", F.col("dst").alias("n"), F.col("src").alias("f"), F.lit(into).alias("role"))
    )


ROLES = ("caller", "callee")


def lists(edges: DataFrame) -> DataFrame:
    """``binary_id, n, outs, ins``: different successors and predecessors of each node, stored."""
    ways = F.array(F.struct(F.col("src").alias("n"), F.col("dst").alias("out"), F.lit(None).cast("bigint").alias("into")), F.struct(F.col("dst").alias("n"), F.lit(None).cast("bigint").alias("out"), F.col("src").alias("into")))
    each = edges.select("binary_id", F.explode(ways).alias("x")).select("binary_id", F.col("x.n").cast("bigint").alias("n"), "x.out", "x.into")
    return stored(each.groupBy("binary_id", "n").agg(F.collect_set("out").alias("outs"), F.collect_set("into").alias("ins")), "lists")


def _page(addr: Column) -> Column:
    """Addresses that are looked up together: 1024 of them."""
    return F.shiftright(addr, 10)


def _far(around: DataFrame, make, schema: str, degrees: int, targets: DataFrame | None, corrected: bool, facts: DataFrame | None, kind: type[hoods.Block]) -> DataFrame | None:
    """:func:`search` without a shuffle of lists to blocks: pages of lists are packed once and stored, and each block reads all of them, once a step.

    None if addresses are too far apart for it.
    """
    spark = around.sparkSession
    n, each = F.col("n"), (F.size("outs") + F.size("ins")).cast("double")
    binaries = around.groupBy("binary_id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("nodes"), F.sum(each).alias("all"), F.sum(each * each).alias("squares")).collect()
    found, shift, base, size = [], {}, {}, {}
    for b in binaries:
        bits = (b["high"] - b["low"] + 1).bit_length()
        # what a target's search finds, with repeats; some blocks for each core
        expected = max(1.0, min(float(b["nodes"]) * 4, b["all"] / b["nodes"] * (b["squares"] / max(1.0, b["all"])) ** (degrees - 1)))
        size[b["binary_id"]] = max(1, min(int(hoods.FOUND * 0.8 / expected), -(-b["nodes"] // 24)))
        shift[b["binary_id"]] = max(0, ((b["high"] - b["low"] + 1) * 1024 // b["nodes"]).bit_length() - 1)
        base[b["binary_id"]] = b["low"], bits
        if bits + size[b["binary_id"]].bit_length() + 2 > 62:
            return None
        found.append((b["binary_id"], b["low"], shift[b["binary_id"]], size[b["binary_id"]]))
    about = F.broadcast(spark.createDataFrame(found, "binary_id string, low bigint, shift int, size bigint"))
    whole = around.select("binary_id", "n")
    if targets is not None:
        whole = whole.join(targets.select("binary_id", F.col("target").alias("n")).distinct(), ["binary_id", "n"], "left_semi")
        around = around.join(whole.withColumn("own", F.lit(True)), ["binary_id", "n"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    else:
        around = around.withColumn("own", F.lit(True))
    page = F.expr("shiftright(n - low, shift)").cast("bigint")
    place = F.row_number().over(Window.partitionBy("binary_id").orderBy("n")) - 1
    blocks = whole.withColumn("place", place).join(about, "binary_id").groupBy("binary_id", F.expr("place div size").alias("block")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(page).alias("from"), F.max(page).alias("to")).orderBy("binary_id", "block").collect()

    def as_pages(df: DataFrame, columns: list[str]) -> DataFrame:
        def one(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from hoods.packed(parts, columns, base)

        return df.select("binary_id", "page", *columns).groupBy("binary_id", "page").applyInArrow(one, "binary_id string, page bigint, more int, packed binary")

    pages = stored(as_pages(around.join(about, "binary_id").withColumn("page", page), ["n", "own", "outs", "ins"]), "packed-lists")
    steps = [pages.withColumn("step", F.lit(d)) for d in range(degrees)]
    if facts is not None:
        dealt = facts.join(about.select("binary_id"), "binary_id").withColumn("page", F.pmod(F.xxhash64("n"), F.lit(max(1, sum(b["nodes"] for b in binaries) // 4096))))
        steps.insert(0, stored(as_pages(dealt, [c for c in facts.columns if c != "binary_id"]), "packed-facts").withColumn("step", F.lit(-1)))
    pick = lambda values: F.element_at(F.lit(values), (F.col("id") + 1).cast("int"))
    of = [b["binary_id"] for b in blocks]
    named = {"of": of, "lo": [b["lo"] for b in blocks], "hi": [b["hi"] for b in blocks], "from": [b["from"] for b in blocks], "to": [b["to"] for b in blocks], "base": [base[x][0] for x in of], "bits": [base[x][1] for x in of]}
    # a partition a block, which all pages pass by in order of step
    each_block = spark.range(0, len(blocks), 1, len(blocks)).select(*[pick(v).cast("string" if c == "of" else "bigint").alias(c) for c, v in named.items()]).hint("shuffle_replicate_nl")
    passing = reduce(DataFrame.unionByName, steps).coalesce(1).join(each_block, (F.col("binary_id") == F.col("of")) & ((F.col("step") != 0) | F.col("page").between(F.col("from"), F.col("to"))))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def one(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from hoods.run_far(parts, make, kind, degrees, corrected, arrow)

    return passing.select("binary_id", "step", "lo", "hi", "base", "bits", "page", "more", "packed").mapInArrow(one, schema)


def search(around: DataFrame, make, columns: str, degrees: int = fixed.DEGREES, targets: DataFrame | None = None, corrected: bool = False, facts: DataFrame | None = None, kind: type[hoods.Block] = hoods.Block, most: int = 20_000, most_dealt: int = 64_000_000, most_times: float = 2.5) -> DataFrame:
    """``binary_id, target`` and ``columns`` as ``make`` (see ``hoods``) finds them from what is within ``degrees`` (up to 254) steps of each target.

    ``around`` is a table of :func:`lists`. Targets next to each other by address, at most ``most``, are a block. A block gets the lists of the pages of
    addresses that its search passes, and the ``facts`` (``binary_id, n`` and more) of those it may end at, in one shuffle of lists: pairs of targets and neighbours are formed
    in the block only and never shuffled. ``targets`` (``binary_id, target``) restricts the search; by default all nodes are targets.

    Where that would shuffle over ``most_dealt`` entries of lists and ``most_times`` those there are, as in large graphs without locality, blocks read the stored lists instead.
    """
    whole = around.select("binary_id", "n")
    if targets is not None:
        whole = whole.join(targets.select("binary_id", F.col("target").alias("n")).distinct(), ["binary_id", "n"], "left_semi")
    schema = f"binary_id string, target bigint, {columns}"
    # some blocks for each core even of small tables
    size = max(1, min(most, -(-around.count() // 48)))
    place = F.row_number().over(Window.partitionBy("binary_id").orderBy("n"))
    own = stored(whole.select("binary_id", "n", F.floor((place - 1) / size).cast("int").alias("block")), "blocks")
    next_to = F.concat("outs", "ins")
    paged = lambda df: df.select("binary_id", "block", F.explode(next_to).alias("f")).select("binary_id", "block", _page(F.col("f")).alias("page")).distinct()
    mine = around.join(own, ["binary_id", "n"])
    pages = [stored(mine.select("binary_id", "block", _page(F.col("n")).alias("page")).distinct(), "pages")]
    weights = stored(around.groupBy("binary_id", _page(F.col("n")).alias("page")).agg(F.sum(F.size("outs") + F.size("ins") + 2).alias("entries")), "weights")
    entries, tried = weights.agg(F.sum("entries")).first()[0] or 0, False
    reached = mine
    for d in range(1, degrees + 1 if facts is not None else degrees):
        pages.append(stored(paged(reached), "pages"))
        if d < degrees:
            if not tried and entries * 48 > most_dealt:
                dealt_to = reduce(DataFrame.unionByName, pages).distinct().join(weights, ["binary_id", "page"]).agg(F.sum("entries")).first()[0] or 0
                if dealt_to > max(most_dealt, most_times * entries):
                    tried, out = True, _far(around, make, schema, degrees, targets, corrected, facts, kind)
                    if out is not None:
                        return out
            reached = around.withColumn("page", _page(F.col("n"))).join(small(pages[-1], 200_000), ["binary_id", "page"])
    dealt = lambda df, pages: df.withColumn("page", _page(F.col("n"))).join(small(stored(reduce(DataFrame.unionByName, pages).distinct(), "pages"), 200_000), ["binary_id", "page"]).drop("page")
    rows = dealt(around, pages[:degrees]).join(own.withColumn("kind", F.lit(1)), ["binary_id", "n", "block"], "left").withColumn("kind", F.coalesce("kind", F.lit(0)))
    if facts is not None:
        rows = rows.unionByName(dealt(facts, pages).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def one(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from hoods.run(parts, make, kind, degrees, corrected, arrow)

    return rows.groupBy("binary_id", "block").applyInArrow(one, schema)


def hops(edges: DataFrame, degrees: int = fixed.DEGREES, targets: DataFrame | None = None, corrected: bool = False, **limits: int) -> DataFrame:
    """``binary_id, target, addr, caller, callee``: who is within ``degrees`` steps, with the smallest degree by either role.

    Nodes of one round count as visited in ascending order: a neighbour in the same round is taken from a smaller node only,
    or through a self-loop. ``targets`` (``binary_id, target``) restricts the search; by default all nodes are targets.
    """
    return search(lists(edges), hoods.neighbours, "addr bigint, caller int, callee int", degrees, targets, corrected, **limits)


def neighbours(edges: DataFrame, degrees: int = fixed.DEGREES, targets: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """``binary_id, target, addr, role, degree``: :func:`hops`, a row a role."""
    rows = search(lists(edges), hoods.by_role, "addr bigint, calls boolean, degree int", degrees, targets, corrected)
    return rows.select("binary_id", "target", "addr", F.when(F.col("calls"), ROLES[0]).otherwise(ROLES[1]).alias("role"), "degree")


def nearest(hopped: DataFrame) -> DataFrame:
    """Rows of :func:`hops`, each with its caller entry if it has one, even at a larger degree."""
    role = F.when(F.col("caller").isNotNull(), ROLES[0]).otherwise(ROLES[1])
    return hopped.select("binary_id", "target", "addr", role.alias("role"), F.coalesce(*ROLES).alias("degree"))


def counted(edges: DataFrame, degrees: int = fixed.DEGREES, targets: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """``binary_id, target, n_callers, n_callees``: :func:`role_counts` without rows of neighbours."""
    return search(lists(edges), hoods.counts, "n_callers bigint, n_callees bigint", degrees, targets, corrected)


def first_roles(found: DataFrame) -> DataFrame:
    """One row for each neighbour: its caller entry if it has one, even at a larger degree."""
    best = found.groupBy("binary_id", "target", "addr").agg(F.min(F.struct(role_rank(F.col("role")).alias("r"), "degree", "role")).alias("b"))
    return best.select("binary_id", "target", "addr", F.col("b.role").alias("role"), F.col("b.degree").alias("degree"))


def role_counts(found: DataFrame) -> DataFrame:
    """``binary_id, target, n_callers, n_callees``."""
    n = lambda role: F.count_if(F.col("role") == role)
    return found.groupBy("binary_id", "target").agg(n("caller").alias("n_callers"), n("callee").alias("n_callees"))


def leaf_flags(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``binary_id, addr, is_leaf``: whether a function calls nothing."""
    callers = edges.select("binary_id", F.col("src").alias("addr"), F.lit(False).alias("_leaf")).distinct()
    return functions.join(callers, ["binary_id", "addr"], "left").select("binary_id", "addr", F.coalesce("_leaf", F.lit(True)).alias("is_leaf"))


def callee_counts(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``binary_id, addr, n_callees``: different known functions a function calls that are not junk."""
    known = functions.filter(~F.col("name").isin(fixed.JUNK_FUNCTIONS) | F.col("name").isNull()).select("binary_id", F.col("addr").alias("dst"))
    counted = edges.select("binary_id", "src", "dst").distinct().join(known, ["binary_id", "dst"]).groupBy("binary_id", F.col("src").alias("addr")).agg(F.count("*").alias("_n"))
    return functions.join(counted, ["binary_id", "addr"], "left").select("binary_id", "addr", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_callees"))


def calls_target(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (``binary_id, target, addr`` and more) with ``calls_target``."""
    e = edges.select("binary_id", F.col("src").alias("addr"), F.col("dst").alias("target"), F.lit(True).alias("calls_target")).distinct()
    return pairs.join(e, ["binary_id", "target", "addr"], "left").withColumn("calls_target", F.coalesce("calls_target", F.lit(False)))


def target_named(functions: DataFrame, name: str) -> DataFrame:
    """The function of that name with the smallest address, of each binary."""
    return functions.filter(F.col("name") == name).groupBy("binary_id").agg(F.min("addr").alias("target"))


def flow_metrics(block_edges: DataFrame) -> DataFrame:
    """``binary_id, func_addr, src, dst`` (dst null: a block without successor) to node and edge counts."""
    nodes = block_edges.select("binary_id", "func_addr", F.explode(F.array("src", "dst")).alias("b")).filter("b is not null").groupBy("binary_id", "func_addr").agg(F.count_distinct("b").cast("int").alias("cfg_nodes"))
    edges = block_edges.filter("dst is not null").select("binary_id", "func_addr", "src", "dst").distinct().groupBy("binary_id", "func_addr").agg(F.count("*").cast("int").alias("cfg_edges"))
    return nodes.join(edges, ["binary_id", "func_addr"], "left").withColumn("cfg_edges", F.coalesce("cfg_edges", F.lit(0)))


def without_junk(functions: DataFrame) -> DataFrame:
    return functions.filter(~F.coalesce(F.col("name").isin(fixed.JUNK_FUNCTIONS), F.lit(False)))


def user_like(found: DataFrame, functions: DataFrame) -> DataFrame:
    """Neighbours joined to their functions, those of the runtime, stubs and trampolines left out."""
    f = functions.withColumn("is_tiny", C.is_tiny(F.col("n_blocks"), F.col("n_insns")))
    joined = found.join(f, ["binary_id", "addr"])
    return joined.filter(C.is_user_like(F.col("name"), F.col("is_plt"), F.col("is_tiny"), F.col("addr") == F.col("target")))

"""Connected components: a bounded number of edges in one task, more by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node each is connected to, by minima over edges and pointer jumping."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, at_once: int = 2_000_000, rounds: int = 60) -> DataFrame:
    """``a, b`` (longs) to ``node, root``: each node of an edge with the smallest node it is connected to.

    Up to ``at_once`` edges (16 bytes each) are one task's work. With more, each round first hangs every node's larger neighbours on its smallest one, then every node's smaller neighbours; both keep
    connectivity, and what is left at the end is a star a component. No step gathers a node's neighbours in one row, and the
    minimum of a node with many is formed before the shuffle. Raises if ``rounds`` do not do.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.limit(at_once + 1).count() <= at_once:

        def whole(batches):
            got = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches]
            if got:
                node, root = roots(*(np.concatenate(c) for c in zip(*got, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        return now.coalesce(1).mapInArrow(whole, "node long, root long")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = stored(down, "edges")
        dropped(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)
        mark = seen
    raise RuntimeError("components did not settle")

"""Connected components of an undirected graph by contraction, in DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``: every node that has an edge, with the same root as all it reaches.

    Each round hooks every node that has a smaller neighbour to its smallest one, flattens the resulting trees by
    pointer jumping and contracts the edges to the roots. At least half of the nodes left with edges go in a round,
    so the number of rounds is logarithmic. Nothing is collected but counts; every aggregate combines map-side.
    Null ends and self loops are ignored; no edges give no rows.
    """
    tidy = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    left = scratch.table(tidy, "edges")
    found = None
    while not left.isEmpty():
        parents = scratch.table(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "parents")
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = scratch.table(parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jumped")
            done = jumped.filter("moved").isEmpty()
            parents = jumped.drop("moved")
            if done:
                break
        lo = parents.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        hi = parents.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        ends = left.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_root", "lo").alias("x"), F.coalesce("hi_root", "hi").alias("y")).filter("x <> y")
        left = scratch.table(ends.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "contracted")
        if found is None:
            found = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = scratch.table(found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(parents), "found")
    if found is None:
        return tidy.select(F.col("lo").alias("node"), F.col("hi").alias("root")).limit(0)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())

"""Connected components by alternating large-star and small-star steps.

Each step is one group-by and one join over the edges; the edge set shrinks towards stars around
the smallest member, in a number of rounds that grows with the logarithm of the component size.
A hub of any degree is handled by a partially aggregated minimum and a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.plans.scratch import Scratch


def _to_smallest(edges: DataFrame, scratch: Scratch, only_smaller: bool) -> DataFrame:
    """Link neighbours of each node to its smallest neighbour (or itself).

    only_smaller False: large star, larger neighbours move. True: small star, smaller ones and the node move.
    """
    if only_smaller:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    smallest = scratch.save(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "smallest")
    moved = around.join(smallest, F.col("u") == F.col("k"))
    if only_smaller:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(smallest.select(F.col("k").alias("a"), F.col("m").alias("b")))
    else:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    saved = scratch.save(out.filter("a <> b").distinct(), "edges")
    scratch.drop(edges, smallest)
    return saved


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node.

    Self-links and repeated links are allowed; no edges give no rows. Nodes without a link are not listed.
    """
    now = scratch.save(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    known = None
    while True:
        now = _to_smallest(_to_smallest(now, scratch, False), scratch, True)
        # stars only grow towards smaller centres, so an unchanged sum of centres means that nothing moved
        state = now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if known == tuple(state) or not state[0]:
            break
        known = tuple(state)
    leaves = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component")).distinct()

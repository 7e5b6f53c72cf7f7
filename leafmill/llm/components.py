"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000000007)).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node that is reachable.

    Each step groups by node with partial minima and joins the minima back, so a node with very many edges is
    pre-aggregated in the one and split by adaptive execution in the other.  Each step is written and deletes the one
    before it; the result reads the last one, a table of ``scratch``.  Edges
    with a null end and loops are left out; repeated edges count once; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.keep(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _print(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        # Large star: neighbours above a node point to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours below a node, and the node, point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        edges = scratch.keep(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
            edges,
        )
        after = _print(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

"""Connected components of an edge table: a distributed union-find by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks each node's neighbours to the least of its neighbourhood: those above it (large), or those below it (small).

    The least neighbour comes from an aggregation that is summed before it is
    shuffled, so that a node with very many links costs no more than others.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        return met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    hooked = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node that it reaches) for each node of ``edges`` (two columns of bigint).

    Loops and repeated edges do no harm, nodes without an edge are not
    returned, and edges with a null end are left out. Each round ends in a
    written table. At a fixed point every node hangs on its component's least.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct()
    now, before = keep(now, "edges"), None
    for _ in range(rounds):
        new = keep(_star(_star(now, True), False), "edges")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_kept(now.sparkSession, now)
        now = new
        if tuple(sign) == before:
            break
        before = tuple(sign)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b): each node's neighbours move to its least neighbour."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(low, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, scratch: Scratch | None = None
) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node reachable.

    Nodes of any orderable type. The result is read from a table of ``scratch``, which its owner
    deletes; tables of earlier rounds are deleted here. Null ends and self loops add nothing. Every round is
    written to the shared folder, so the lineage stays short; only two numbers a round
    (row count and an order-free checksum) reach the driver. All aggregates combine on
    the map side, so a hub's edges are summed before they are shuffled.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = scratch.put(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        after = scratch.put(_star(_star(now, True), False), "edges")
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import persist, shuffle_partitions

#: Edges that one task of a round holds about.
EDGES_A_TASK = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of a node hangs on its least neighbour; else the smaller ones do."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b) edges of any orderable type to (node, label): the least node that is reachable.

    Nodes without an edge don't occur. Loops and repeated edges do no harm; nulls are ignored. A
    step needs one aggregation and one join, which adaptive execution splits where a node is hot.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = persist(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # Few edges need few tasks: a round's work is mostly their start.
    rows = edges.count()
    if not rows:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    tasks = min(shuffle_partitions(edges.sparkSession), rows // EDGES_A_TASK + 1)
    seen, folder = None, []
    for _ in range(max_rounds):
        edges = persist(_star(edges, True).repartition(tasks), "large", folder)
        edges = persist(_star(edges, False).repartition(tasks), "small", folder)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = tuple(now)
    raise RuntimeError("components did not settle")

"""Connected components by alternating large-star and small-star rounds.

Every step is an aggregation by node, and an edge then meets the smallest neighbour of its ends in a join, so a node
with very many neighbours is pre-aggregated and its partition of the join can be split. Steps are work tables: rounds
do not grow the lineage, a step's tables go when the next round's are written, and nothing but counts, observed as they are
written, reaches the driver. They are also what keeps a round short, as every job, plan and task costs the driver memory: each
aggregation is made once, tells by its counts whether the step after it is needed at all, and is broadcast if it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpuslake.llm.common import discard, written

#: Nodes whose neighbours are broadcast at most (some 5 MB); beyond that both sides are dealt out by node.
_BROADCAST = 100_000


def _counted(nodes: DataFrame, name: str, which: str) -> tuple[DataFrame, int, int]:
    """``nodes`` as a work table, how many they are, and of how many ``which`` holds."""
    seen = Observation()
    table = written(nodes.observe(seen, F.count("*").alias("n"), F.count_if(F.expr(which)).alias("some")), name)
    return table, seen.get["n"], seen.get["some"]


def _joined(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    return edges.join(F.broadcast(nodes) if n <= _BROADCAST else nodes, "node")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that is not the smallest of its component.

    ``edges`` has long columns a and b; loops and repeated edges change nothing.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b"), "edges")
    old = [edges]
    while True:  # a > b, edges may be repeated
        both = edges.toDF("node", "other").union(edges.select("b", "a"))
        lower = F.when(F.col("other") < F.col("node"), F.col("other"))
        near = both.groupBy("node").agg(F.min(lower).alias("least"), F.max(lower).alias("most"), F.max("other").alias("top"))
        near, n, unsettled = _counted(near, "near", "least != most OR least IS NOT NULL AND top > node")
        if not unsettled:  # every node has none but larger neighbours or the smallest of its component alone
            discard(*old)
            return near.filter("least IS NOT NULL").select(F.col("node").alias("id"), F.col("least").alias("component"))
        # Large star: larger neighbours of a node go to the smallest of it and its neighbours.
        large = _joined(edges.select(F.col("b").alias("node"), "a"), near.select("node", F.coalesce("least", "node").alias("b")), n).select("a", "b")
        # Small star: smaller neighbours of a node, and itself, go to the smallest of them.
        stars = large.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("last"))
        stars, _, several = _counted(stars, "stars", "b != last")
        made, edges = [near, stars], stars.select("a", "b")
        if several:
            moved = _joined(large.toDF("node", "b"), stars.filter("b != last").select(F.col("a").alias("node"), F.col("b").alias("least")), several)
            moved = written(moved.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "moved")
            made, edges = [*made, moved], edges.union(moved)
        discard(*old)
        old = made

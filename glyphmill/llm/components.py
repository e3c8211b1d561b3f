"""Connected components of an edge table, without collecting it anywhere.

Every edge points from a node to a smaller one. Each round keeps, for a node
with several smaller neighbours, the least of them and links the others to it,
then replaces every pointer by its target's own. Rounds repeat until each node
points at a root; a long chain halves with every round. Aggregates are
minimums (combined before the shuffle) and joins are plain shuffled inner or
left joins, which the runtime splits when many nodes share a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node with a smaller node in its component.

    ``edges``: columns ``a`` and ``b`` of one orderable type; loops and repeats
    do no harm. The roots themselves have no row.
    """
    up = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r"))
    up = scratch.keep(up.distinct(), "edges")
    for _ in range(max_rounds):
        # Written first, so that both sides of the joins are plain shuffles and a hub is split.
        least = scratch.keep(up.groupBy("v").agg(F.min("r").alias("m")), "least")
        linked = up.join(least, "v").where("r <> m").select(F.col("r").alias("v"), F.col("m").alias("r"))
        small = scratch.keep(least.select("v", F.col("m").alias("r")).union(linked).distinct(), "star")
        scratch.drop(up)
        # Pointer jumping: the target's least neighbour stands in for the target.
        target = scratch.keep(small.groupBy("v").agg(F.min("r").alias("m")).withColumnRenamed("v", "_v"), "target")
        jumped = small.join(target, small["r"] == target["_v"], "left").select("v", F.coalesce("m", "r").alias("r"), F.col("m").isNotNull().alias("_moved"))
        kept = scratch.keep(jumped.groupBy("v", "r").agg(F.max("_moved").alias("_moved")), "jump")
        # Done when no target moved and no node has two targets.
        moved, rows, nodes = kept.agg(F.coalesce(F.max("_moved"), F.lit(False)), F.count(F.lit(1)), F.count_distinct("v")).first()
        # A jump drops the link v -> r itself; r keeps its own pointer, so the component stays joined.
        up = kept.select("v", "r")
        scratch.drop(small)
        up._scratch_path = kept._scratch_path  # type: ignore[attr-defined]
        if not moved and rows == nodes:
            return up.select(F.col("v").alias("node"), F.col("r").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

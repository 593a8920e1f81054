"""Connected components by alternating large-star and small-star steps.

Each step hangs nodes onto the least neighbour they know of. Minima are
aggregated before they are joined, so a node with a third of all edges is one
row per task in the aggregate and a skewed, splittable key in the join. Edges
are stored after every round; nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node go to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.where("b > a").join(least, "a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node but the roots, which are the least of their components.

    ``edges`` has columns ``a`` and ``b`` of one ordered type; loops, repeats
    and either direction are fine. No edges give no rows.
    """
    current = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == before or mark[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        current = stored(_small_star(_large_star(current)), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

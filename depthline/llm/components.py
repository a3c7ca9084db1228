"""Connected components by alternating large-star and small-star rounds.

Every round is joins and minimum aggregations keyed by node, with partial
aggregation before each shuffle; a hub is a skewed join key, never a collected list.
Each round's edges are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``(u, v)`` with ``u > v`` hung on the smallest neighbour: of the larger ones, or of the smaller ones."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has an edge to another.

    A round's edges go as soon as the next round's are written.
    """
    spark = edges.sparkSession
    last = Scratch(spark)
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges", last)
    mark = None
    for _ in range(rounds):
        newer = Scratch(spark)
        now = stored(_star(_star(now, True), False), "edges", newer)
        last.close()
        last = newer
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    both = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = stored(both, "components")
    last.close()
    return out

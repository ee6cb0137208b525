"""Connected components of an edge table, as DataFrame joins.

Large-star / small-star rounds: each round hooks every node's neighbours to
the smallest node it sees, until the edge table is a set of stars.  A round is
two aggregations with a map-side minimum and two equi-joins whose other side
has one row per node, so a node with very many edges is pre-aggregated first
and its edges can be split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hooked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node, root)``: one row for every node
    that is not the smallest of its component; ``root`` is the smallest node.

    Loops and repeated edges are ignored; an empty edge table gives no rows.
    Raises if ``max_rounds`` rounds do not settle (rounds grow with the
    logarithm of the longest path)."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        e = materialise(_small_star(_large_star(e)).distinct(), "edges")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components of a table of links, by large-star and small-star steps.

Each step is one aggregation (the smallest neighbour of every node, combined before the
shuffle) and one join; a node with very many neighbours is split by the join's skew handling.
The tables are written after each round, and rounds go on until the links stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _sum_of(links: DataFrame) -> tuple:
    """What two equal tables of links share."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """id, root: for every id in a link the smallest id it can reach."""
    links = cut_lineage(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter("u <> v").dropDuplicates()
    )
    before = None
    while True:
        state = _sum_of(links)
        if state == before or not state[0]:
            break
        before = state
        # Large star: neighbours above a node move to its smallest neighbour.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates()
        large = cut_lineage(large)
        # Small star: a node's neighbours below it, and itself, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(moved.unionByName(least.select("u", F.col("m").alias("v"))).dropDuplicates())
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("root")).dropDuplicates())

"""Connected components of a link table, by alternating star operations.

Every round sends links of a vertex to its smallest neighbour: first the larger neighbours
(large star), then the smaller ones (small star).  The number of rounds grows with
the logarithm of the longest chain.  Only minima are aggregated, so a vertex with very many
neighbours is combined before the shuffle and is never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = _both_ways(links)
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
    else:
        # every smaller neighbour and the vertex itself now point to the smallest
        moved = moved.select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(
            least.select("u", F.col("w").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Links are pairs of longs in any order; repeated links and links of a node to itself do no harm.
    Links with a null end are ignored.
    """
    pairs = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    pairs = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        pairs = stored(_star(_star(pairs, large=True), large=False), "links")
        # stable when no link changes: count and an order-free sum of hashes
        sums = pairs.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if before == sums:
            break
        before = sums
    own = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)

"""Connected components of a link table by alternating large and small stars, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _ordered(both.where(F.col("v") > F.col("u")).join(checkpointed(least).hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the smallest one."""
    least = checkpointed(links.groupBy("u").agg(F.min("v").alias("m")))
    return _ordered(links.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node but the smallest of its component, with that smallest node.

    A node with very many links is one row per task in the minimum (partial aggregation). The minima are written before they
    are joined, so both sides of the join are plain sorted shuffles and Spark divides the partition of such a node. Every
    round is checkpointed; the number of rounds grows with the logarithm of the longest chain.
    """
    now = checkpointed(_ordered(links))
    mark = _fingerprint(now)
    while mark[0]:
        now = checkpointed(_small_star(_large_star(now)))
        mark, before = _fingerprint(now), mark
        if mark == before:
            break
    return now

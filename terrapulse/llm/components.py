"""Connected components of a link table, by alternating star contractions.

Every step is a pair of aggregates over the links; a hot node costs one row for each
of its neighbours and is never gathered. Steps are cut by checkpoints and end when the
links are stars, after a number of steps logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (or smaller-or-equal) neighbours to its smallest one."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        out = near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        near = links.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a > b
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
        out = near.join(least, "a").select(F.col("m").alias("a"), "b").unionByName(own)
    return out.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots; root is the smallest node."""
    now = checkpointed(links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    print_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, after = None, print_of(now)
    while before != after:
        now = checkpointed(_star(_star(now, True), False))
        before, after = after, print_of(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))

"""Exact quantiles by counting in value ranges.

A quantile needs the values at one or two ranks of a group. The group's range of values is
cut into ``RANGES`` equal parts and the rows of each are counted; the part that holds the rank
becomes the next range, from its smallest to its largest value, until that is one value.
Every round is a partial + final aggregate of at most ``RANGES`` counts a target and task, so no
group's values are gathered or sorted, however many there are; measures of few
values end after one round and continuous ones after a few.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

RANGES = 256
#: Targets (two a group and measure) up to which a round sends them to every task.
BROADCAST_TARGETS = 100_000


def _part(v: Column, low: Column, high: Column) -> Column:
    """The number of the equal part of ``low``..``high`` that ``v`` lies in; halves, as the width may overflow."""
    width = high / 2 - low / 2
    inside = F.least(F.lit(RANGES - 1), F.floor((v / 2 - low / 2) / width * RANGES))
    return F.when(width > 0, inside).otherwise(F.when(v > low, RANGES - 1).otherwise(0)).cast("int")


def _refined(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``targets`` with the range cut to the part that holds their rank."""
    mine = targets.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    near = values.join(F.broadcast(mine) if mine.count() <= BROADCAST_TARGETS else mine, same)
    near = near.where(F.col("v").between(F.col("low"), F.col("high")))
    target = [*keys, "which", "rank"]
    counts = near.groupBy(*target, _part(F.col("v"), F.col("low"), F.col("high")).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy(*target).orderBy("part"))  # over at most RANGES rows
    hit = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return hit.select(*keys, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high")


def distribution_by_key(df: DataFrame, key: str, cols: list[str], q: float = 0.5) -> DataFrame:
    """Per key and measure: mean, sample standard deviation and the exact linear-interpolated
    ``q`` quantile. Nulls and values that aren't finite don't count."""
    ensure_checkpoint_dir(df.sparkSession)
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v"))
                                              for c in cols])).alias("m")).select(key, "m.metric", "m.v")
    long = long.where(F.abs("v") < float("inf")).persist(StorageLevel.MEMORY_AND_DISK)
    keys = [key, "metric"]
    try:
        groups = long.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("low"), F.max("v").alias("high")).withColumn("at", F.lit(q) * (F.col("n") - 1)).checkpoint()
        ranks = F.array(F.struct(F.lit(0).alias("which"), F.floor("at").alias("rank")),
                        F.struct(F.lit(1).alias("which"), F.ceil("at").alias("rank")))
        targets, found = groups.select(*keys, F.inline(ranks), "low", "high"), None
        while True:
            done = targets.where("low = high").select(*keys, "which", F.col("low").alias("v"))
            found = done if found is None else found.unionByName(done)
            targets = targets.where("low < high")
            if targets.isEmpty():
                break
            targets = _refined(long, targets, keys).checkpoint()
        pair = found.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("v"))).alias("a"),
                                        F.max(F.when(F.col("which") == 1, F.col("v"))).alias("b"))
        out = groups.withColumnRenamed(key, "_key").withColumnRenamed("metric", "_metric").join(
            pair, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_metric") == F.col("metric")))
        frac = F.col("at") - F.floor("at")
        return out.select(key, "metric", "mean", "std", (F.col("a") + (F.col("b") - F.col("a")) * frac).alias("quantile")).checkpoint()
    finally:
        long.unpersist()


def exact_quantile(df: DataFrame, key: str, col: str, q: float, out: str) -> DataFrame:
    """Exact linear-interpolated quantile of one measure per key."""
    return distribution_by_key(df, key, [col], q).select(key, F.col("quantile").alias(out))

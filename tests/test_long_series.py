"""Windows over cut series equal the plain windows, wherever the series is cut."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapulse.operators import long_series, panels

SCHEMA = "s string, t long, id long, v long, g long"


def series(n=400, seed=3):
    """One key with most rows, small keys and a null key; gaps, equal orders, nulls."""
    rng = random.Random(seed)
    rows = [("hot", i // 2, i, rng.choice([None, rng.randrange(50), rng.randrange(50)]), rng.choice([None, None, i])) for i in range(n)]
    rows += [("one", 5, 0, 3, None), (None, 1, 0, 4, None), (None, 2, 1, 3, 9), ("gap", 1, 0, None, None), ("gap", 2, 1, None, None)]
    rows += [(f"k{k}", i, i, rng.randrange(9), None) for k in range(12) for i in range(7)]
    rng.shuffle(rows)
    return rows


def plain(df):
    w = Window.partitionBy("s").orderBy("t", "id")
    df = df.select("*", (F.col("v") - F.lag("v").over(w)).alias("change"),
                   F.avg("v").over(w.rowsBetween(-2, 0)).alias("mean_3"), F.avg("v").over(w.rowsBetween(-4, 0)).alias("mean_5"),
                   F.lead("v").over(w).alias("next_1"), F.lead("v", 5).over(w).alias("next_5"), F.row_number().over(w).alias("n"))
    df = df.withColumn("is_loss", F.coalesce((F.col("change") < 0).cast("int"), F.lit(0)))
    df = df.select("*", panels.running_total("change", "s", "n").alias("total_change"), panels.forward_fill("g", "s", "n").alias("filled"))
    return panels.with_loss_streak(df, "change", "s", "n", "flag", "loss_streak").drop("flag", "n")


def as_set(df, cols):
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


@pytest.mark.parametrize("rows,ranges", [(5, 9), (7, 3), (40, 16), (10_000, 2)])
def test_equal_to_the_plain_windows(spark, rows, ranges):
    df = spark.createDataFrame(series(), SCHEMA)
    got = long_series.measure_history(df, "s", ["t", "id"], "v", "g", rows, ranges)
    cols = got.columns
    assert cols[:5] == df.columns
    assert as_set(got, cols) == as_set(plain(df), cols)


def test_series_is_cut_into_many_tasks(spark):
    """One key of 4,000 rows: at least 8 ranges, positions without gaps, small blocks."""
    df = spark.range(4_000).select(F.lit("k").alias("s"), (F.lit(4_000) - F.col("id")).alias("t"))
    placed = long_series.positions(df, "s", ["t"], ranges=10)
    got = placed.select("t", "_pos").collect()
    assert sorted(r._pos for r in got) == list(range(4_000)) and all(r._pos == r.t - 1 for r in got)
    ranged = df.repartitionByRange(10, "s", "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) >= 8 and max(r["count"] for r in ranged) < 1_000


def test_equal_orders_and_repeated_rows(spark):
    """Equal orders are placed by content, whatever the layout of the rows."""
    data = [("a", 1, n % 3, n % 2, None) for n in range(60)]
    want = None
    for seed in (1, 2):
        random.Random(seed).shuffle(data)
        got = long_series.scanned(spark.createDataFrame(data, SCHEMA).repartition(seed + 2), "s", ["t"],
                                  long_series.Scan(frames={"d": long_series.difference("v")}, sums={"total": "v"}), 8, 4, "pos")
        got = sorted((r.pos, r.id, r.v, r.d, r.total) for r in got.collect())
        assert [r[0] for r in got] == list(range(60)) and got[-1][-1] == sum(x[3] for x in data)
        assert want is None or got == want
        want = got


def test_streaks_and_fills_over_many_blocks(spark):
    """A run and a gap that span several whole blocks."""
    data = [("a", n, n, 1000 - n, 7 if n == 2 else None) for n in range(100)]
    got = long_series.measure_history(spark.createDataFrame(data, SCHEMA), "s", ["t"], "v", "g", 6, 8).orderBy("t").collect()
    assert [r.loss_streak for r in got] == list(range(100))
    assert [r.filled for r in got] == [None, None] + [7] * 98
    assert [r.total_change for r in got] == [None] + [-n for n in range(1, 100)]


def test_empty_and_too_small_blocks(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert long_series.measure_history(df, "s", ["t"], "v", "g").count() == 0
    with pytest.raises(ValueError):
        long_series.measure_history(df, "s", ["t"], "v", "g", rows=3)

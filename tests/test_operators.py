"""Operator invariants: windows, matching, top-k, interpolation, splits, quantiles."""

import pytest
from pyspark.sql import functions as F

from terrapulse import dims
from terrapulse.operators import matching, panels, stats, topk


def test_loss_streak_resets(spark):
    df = spark.createDataFrame([("a", y, c) for y, c in enumerate([None, -1.0, -2.0, 3.0, -1.0, -1.0, -1.0])],
                               "s string, y int, c double")
    out = panels.with_loss_streak(df, "c", "s", "y").orderBy("y").select("streak_count").collect()
    assert [r[0] for r in out] == [0, 1, 2, 0, 1, 2, 3]


def test_running_total_null_stays_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, 2.0)], "s string, y int, c double")
    got = [r[0] for r in df.select(panels.running_total("c", "s", "y")).orderBy(F.lit(1)).collect()]
    assert sorted(got, key=lambda v: (v is None, v)) == [1.0, 3.0, None, None]


def test_forward_fill_and_rolling(spark):
    df = spark.createDataFrame([("c", 1, 1.0), ("c", 2, None), ("c", 3, 4.0)], "k string, y int, v double")
    r = df.select("y", panels.forward_fill("v", "k", "y").alias("f"), panels.rolling_mean("v", "k", "y", 3).alias("m")
                  ).orderBy("y").collect()
    assert [x.f for x in r] == [1.0, 1.0, 4.0]
    assert [x.m for x in r] == [1.0, 1.0, 2.5]


def test_interpolation_hits_anchors_and_clamps(spark):
    years = spark.createDataFrame([(y,) for y in (1950, 1961, 1966, 2011, 2021, 2030)], "year int")
    out = {r.year: r.u for r in panels.interpolate_anchors(years, "year", dims.URB_ANCHORS, "u").collect()}
    assert out[1961] == 17.97 and out[2011] == 31.16 and out[2021] == 35.39
    assert out[1950] == 17.97 and out[2030] == 35.39
    assert out[1966] == pytest.approx(17.97 + 0.5 * (19.91 - 17.97))


def test_latest_non_null_per_column(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 10.0), ("a", 2, None, 20.0), ("a", 3, None, None)],
                               "s string, y int, u double, v double")
    r = panels.latest_non_null(df, "s", "y").first()
    assert (r.y, r.u, r.v) == (3, 1.0, 20.0)


def test_state_match_cascade(spark):
    df = spark.createDataFrame([("kerala",), ("Tamil",), ("odisha coast",), ("Keralla",), ("Zzzz",), ("",)], "n string")
    got = [tuple(r) for r in matching.with_state_match(df, "n").collect()]
    assert got[0][1:] == ("Kerala", "exact")
    assert got[1][1:] == ("Tamil Nadu", "substring")
    assert got[2][1:] == ("Orissa", "alias")
    assert got[3][1:] == ("Kerala", "fuzzy")
    assert got[4][1:] == (dims.FOREST_STATES[0], "fallback")
    assert got[5][1:] == (dims.FOREST_STATES[0], "fallback")


def test_rate_lookup_first_hit(spark):
    df = spark.createDataFrame([("Navi Mumbai",), ("",), ("Nowhere",)], "c string")
    got = [r[0] for r in df.select(matching.rate_lookup("c", dims.CITY_URB_RATES)).collect()]
    assert got == [93.5, None, None]


def test_boosted_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([([0.125] * 8, "Odisha", "Monsoon", 90.0, 20.0, 5.0)],
                               "p array<double>, st string, se string, pa double, wa double, ta double")
    adj = topk.boost_event_probs("p", "st", "se", "pa", "wa", "ta")
    r = df.select(adj.alias("a"), topk.top_k(adj, dims.EVENT_CLASSES, 3).alias("t")).first()
    assert sum(r.a) == pytest.approx(1.0)
    assert [x.label for x in r.t] == ["Cyclone", "Flood", "Thunderstorm"]


def test_exact_quantile_matches_definition(spark):
    vals = [1.0, 2.0, 2.0, 7.0, 10.0]
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v double")
    r = stats.exact_quantile(df, "k", "v", 0.5, "m").first()
    assert r.m == 2.0
    r = stats.exact_quantile(df, "k", "v", 0.3, "m").first()
    assert r.m == pytest.approx(2.0)
    r = stats.exact_quantile(df, "k", "v", 0.9, "m").first()
    assert r.m == pytest.approx(7.0 + 0.6 * 3.0)


def test_stratified_split_exact_counts(spark):
    from terrapulse.ml.split import stratified_split
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 3).alias("c"))
    s = stratified_split(df, "c", ["id"], partitions=7)
    counts = {(r.c, r.is_test): r["count"] for r in s.groupBy("c", "is_test").count().collect()}
    for c, n in ((0, 335), (1, 334), (2, 334)):
        assert counts[(c, True)] == round(0.2 * n)
        assert counts[(c, True)] + counts[(c, False)] == n
    again = {r.id for r in stratified_split(df, "c", ["id"], partitions=3).where("is_test").select("id").collect()}
    assert again == {r.id for r in s.where("is_test").select("id").collect()}


def test_top_n_matches_window_with_hot_key(spark):
    from pyspark.sql import Window
    # key 0 holds most rows (a hot key); ties on ts are broken by id
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 13).alias("k"),
                                  (F.col("id") % 97).alias("ts"), F.col("id")).repartition(6)
    got = panels.top_n_per_key(df, "k", [("ts", True), ("id", True)], 4)
    w = Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = df.withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    assert sorted(map(tuple, got.select("k", "id", "rank").collect())) == \
        sorted(map(tuple, want.select("k", "id", "rank").collect()))


def test_histogram_moments_match_spark(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7) % 50).cast("double").alias("v"))
    d = {r.k: r for r in stats.distribution_by_key(df, "k", ["v"], 0.5).collect()}
    ref = {r.k: r for r in df.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"),
                                               F.percentile("v", 0.5).alias("q")).collect()}
    for k in ref:
        assert d[k]["mean"] == pytest.approx(ref[k].m)
        assert d[k]["std"] == pytest.approx(ref[k].s)
        assert d[k]["quantile"] == pytest.approx(ref[k].q)

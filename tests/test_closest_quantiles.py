"""Closest names by common blocks, exact quantiles by counting, and streams in any order."""

import difflib
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapulse import dims
from terrapulse.operators import closest, matching, quantiles
from terrapulse.sources import bindings
from terrapulse.sources.tables import table
from terrapulse.streaming import jobs


def typos(n=1000):
    rng = random.Random(11)
    for _ in range(n):
        name = list(rng.choice(dims.FOREST_STATES))
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(name) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                name.insert(at, rng.choice(string.ascii_letters + " "))
            elif kind == 1 and name:
                del name[min(at, len(name) - 1)]
            elif kind == 2 and name:
                name[min(at, len(name) - 1)] = rng.choice(string.ascii_letters)
            elif len(name) > 1:
                at = min(at, len(name) - 2)
                name[at], name[at + 1] = name[at + 1], name[at]
        yield "".join(name)


def test_closest_is_the_block_matcher(spark, small_dir):
    names = [*typos(), "", "Zq17", "x" * 500, *[r.aoi_name for r in bindings.aoi(spark, small_dir).collect()]]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(-1, None)], "i int, n string").repartition(7)
    got = {r.i: r.m for r in df.select("i", closest.closest_known(F.col("n"), dims.FOREST_STATES).alias("m")).collect()}
    want = {i: (difflib.get_close_matches(n, dims.FOREST_STATES, 1, 0.4) or [None])[0] for i, n in enumerate(names)}
    assert got == {**want, -1: None} and sum(v is not None for v in want.values()) > 900


def test_cascade_uses_it(spark):
    df = spark.createDataFrame([("Karela",), ("Telengena",), ("Maharshtra",), (None,), ("  ",)], "n string")
    got = [(r.matched_state, r.match_method) for r in matching.with_state_match(df, "n").collect()]
    first = dims.FOREST_STATES[0]
    near = lambda n: (difflib.get_close_matches(n, dims.FOREST_STATES, 1, 0.4) or [None])[0]
    assert got[0] == (near("Karela"), "fuzzy") and got[2] == (near("Maharshtra"), "fuzzy")
    assert got[3] == (first, "fallback") and got[4] == (first, "fallback")


@pytest.mark.parametrize("q", [0.9])
def test_quantiles_by_counting_are_exact(spark, q):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(5, 2, 3001), "few": rng.integers(0, 5, 1000).astype(float), "one": np.array([7.25]),
              "spread": 10.0 ** rng.uniform(-30, 30, 500) * rng.choice([-1, 1], 500), "same": np.full(50, -0.5),
              "near": 1 + rng.integers(0, 9, 400) * 2.0 ** -52, "tiny": rng.integers(0, 4, 99) * 5e-324,
              "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0])}
    rows = [(k, float(x), 2 * float(x) if abs(x) < 1e300 else None) for k, v in groups.items() for x in v]
    rows += [("normal", None, None), ("few", float("nan"), None), (None, 3.0, 1.0), (None, 4.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(6)
    got = {(r.k, r.metric): r for r in quantiles.distribution_by_key(df, "k", ["a", "b"], q).collect()}

    def linear(v):
        v, at = np.sort(v), q * (len(v) - 1)
        lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
        return lo + (hi - lo) * (at - np.floor(at))

    with np.errstate(over="ignore"):
        for k, v in groups.items():
            assert got[k, "a"].quantile == linear(v), k
            assert k in ("spread", "wide") or got[k, "a"].mean == pytest.approx(v.mean(), rel=1e-12, abs=1e-300)
    assert got[None, "a"].quantile == 3.0 + q and got[None, "b"].quantile == 1.0
    assert quantiles.distribution_by_key(df.where("false"), "k", ["a"], q).count() == 0


def test_streams_take_readings_in_any_order(spark, small_dir):
    """Files in no order of time, a few a batch: every reading counts, those of complete windows as late."""
    ev = table(spark, small_dir, "events")
    n = ev.count()
    path = jobs.landing_folder(spark, small_dir, files=20)
    stream = lambda: jobs.readings(jobs.event_stream(spark, path, ev.schema, 3))
    weekly = jobs.weekly_windows(stream()).persist()
    assert weekly.agg(F.sum("n_readings")).first()[0] == n and 0 < weekly.agg(F.sum("n_late")).first()[0] < n
    once = jobs.weekly_windows(jobs.readings(jobs.event_stream(spark, path, ev.schema, 1000))).persist()
    assert once.agg(F.sum("n_late")).first()[0] == 0
    plain = lambda df: sorted(map(tuple, df.drop("n_late").collect()))
    assert plain(weekly) == plain(once)
    assert jobs.vegetation_windows(stream()).agg(F.sum("n_readings")).first()[0] == 16 * n
    weekly.unpersist()
    once.unpersist()


def test_window_batch_run_again_counts_nothing_twice(spark, tmp_path):
    measures = {"v": (F.col("v"), 1)}
    write = jobs.window_writer(str(tmp_path), F.window("ts", "1 day"), measures, ["k"], "1 hour")
    day = lambda *hours: spark.createDataFrame([("a", f"2024-01-0{1 + h // 24} {h % 24:02d}:30:00", 1.5) for h in hours],
                                               "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    for batch_id, batch in ((0, day(1, 50)), (1, day(2, 51)), (1, day(2, 51)), (0, day(1, 50)), (2, day(3, 4).where("false"))):
        write(batch, batch_id)
    got = {r.w.start.day: tuple(r)[2:] for r in jobs.merged_windows(spark, str(tmp_path), measures, ["k"]).collect()}
    assert {k: (float(v[0]), *v[1:]) for k, v in got.items()} == {1: (3.0, 2, 2, 1), 3: (3.0, 2, 2, 0)}


def test_sliding_windows_are_logged_by_steps(spark, tmp_path):
    """A reading is one row of the log, not one a window, and the windows are those of one pass over all readings."""
    rows = [(k, f"2024-01-{1 + (7 * i) % 20:02d} {i % 24:02d}:30:00", None if i % 9 == 0 else i / 2) for i in range(60) for k in ("a", None)]
    df = spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    measures = {"v": (F.col("v"), 1)}
    write = jobs.window_writer(str(tmp_path), F.window("ts", "1 day"), measures, ["k"], "1 day")
    parts = [df.where(F.pmod(F.dayofmonth("ts"), F.lit(3)) == i) for i in (2, 0, 1)]
    for i, part in enumerate(parts):
        write(part, i)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 40
    got = jobs.merged_windows(spark, str(tmp_path), measures, ["k"], steps=4)
    want = df.groupBy("k", F.window("ts", "4 days", "1 day").alias("w")).agg(*jobs._parts(measures))
    plain = lambda d: sorted(((r.k or "", r.w.start, r.w.end, r.v_sum, r.v_n, r.n_readings) for r in d.collect()), key=str)
    assert plain(got) == plain(want)
    late, upto = 0, None
    for part in parts:
        if upto is not None:
            late += part.select(F.window("ts", "4 days", "1 day").alias("w")).where(F.col("w.end") <= F.lit(upto) - F.expr("INTERVAL 1 DAY")).count()
        last = part.agg(F.max("ts")).first()[0]
        upto = last if upto is None else max(upto, last)
    assert late > 0 and got.agg(F.sum("n_late")).first()[0] == late


def test_first_writer_emits_a_key_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, event_id int, ts timestamp_ntz, day date")
    import datetime as dt
    at = lambda h: dt.datetime(2024, 1, 1, h)
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    a = rows(("a", 1, at(5), d1), ("a", 2, at(4), d1), ("b", 3, at(1), d2))
    write = jobs.first_writer(str(tmp_path), ["k", "day"], "day", a.schema)
    b = rows(("a", 4, at(1), d1), ("a", 5, at(1), d2), (None, 6, at(1), d1))
    for batch_id, batch in ((0, a), (1, b), (1, b), (2, rows((None, 7, at(0), d1), ("b", 8, at(0), d2)))):
        write(batch, batch_id)
    out = spark.read.schema(a.schema).option("basePath", str(tmp_path)).parquet(f"{tmp_path}/batch=*")
    assert sorted(r.event_id for r in out.collect()) == [2, 3, 5, 6]

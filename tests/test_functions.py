"""Hand-computed rows for the formulas, including every threshold edge and nulls."""

import math

import pytest
from pyspark.sql import functions as F

from terrapulse.functions import alerts as fa
from terrapulse.functions import climate as fc
from terrapulse.functions import forest as ff
from terrapulse.functions import text as ft
from terrapulse.functions import urban as fu


def one(spark, col, schema="x double", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(col).collect()]


def test_crop_and_weather_seasons(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = {r.m: (r.s, r.c, r.w, r.q) for r in df.select(
        "m", fc.crop_season("m").alias("s"), fc.crop_season("m", True).alias("c"),
        fc.weather_season("m").alias("w"), fc.season_code("m").alias("q")).collect()}
    assert got[3] == ("Summer", "Rabi", "Summer", 1)
    assert got[12] == ("Rabi", "Rabi", "Winter", 0)
    assert got[7] == ("Kharif", "Kharif", "Monsoon", 2)
    assert got[10] == ("Kharif", "Kharif", "Post-Monsoon", 3)
    assert got[11][2] == "Post-Monsoon" and got[9][3] == 3


def test_month_decode_shift(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    e = fc.cyclic_encode(F.lit(0.0), F.lit(0.0), "m", digits=None)
    rows = df.select("m", fc.decode_month(e["month_sin"], e["month_cos"], 1).alias("train"),
                     fc.decode_month(e["month_sin"], e["month_cos"], 0).alias("inv")).collect()
    for r in rows:
        assert r.train == r.m % 12 + 1          # the training decode is shifted
        assert r.inv == r.m                      # the inverse option round-trips


def test_spei_matches_hand_value(spark):
    # precip 10 mm, 30 C, 50 % humidity
    t = 30.0
    heat = max((t / 5) ** 1.514, 0.001)
    alpha = 0.492 + 0.0179 * heat - 7.71e-5 * heat ** 2 + 6.75e-7 * heat ** 3
    pet = 16 * (10 * t / (heat * 12)) ** alpha * (1 - 50 / 200)
    want = max(min((10 - pet) / (pet + 50 + 1e-6), 3.5), -3.5)
    got = spark.range(1).select(fc.estimate_spei(F.lit(10.0), F.lit(30.0), F.lit(50.0))).first()[0]
    assert got == pytest.approx(want, rel=1e-12)
    zero_t = spark.range(1).select(fc.estimate_spei(F.lit(10.0), F.lit(-3.0), F.lit(50.0))).first()[0]
    assert zero_t == pytest.approx(10 / (50 + 1e-6))
    assert spark.range(1).select(fc.estimate_spei(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_wind_bin_ties_to_even(spark):
    rows = spark.createDataFrame([(0.75,), (1.25,), (1.3,)], "ms double").select(fc.wind_bin("ms")).collect()
    assert [r[0] for r in rows] == [1.0, 1.0, 1.5]


@pytest.mark.parametrize("spei,cat", [(-2.0, "Extremely Dry"), (-1.5, "Severely Dry"), (-1.0, "Moderately Dry"),
                                      (0.99, "Near Normal"), (1.0, "Moderately Wet"), (1.5, "Severely Wet"),
                                      (2.0, "Extremely Wet")])
def test_drought_category_edges(spark, spei, cat):
    assert spark.range(1).select(fa.drought_category(F.lit(spei))).first()[0] == cat


def test_drought_alert_and_severity(spark):
    r = spark.range(1).select(fa.drought_alert(F.lit("Severely Dry"), F.lit(True)),
                              fa.drought_alert(F.lit("Moderately Dry"), F.lit(True)),
                              fa.drought_alert(F.lit("Extremely Dry"), F.lit(False)),
                              fa.drought_severity(F.lit("Extremely Wet")), fa.drought_severity(F.lit("x"))).first()
    assert tuple(r) == ("RED", "YELLOW", "GREEN", "ELEVATED", "UNKNOWN")


def test_alert_points_edges_and_nulls(spark):
    df = spark.createDataFrame([(0.15, 37.0, 35.0, 50.0), (0.149, 45.01, 80.1, 80.01), (None, None, None, None),
                                (0.29, 40.5, 55.5, 51.0)], "n double, t double, w double, p double")
    got = [tuple(r) for r in df.select(fa.alert_points("n", "t", "w", "p").alias("x"),
                                       fa.level_from_points(fa.alert_points("n", "t", "w", "p"))).collect()]
    assert got == [(1, "GREEN"), (11, "RED"), (0, "GREEN"), (6, "RED")]


def test_four_level_variant(spark):
    df = spark.createDataFrame([(None, 4.0, None, None)], "n double, t double, w double, p double")
    r = df.select(fa.alert_points("n", "t", "w", "p", cold_points=True).alias("x")).first()[0]
    assert r == 2
    lv = spark.createDataFrame([(2,), (4,), (6,), (1,)], "x int").select(fa.level4_from_points("x")).collect()
    assert [x[0] for x in lv] == ["yellow", "orange", "red", "green"]


def test_indices_zero_ndvi_is_missing(spark):
    r = spark.range(1).select(*[v.alias(k) for k, v in fa.indices(F.lit(300.0), F.lit(0.0), F.lit(30.0),
                                                                  F.lit(10.0)).items()]).first()
    assert r.ndwi == 1.0                       # clipped
    assert r.ndbi == pytest.approx(0.1)        # 0 -> default 0.3
    assert r.nbr == pytest.approx(0.0)         # 0 -> default 0.4
    assert r.risk_level == pytest.approx(2 / 11)


def test_clip_keeps_null(spark):
    got = spark.createDataFrame([(None,), (500.0,), (-1.0,)], "x double").select(fa.clip("x", 0.0, 300.0)).collect()
    assert [g[0] for g in got] == [None, 300.0, 0.0]


@pytest.mark.parametrize("chg,pct,lvl", [(None, None, 0), (0.0, -5.0, 0), (-499.0, -0.9, 1), (-499.0, -1.0, 2),
                                         (-500.0, -0.5, 2), (-1999.0, -2.9, 2), (-2000.0, -1.0, 3), (-100.0, None, 3)])
def test_deforestation_level(spark, chg, pct, lvl):
    df = spark.createDataFrame([(chg, pct)], "c double, p double")
    assert df.select(ff.deforestation_level("c", "p")).first()[0] == lvl


def test_impacts(spark):
    df = spark.createDataFrame([(None, 0.5, 2.0, 40.0, None)], "pc double, n double, cr double, fp double, ch double")
    r = df.select(ff.aqi_impact("pc", "n", "cr"), ff.human_impact("fp", "n", "cr", "ch")).first()
    assert r[0] == pytest.approx(0.5 * 40 + 2 * 5)
    assert r[1] == pytest.approx(0.6 * 40 + 0.5 * 30 + 6)


def test_ensemble_ignores_failed_domains(spark):
    r = spark.range(1).select(
        fa.ensemble_level(F.lit("GREEN"), F.lit("YELLOW"), F.lit("YELLOW"), F.lit(1), F.lit(79.0)),
        fa.ensemble_level(F.lit("GREEN"), F.lit(None).cast("string"), F.lit(None).cast("string"),
                          F.lit(None).cast("int"), F.lit(None).cast("double")),
        fa.ensemble_level(F.lit("GREEN"), None, None, F.lit(2), None)).first()
    assert tuple(r) == ("YELLOW", "GREEN", "RED")


def test_demographic_extrapolation(spark):
    ex = fu.extrapolate_demographics(F.lit(2031))
    r = spark.range(1).select(*[v.alias(k) for k, v in ex.items()]).first()
    assert r.pop_m == pytest.approx(1393.41 * 1.0097 ** 10)
    assert r.urb_rate == pytest.approx(min(55, 35.39 + 4.0))
    assert r.birth_rate == pytest.approx(max(12, 17.4 - 2.0))
    assert r.world_growth == pytest.approx(max(0.9, 0.94 - 0.1))
    back = spark.range(1).select(*[v.alias(k) for k, v in fu.extrapolate_demographics(F.lit(2019)).items()]).first()
    assert back.pop_m == 1393.41 and back.world_growth == pytest.approx(0.96)


def test_infrastructure_needs_truncate(spark):
    r = spark.range(1).select(fu.infrastructure_needs(F.lit(81.0), F.lit(10.0), F.lit(10.00123), F.lit(30.0),
                                                      F.lit(31.0)).alias("n")).first().n
    assert r.pressure_level == "CRITICAL" and r.new_hospitals == 1 and r.new_schools == 24


def test_intents_and_location_and_year(spark):
    df = spark.createDataFrame([("Will it rain in pune during the 1987 monsoon?",), ("Forest cover of Kerala",),
                                ("nothing here",), ("Éxyz Abc Delhi 2031 1949",)], "t string")
    got = df.select(F.array_join(ft.intents("t"), ","), ft.extract_location("t"), ft.extract_year("t")).collect()
    assert tuple(got[0]) == ("weather", "Pune", 1987)
    assert tuple(got[1]) == ("forest", "Kerala", 2017)
    assert tuple(got[2]) == ("unknown", None, 2017)
    assert got[3][1] == "Delhi" and got[3][2] == 2017


def test_coordinate_parse(spark):
    df = spark.createDataFrame([("18.5,73.8",), ("Pune",), ("18.5,abc",)], "t string")
    p = ft.parse_coordinates("t")
    got = [tuple(r) for r in df.select(p["lat"], p["lon"], p["place"]).collect()]
    assert got == [(18.5, 73.8, None), (None, None, "Pune"), (None, None, "18.5,abc")]


def test_card_status(spark):
    df = spark.createDataFrame([(None,), ("N/A",), ("High wind",), ("moderate",), ("calm",)], "v string")
    assert [r[0] for r in df.select(fa.card_status("v")).collect()] == ["No Data", "No Data", "Warning", "Monitor",
                                                                        "Normal"]


def test_nan_free(spark):
    assert not math.isnan(spark.range(1).select(fa.ndvi_proxy_a(F.lit(None), F.lit(None))).first()[0])

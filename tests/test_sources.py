"""Payload parsers on hand-written payloads and file sources."""

import json

from pyspark.sql import functions as F

from terrapulse.sources import payloads


def test_weather_payload_pairs_by_day_and_defaults(spark):
    doc = {"current_weather": {"temperature": 31.2, "windspeed": 14.3, "weathercode": 1},
           "daily": {"precipitation_sum": [12.0, None, 33.0], "temperature_2m_max": [34.0, 33.0, None],
                     "temperature_2m_min": [None, 25.0, 24.0], "windspeed_10m_max": [10.0, 20.0, None],
                     "shortwave_radiation_sum": [], "sunshine_duration": [3600.0, 7200.0]},
           "hourly": {"relativehumidity_2m": [60.0, None, 64.0]}}
    df = spark.createDataFrame([(json.dumps(doc),), (None,)], "p string")
    rows = df.select(payloads.weather_environment("p").alias("e")).collect()
    a, c = rows[0].e.aggregate, rows[0].e.current
    assert a.avg_temp == (33.0 + 25.0) / 2          # only day 2 has both
    assert a.max_temp == 33.5 and a.min_temp == 24.5
    assert a.precip_week == 45.0 and a.precip_day == 12.0
    assert a.humidity == 62.0 and a.solar == 18.0 and a.sunshine_hours == 1.5
    assert a.rainfall_annualized == 45.0 * 365 / 7
    assert c.temperature == 31.2 and c.precipitation == 12.0
    empty = rows[1].e
    assert empty.current.temperature == 28.0 and empty.current.windspeed == 12.0
    assert empty.aggregate.humidity == 55.0 and empty.aggregate.precip_week == 0.0


def test_soil_elevation_geocode_address_land(spark):
    soil = {"properties": {"layers": [{"name": "phh2o", "depths": [{"values": {"mean": 65}}]},
                                      {"name": "soc", "depths": [{"values": {"mean": None}}]}]}}
    df = spark.createDataFrame([(json.dumps(soil), '{"results":[{"elevation":null}]}', '{"results":[]}',
                                 '{"address":{"state_district":"Pune","county":"Haveli"}}')],
                               "s string, e string, g string, a string")
    r = df.select(payloads.soil_properties("s").alias("soil"), payloads.elevation("e").alias("el"),
                  payloads.geocode("g").alias("geo"), payloads.reverse_address("a").alias("ad"),
                  payloads.is_land("s").alias("land"), payloads.is_land(F.lit(None).cast("string")).alias("nl")).first()
    assert (r.soil.ph, r.soil.organic_carbon, r.soil.soil_moisture) == (6.5, 0.8, 38.0)
    assert r.el == 350.0 and r.geo.lat is None
    assert r.ad.state == "Pune" and r.ad.city == "Haveli" and r.ad.area is None
    assert r.land is True and r.nl is True


def test_indicator_and_climate(spark):
    ind = json.dumps([{"page": 1}, [{"value": None, "date": "2023"}, {"value": 17.1, "date": "2022"}]])
    clim = json.dumps({"properties": {"parameter": {"ALLSKY_SFC_SW_DWN": {"20240101": 4.0, "20240102": -999.0},
                                                    "PRECTOTCORR": {"20240101": -999.0}}}})
    df = spark.createDataFrame([(ind, clim)], "i string, c string")
    r = df.select(payloads.indicator_value("i").alias("v"), payloads.climate_means("c").alias("m")).first()
    assert (r.v.value, r.v.date) == (17.1, "2022")
    assert r.m.mean_radiation == 4.0 and r.m.mean_precip is None


def test_enso_text(spark):
    lines = spark.createDataFrame([(1, "YEAR  MEI"), (2, "2023 0.1 0.2 -999.00"), (3, "2024 -0.567 -999.00")],
                                  "line_no int, value string")
    assert payloads.enso_index(lines).first()[0] == -0.57
    none = spark.createDataFrame([(1, "header only")], "line_no int, value string")
    assert payloads.enso_index(none).first()[0] == 0.0


def test_enso_last_line_without_values(spark):
    lines = spark.createDataFrame([(1, "2023 0.5 0.7"), (2, "2024 -999.00 -999.00")], "line_no int, value string")
    assert payloads.enso_index(lines).first()[0] == 0.7
    wide = spark.createDataFrame([(1, "2023 " + " ".join(["0.1"] * 150 + ["0.9"]))], "line_no int, value string")
    assert payloads.enso_index(wide).first()[0] == 0.9

"""Weather, drought and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as fa
from ..functions import climate as fc
from ..operators import stats
from ..sources import bindings
from . import oracle_views as ov
from .catalog import query

WEEKLY_SQL = """
weekly AS (
  SELECT location_id, lat, lon, CAST(date_trunc('week', ts) AS DATE) AS week,
    CAST(SUM(CAST(CASE WHEN temp_max IS NOT NULL AND temp_min IS NOT NULL THEN (temp_max + temp_min) / 2.0 END AS DECIMAL(20,3))) AS DOUBLE)
      / CAST(COUNT(CASE WHEN temp_max IS NOT NULL AND temp_min IS NOT NULL THEN (temp_max + temp_min) / 2.0 END) AS DOUBLE) AS avg_temp,
    CAST(SUM(CAST(CASE WHEN temp_max IS NOT NULL AND temp_min IS NOT NULL THEN temp_max END AS DECIMAL(20,2))) AS DOUBLE)
      / CAST(COUNT(CASE WHEN temp_max IS NOT NULL AND temp_min IS NOT NULL THEN temp_max END) AS DOUBLE) AS max_temp,
    CAST(SUM(CAST(CASE WHEN temp_max IS NOT NULL AND temp_min IS NOT NULL THEN temp_min END AS DECIMAL(20,2))) AS DOUBLE)
      / CAST(COUNT(CASE WHEN temp_max IS NOT NULL AND temp_min IS NOT NULL THEN temp_min END) AS DOUBLE) AS min_temp,
    COALESCE(CAST(SUM(CAST(precip AS DECIMAL(20,2))) AS DOUBLE), 0.0) AS precip_week,
    COALESCE(arg_min(precip, {'t': ts, 'e': event_id}), 0.0) AS precip_day,
    CAST(SUM(CAST(wind_kmh AS DECIMAL(20,1))) AS DOUBLE) / CAST(COUNT(wind_kmh) AS DOUBLE) AS wind_kmh,
    COALESCE(CAST(SUM(CAST(humidity AS DECIMAL(20,0))) AS DOUBLE) / CAST(COUNT(humidity) AS DOUBLE), 55.0) AS humidity,
    COALESCE(CAST(SUM(CAST(solar AS DECIMAL(20,1))) AS DOUBLE) / CAST(COUNT(solar) AS DOUBLE), 18.0) AS solar,
    COALESCE(CAST(SUM(CAST(sunshine_s AS DECIMAL(20,1))) AS DOUBLE) / CAST(COUNT(sunshine_s) AS DOUBLE) / 3600.0, 7.0) AS sunshine_hours,
    COUNT(*) AS n_readings
  FROM obs GROUP BY location_id, lat, lon, CAST(date_trunc('week', ts) AS DATE)),
weekly_weather AS (
  SELECT *, wind_kmh / 3.6 AS wind_ms, round_even(wind_kmh / 3.6 / 0.5, 0) * 0.5 AS wind_bin,
         precip_week * 365.0 / 7.0 AS rainfall_annualized
  FROM weekly)"""

WEEKLY_COLS = ["location_id", "week", "avg_temp", "max_temp", "min_temp", "precip_week", "precip_day",
               "wind_kmh", "humidity", "solar", "sunshine_hours", "n_readings", "wind_ms", "wind_bin",
               "rainfall_annualized"]


def weekly(spark, d):
    # lat/lon are functions of the location: grouping by them too is free
    return stats.weekly_weather(bindings.obs(spark, d), carry=("lat", "lon"))


@query("weekly_weather", "A1 A2 F10 P8",
       sql=ov.with_(ov.OBS, WEEKLY_SQL) + "SELECT " + ", ".join(WEEKLY_COLS) + " FROM weekly_weather")
def q_weekly_weather(spark, d):
    return weekly(spark, d).select(*WEEKLY_COLS)


DROUGHT_SQL = """
SELECT location_id, week, month(week) AS month,
  CAST(floor((month(week) % 12) / 3) AS INTEGER) AS season_code,
  sin(radians(lat)) AS lat_sin, cos(radians(lat)) AS lat_cos,
  degrees(atan2(sin(radians(lat)), cos(radians(lat)))) AS lat_decoded,
  CAST(((CAST(round_even(degrees(atan2(sin(radians(month(week) * 30)), cos(radians(month(week) * 30)))) / 30.0, 0) AS INTEGER) % 12) + 12) % 12 + 1 AS INTEGER) AS month_decoded,
  max_temp - min_temp AS temp_range,
  max_temp * (1.0 - humidity / 100.0) AS heat_stress,
  precip_week * humidity AS precip_humidity,
  solar / (precip_week + 1.0) AS aridity_index,
  wind_ms * max_temp AS wind_evap,
  spei, category,
  CASE category WHEN 'Extremely Dry' THEN 'CRITICAL' WHEN 'Severely Dry' THEN 'HIGH' WHEN 'Moderately Dry' THEN 'MODERATE'
       WHEN 'Near Normal' THEN 'NORMAL' WHEN 'Moderately Wet' THEN 'LOW'
       WHEN 'Severely Wet' THEN 'ELEVATED' WHEN 'Extremely Wet' THEN 'ELEVATED' ELSE 'UNKNOWN' END AS severity,
  CASE WHEN precip_week < 50 AND category IN ('Extremely Dry', 'Severely Dry') THEN 'RED'
       WHEN precip_week < 50 AND category = 'Moderately Dry' THEN 'YELLOW' ELSE 'GREEN' END AS drought_alert
FROM (
  SELECT *, CASE WHEN spei IS NULL THEN NULL WHEN spei <= -2.0 THEN 'Extremely Dry' WHEN spei <= -1.5 THEN 'Severely Dry'
            WHEN spei <= -1.0 THEN 'Moderately Dry' WHEN spei < 1.0 THEN 'Near Normal' WHEN spei < 1.5 THEN 'Moderately Wet'
            WHEN spei < 2.0 THEN 'Severely Wet' ELSE 'Extremely Wet' END AS category
  FROM (
    SELECT *, GREATEST(LEAST((precip_week - pet_adj) / (pet_adj + 50.0 + 1e-6), 3.5), -3.5) AS spei
    FROM (
      SELECT *, GREATEST(pet, 0.0) * (1.0 - humidity / 200.0) AS pet_adj
      FROM (
        SELECT *, CASE WHEN t > 0 THEN 16.0 * pow(10.0 * t / (heat * 12.0),
                         0.492 + 0.0179 * heat - 7.71e-5 * (heat * heat) + 6.75e-7 * (heat * heat * heat)) ELSE 0.0 END AS pet
        FROM (SELECT *, GREATEST(pow(t / 5.0, 1.514), 0.001) AS heat
              FROM (SELECT *, GREATEST(avg_temp, 0.0) AS t FROM weekly_weather))))))"""

DROUGHT_COLS = ["location_id", "week", "month", "season_code", "lat_sin", "lat_cos", "lat_decoded",
                "month_decoded", "temp_range", "heat_stress", "precip_humidity", "aridity_index", "wind_evap",
                "spei", "category", "severity", "drought_alert"]


@query("drought_indicators", "F5 F6 F7 F8 F9 F17 F18 F19",
       sql=ov.with_(ov.OBS, WEEKLY_SQL) + DROUGHT_SQL)
def q_drought_indicators(spark, d):
    w = weekly(spark, d).withColumn("month", F.month("week"))
    enc = fc.cyclic_encode("lat", "lon", "month", digits=None)
    feats = fc.drought_features("max_temp", "min_temp", "humidity", "precip_week", "solar", "wind_ms")
    df = w.select(
        "location_id", "week", "month", "precip_week",
        fc.season_code("month").alias("season_code"),
        enc["lat_sin"].alias("lat_sin"), enc["lat_cos"].alias("lat_cos"),
        fc.decode_angle(enc["lat_sin"], enc["lat_cos"]).alias("lat_decoded"),
        fc.decode_month(enc["month_sin"], enc["month_cos"], shift=1).alias("month_decoded"),
        *[v.alias(k) for k, v in feats.items()],
        fc.estimate_spei("precip_week", "avg_temp", "humidity").alias("spei"))
    df = df.withColumn("category", fa.drought_category("spei"))
    return df.select(*[c for c in DROUGHT_COLS if c not in ("severity", "drought_alert")],
                     fa.drought_severity("category").alias("severity"),
                     fa.drought_alert("category", F.col("precip_week") < 50).alias("drought_alert"))


ALERT_SQL = """
SELECT location_id, week, ndvi, points, level, points4, level4, ndwi, ndbi, nbr, risk_level, ndvi_band,
       concat_ws('|', CASE WHEN wind_kmh > 60 THEN 'High wind speed — potential cyclonic or severe gale risk.' END,
                      CASE WHEN max_temp > 42 THEN 'Heatwave threshold exceeded — health risk for vulnerable populations.' END,
                      CASE WHEN precip_day > 50 THEN 'Heavy precipitation — localised flooding possible.' END) AS risk_notes,
       CASE level4 WHEN 'green' THEN '🟢 Normal — no significant change detected.'
            WHEN 'yellow' THEN '🟡 Heads Up — early signs of change. Monitor regularly.'
            WHEN 'orange' THEN '🟠 Warning — notable environmental stress. Action recommended.'
            WHEN 'red' THEN '🔴 Critical — severe conditions. Immediate intervention needed.' END AS level_label
FROM (
  SELECT *, CASE WHEN points >= 6 THEN 'RED' WHEN points >= 3 THEN 'YELLOW' ELSE 'GREEN' END AS level,
         CASE WHEN points4 >= 6 THEN 'red' WHEN points4 >= 4 THEN 'orange' WHEN points4 >= 2 THEN 'yellow' ELSE 'green' END AS level4,
         CASE WHEN ndvi > 0.6 THEN 'Dense/healthy vegetation' WHEN ndvi > 0.3 THEN 'Moderate vegetation'
              WHEN ndvi > 0.1 THEN 'Sparse vegetation / stress' ELSE 'Bare soil or urban area' END AS ndvi_band
  FROM (
    SELECT *, CAST(pts_n + pts_t + pts_w + pts_p AS INTEGER) AS points,
           CAST(pts_n + pts_t + pts_w + pts_p + CASE WHEN min_temp < 5 THEN 2 ELSE 0 END AS INTEGER) AS points4,
           LEAST(GREATEST(precip_day / 200.0 - 0.3, -1.0), 1.0) AS ndwi,
           LEAST(GREATEST(0.4 - COALESCE(NULLIF(ndvi, 0.0), 0.3), -1.0), 1.0) AS ndbi,
           LEAST(GREATEST(COALESCE(NULLIF(ndvi, 0.0), 0.4) - avg_temp / 100.0 - wind_kmh / 100.0, -1.0), 1.0) AS nbr,
           ((CASE WHEN avg_temp > 45 THEN 3 WHEN avg_temp > 40 THEN 2 WHEN avg_temp > 37 THEN 1 ELSE 0 END) + pts_w + pts_p) / 11.0 AS risk_level
    FROM (
      SELECT *,
        CASE WHEN ndvi < 0.15 THEN 3 WHEN ndvi < 0.3 THEN 1 ELSE 0 END AS pts_n,
        CASE WHEN max_temp > 45 THEN 3 WHEN max_temp > 40 THEN 2 WHEN max_temp > 37 THEN 1 ELSE 0 END AS pts_t,
        CASE WHEN wind_kmh > 80 THEN 3 WHEN wind_kmh > 55 THEN 2 WHEN wind_kmh > 35 THEN 1 ELSE 0 END AS pts_w,
        CASE WHEN precip_day > 80 THEN 2 WHEN precip_day > 50 THEN 1 ELSE 0 END AS pts_p
      FROM (SELECT *, LEAST(GREATEST(COALESCE(precip_week / 7.0, 2.0) * 0.04 + COALESCE(solar, 4.0) * 0.005, 0.0), 1.0) AS ndvi
            FROM weekly_weather))))"""

ALERT_COLS = ["location_id", "week", "ndvi", "points", "level", "points4", "level4", "ndwi", "ndbi", "nbr",
              "risk_level", "ndvi_band", "risk_notes", "level_label"]


def alert_frame(spark, d):
    w = weekly(spark, d)
    w = w.withColumn("ndvi", fa.ndvi_proxy_a(F.col("precip_week") / F.lit(7.0), "solar"))
    idx = fa.indices("precip_day", "ndvi", "avg_temp", "wind_kmh")
    w = w.select("*", fa.alert_points("ndvi", "max_temp", "wind_kmh", "precip_day").alias("points"),
                 fa.alert_points("ndvi", "max_temp", "wind_kmh", "precip_day", cold_points=True)
                 .alias("_points4_t"),
                 *[v.alias(k) for k, v in idx.items()])
    # the four-level variant adds cold points on the minimum temperature
    w = w.withColumn("points4", (F.col("points") + F.when(F.col("min_temp") < 5, 2).otherwise(0)).cast("int"))
    return w.drop("_points4_t")


@query("alert_scoring", "F21 F22 F23 F24 F26 F49 F52",
       sql=ov.with_(ov.OBS, WEEKLY_SQL) + ALERT_SQL)
def q_alert_scoring(spark, d):
    w = alert_frame(spark, d)
    return w.select(
        "location_id", "week", "ndvi", "points", fa.level_from_points("points").alias("level"), "points4",
        fa.level4_from_points("points4").alias("level4"), "ndwi", "ndbi", "nbr", "risk_level",
        fa.ndvi_band("ndvi").alias("ndvi_band"),
        F.array_join(fa.risk_notes("wind_kmh", "max_temp", "precip_day"), "|").alias("risk_notes"),
        fa.level_label(fa.level4_from_points("points4")).alias("level_label"))


EVENT_SQL = """
SELECT event_id, month(event_date) AS month,
  CASE WHEN month(event_date) IN (12, 1, 2) THEN 'Winter' WHEN month(event_date) IN (3, 4, 5) THEN 'Summer'
       WHEN month(event_date) IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END AS season,
  precipitation_anomaly_mm * wind_anomaly_kmph AS precip_wind,
  temperature_anomaly_c * mei_index AS temp_mei,
  precipitation_anomaly_mm * temperature_anomaly_c AS precip_temp,
  wind_anomaly_kmph * 5.0 AS wind_duration,
  precipitation_anomaly_mm * precipitation_anomaly_mm AS precip_sq,
  wind_anomaly_kmph * wind_anomaly_kmph AS wind_sq,
  LEAST(GREATEST(intensity_scale, 1.0), 10.0) AS intensity,
  CASE WHEN LEAST(GREATEST(intensity_scale, 1.0), 10.0) >= 8 THEN 'RED'
       WHEN LEAST(GREATEST(intensity_scale, 1.0), 10.0) >= 4 THEN 'YELLOW' ELSE 'GREEN' END AS intensity_label,
  CASE WHEN intensity_scale <= 3 THEN 'Low' WHEN intensity_scale <= 6 THEN 'Moderate'
       WHEN intensity_scale <= 8 THEN 'High' ELSE 'Extreme' END AS intensity_word
FROM event_rows"""


@query("weather_event_features", "F2 F4 F11 F12 F20 F37", sql=ov.with_(ov.event_rows_sql()) + EVENT_SQL)
def q_weather_event_features(spark, d):
    e = bindings.event_rows(spark, d)
    inter = fc.interactions("precipitation_anomaly_mm", "temperature_anomaly_c", "wind_anomaly_kmph", "mei_index")
    intensity = fa.clip("intensity_scale", 1.0, 10.0)
    return e.select(
        "event_id", fc.month_of("event_date").alias("month"),
        fc.weather_season(fc.month_of("event_date")).alias("season"),
        *[v.alias(k) for k, v in inter.items()],
        intensity.alias("intensity"), fa.intensity_level(intensity).alias("intensity_label"),
        fa.intensity_word("intensity_scale").alias("intensity_word"))


@query("anomaly_features", "F11 F10 P9",
       sql=ov.with_(ov.OBS, WEEKLY_SQL) + """
SELECT location_id, week, avg_temp - 25.0 AS temperature_anomaly_c, precip_week - 100.0 AS precipitation_anomaly_mm,
       wind_kmh - 20.0 AS wind_anomaly_kmph,
       COALESCE(NULLIF(CASE WHEN n_readings > 8 THEN max_temp END, 0.0), avg_temp, 28.0) AS current_temp,
       COALESCE(NULLIF(CASE WHEN n_readings > 8 THEN wind_kmh END, 0.0), wind_kmh, 12.0) AS current_wind
FROM weekly_weather""")
def q_anomaly_features(spark, d):
    w = weekly(spark, d)
    an = fc.anomalies("avg_temp", "precip_week", "wind_kmh")
    # An override (here: the weekly max when enough readings) wins, then the
    # observed value, then the default; a zero override counts as missing.
    override_t = F.when(F.col("n_readings") > 8, F.col("max_temp"))
    override_w = F.when(F.col("n_readings") > 8, F.col("wind_kmh"))
    return w.select("location_id", "week", *[v.alias(k) for k, v in an.items()],
                    F.coalesce(F.nullif(override_t, F.lit(0.0)), F.col("avg_temp"), F.lit(28.0)).alias("current_temp"),
                    F.coalesce(F.nullif(override_w, F.lit(0.0)), F.col("wind_kmh"), F.lit(12.0)).alias("current_wind"))


@query("crop_seasons", "F3",
       sql="""SELECT month(l_shipdate) AS month, """ + ov.CROP_SEASON_SQL.format(m="month(l_shipdate)") + """ AS season,
  CASE WHEN month(l_shipdate) IN (11, 12, 1, 2, 3) THEN 'Rabi' WHEN month(l_shipdate) IN (6, 7, 8, 9, 10) THEN 'Kharif'
       WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Summer' ELSE 'Kharif' END AS season_cli,
  COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3""")
def q_crop_seasons(spark, d):
    from ..sources.tables import table
    li = table(spark, d, "lineitem", "l_shipdate")
    m = F.month("l_shipdate")
    return (li.groupBy(m.alias("month")).agg(F.count(F.lit(1)).alias("n_rows"))
            .select("month", fc.crop_season("month").alias("season"),
                    fc.crop_season("month", march_in_rabi=True).alias("season_cli"), "n_rows"))


@query("day_first_dates", "F1 F2",
       sql="""SELECT CAST(try_strptime(txt, '%d-%m-%Y') AS DATE) AS event_date,
  month(CAST(try_strptime(txt, '%d-%m-%Y') AS DATE)) AS month, COUNT(*) AS n_events
FROM (SELECT CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%d-%m-%Y') END AS txt FROM events)
GROUP BY 1, 2""")
def q_day_first_dates(spark, d):
    from ..sources.tables import table
    ev = table(spark, d, "events", "ts", "event_type")
    txt = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.date_format("ts", "dd-MM-yyyy"))
    parsed = fc.parse_day_first(txt)
    return (ev.select(parsed.alias("event_date")).groupBy("event_date").agg(F.count(F.lit(1)).alias("n_events"))
            .select("event_date", fc.month_of("event_date").alias("month"), "n_events"))


@query("ndvi_proxy_weekly", "F25 F24 F26", sql=ov.with_(ov.OBS, WEEKLY_SQL) + """
SELECT location_id, week,
  LEAST(GREATEST(0.15 + precip_week / 50.0 * 0.1 + solar / 4.0 / 5.0 * 0.05, 0.14), 0.6) AS ndvi_b,
  CASE WHEN LEAST(GREATEST(0.15 + precip_week / 50.0 * 0.1 + solar / 4.0 / 5.0 * 0.05, 0.14), 0.6) > 0.6 THEN 'Dense/healthy vegetation'
       WHEN LEAST(GREATEST(0.15 + precip_week / 50.0 * 0.1 + solar / 4.0 / 5.0 * 0.05, 0.14), 0.6) > 0.3 THEN 'Moderate vegetation'
       WHEN LEAST(GREATEST(0.15 + precip_week / 50.0 * 0.1 + solar / 4.0 / 5.0 * 0.05, 0.14), 0.6) > 0.1 THEN 'Sparse vegetation / stress'
       ELSE 'Bare soil or urban area' END AS band
FROM weekly_weather""")
def q_ndvi_proxy_weekly(spark, d):
    """Vegetation proxy B from the weekly precipitation sum and a reference
    evapotranspiration taken as a quarter of the mean radiation."""
    w = weekly(spark, d)
    nd = fa.ndvi_proxy_b("precip_week", F.col("solar") / F.lit(4.0))
    return w.select("location_id", "week", nd.alias("ndvi_b"), fa.ndvi_band(nd).alias("band"))

"""Payload, file-source and sink queries.

Payloads are built from the supplied tables as JSON strings / text files in
the shared scratch folder, then parsed by the same parsers a landing job
uses; the DuckDB oracles compute the expected values from the base tables
directly, without JSON.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import alerts as fa
from ..functions import text as ft
from ..operators import stats
from ..sources import bindings, files, payloads, sinks
from ..sources.tables import table
from . import oracle_views as ov
from .catalog import query


# S4 ----------------------------------------------------------------------------------
def weather_payloads(spark, d):
    """One open-meteo-shaped JSON document per (location, week): daily arrays
    (at most 7 entries) and hourly humidity (at most 168 entries), so the
    arrays stay bounded however many readings a location has."""
    o = bindings.obs(spark, d).withColumn("week", F.date_trunc("week", "ts").cast("date"))
    k = (F.col("humidity")).cast("int")
    day = (o.groupBy("location_id", "week", "day").agg(
        stats.exact_sum("precip", 2).cast("double").alias("p"), F.max("temp_max").alias("mx"),
        F.when(F.count(F.lit(1)) >= 2, F.min("temp_min")).alias("mn"), F.max("wind_kmh").alias("w"),
        stats.exact_avg("solar", 1).alias("s"), F.max("sunshine_s").alias("sun"),
        F.max_by(F.struct("temp_max", "wind_kmh", k.alias("code")), F.struct("ts", "event_id")).alias("last"),
        F.max(F.struct("ts", "event_id")).alias("last_ts")))
    hour = (o.groupBy("location_id", "week", F.date_trunc("hour", "ts").alias("h"))
            .agg(stats.exact_avg("humidity", 0).alias("rh"))
            .groupBy("location_id", "week").agg(F.array_sort(F.collect_list(F.struct("h", "rh"))).alias("hours")))
    wk = day.groupBy("location_id", "week").agg(
        F.array_sort(F.collect_list(F.struct("day", "p", "mx", "mn", "w", "s", "sun"))).alias("days"),
        F.max_by("last", "last_ts").alias("cur"))
    doc = wk.join(hour, ["location_id", "week"]).select(
        "location_id", "week",
        F.to_json(F.struct(
            F.struct(F.col("cur.temp_max").alias("temperature"), F.col("cur.wind_kmh").alias("windspeed"),
                     F.col("cur.code").alias("weathercode")).alias("current_weather"),
            F.struct(F.transform("days", lambda x: x["day"].cast("string")).alias("time"),
                     F.col("days.p").alias("precipitation_sum"), F.col("days.mx").alias("temperature_2m_max"),
                     F.col("days.mn").alias("temperature_2m_min"), F.col("days.w").alias("windspeed_10m_max"),
                     F.col("days.s").alias("shortwave_radiation_sum"),
                     F.col("days.sun").alias("sunshine_duration")).alias("daily"),
            F.struct(F.col("hours.rh").alias("relativehumidity_2m")).alias("hourly"))).alias("payload"))
    return doc


ENV_COLS = ["temperature", "windspeed", "weathercode", "precipitation", "avg_temp", "max_temp", "min_temp",
            "precip_week", "wind_kmh", "wind_bin", "humidity", "solar", "sunshine_hours", "rainfall_annualized"]


@query("weather_payload_environment", "S4 P9 A1 A2", sql=ov.with_(ov.OBS, """
od AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM obs)""", """
dd AS (SELECT location_id, week, day, CAST(SUM(CAST(precip AS DECIMAL(20,2))) AS DOUBLE) AS p, MAX(temp_max) AS mx,
         CASE WHEN COUNT(*) >= 2 THEN MIN(temp_min) END AS mn, MAX(wind_kmh) AS w,
         CAST(SUM(CAST(solar AS DECIMAL(20,1))) AS DOUBLE) / COUNT(solar) AS s, MAX(sunshine_s) AS sun
       FROM od GROUP BY 1, 2, 3)""", """
cur AS (SELECT location_id, week, arg_max(temp_max, {'t': ts, 'e': event_id}) AS ct, arg_max(wind_kmh, {'t': ts, 'e': event_id}) AS cw,
          CAST(arg_max(humidity, {'t': ts, 'e': event_id}) AS INTEGER) AS code FROM od GROUP BY 1, 2)""", """
hh AS (SELECT location_id, week, CAST(SUM(CAST(rh AS DECIMAL(38,6))) AS DOUBLE) / COUNT(rh) AS rh FROM (
         SELECT location_id, week, date_trunc('hour', ts) AS h,
                CAST(SUM(CAST(humidity AS DECIMAL(20,0))) AS DOUBLE) / COUNT(humidity) AS rh FROM od GROUP BY 1, 2, 3) GROUP BY 1, 2)""", """
wa AS (SELECT location_id, week,
         CAST(SUM(CASE WHEN mx IS NOT NULL AND mn IS NOT NULL THEN CAST(mx AS DECIMAL(38,6)) + CAST(mn AS DECIMAL(38,6)) END) AS DOUBLE)
           / (2.0 * COUNT(CASE WHEN mx IS NOT NULL AND mn IS NOT NULL THEN 1 END)) AS avg_t,
         CAST(SUM(CAST(mx AS DECIMAL(38,6))) AS DOUBLE) / COUNT(mx) AS max_t,
         CAST(SUM(CAST(mn AS DECIMAL(38,6))) AS DOUBLE) / COUNT(mn) AS min_t,
         CAST(SUM(CAST(p AS DECIMAL(38,6))) AS DOUBLE) AS pw, arg_min(p, day) AS pd,
         CAST(SUM(CAST(w AS DECIMAL(38,6))) AS DOUBLE) / COUNT(w) AS wk,
         CAST(SUM(CAST(s AS DECIMAL(38,6))) AS DOUBLE) / COUNT(s) AS sol,
         CAST(SUM(CAST(sun AS DECIMAL(38,6))) AS DOUBLE) / COUNT(sun) / 3600.0 AS sunh FROM dd GROUP BY 1, 2)""") + """
SELECT wa.location_id, wa.week, c.ct AS temperature, c.cw AS windspeed, c.code AS weathercode, COALESCE(wa.pd, 0.0) AS precipitation,
  COALESCE(wa.avg_t, c.ct) AS avg_temp, COALESCE(wa.max_t, c.ct) AS max_temp, COALESCE(wa.min_t, c.ct) AS min_temp,
  COALESCE(wa.pw, 0.0) AS precip_week, COALESCE(wa.wk, c.cw) AS wind_kmh,
  round_even(COALESCE(wa.wk, c.cw) / 3.6 / 0.5, 0) * 0.5 AS wind_bin,
  COALESCE(hh.rh, 55.0) AS humidity, COALESCE(wa.sol, 18.0) AS solar, COALESCE(wa.sunh, 7.0) AS sunshine_hours,
  COALESCE(wa.pw, 0.0) * 365.0 / 7.0 AS rainfall_annualized
FROM wa JOIN cur c ON wa.location_id = c.location_id AND wa.week = c.week
        JOIN hh ON wa.location_id = hh.location_id AND wa.week = hh.week""")
def q_weather_payload_environment(spark, d):
    doc = weather_payloads(spark, d)
    env = doc.select("location_id", "week", payloads.weather_environment("payload").alias("e"))
    return env.select("location_id", "week", "e.current.temperature", "e.current.windspeed", "e.current.weathercode",
                      "e.current.precipitation", "e.aggregate.avg_temp", "e.aggregate.max_temp",
                      "e.aggregate.min_temp", "e.aggregate.precip_week", "e.aggregate.wind_kmh",
                      "e.aggregate.wind_bin", "e.aggregate.humidity", "e.aggregate.solar",
                      "e.aggregate.sunshine_hours", "e.aggregate.rainfall_annualized")


# S5-S8, S12 ---------------------------------------------------------------------------
def location_payloads(spark, d):
    a = bindings.aoi(spark, d)
    i = F.col("aoi_id")
    layer = lambda name, val: F.struct(F.lit(name).alias("name"),
                                       F.array(F.struct(F.struct(val.alias("mean")).alias("values"))).alias("depths"))
    ph = (F.lit(40) + F.pmod(i * 3, F.lit(50))).cast("double")
    soc = F.when(F.pmod(i, F.lit(5)) != 0, (F.pmod(i, F.lit(30)) + F.lit(2)).cast("double"))
    wv = (F.lit(200) + F.pmod(i * 7, F.lit(300))).cast("double")
    layers = F.when(F.pmod(i, F.lit(11)) == 0, F.array().cast("array<struct<name:string,depths:array<struct<values:struct<mean:double>>>>>")) \
        .when(F.pmod(i, F.lit(7)) == 0, F.array(layer("phh2o", ph), layer("soc", soc))) \
        .otherwise(F.array(layer("phh2o", ph), layer("soc", soc), layer("wv0010", wv)))
    soil = F.when(F.pmod(i, F.lit(13)) == 0, F.lit(None).cast("string")).otherwise(
        F.to_json(F.struct(F.struct(layers.alias("layers")).alias("properties"))))
    elev = F.to_json(F.struct(F.array(F.struct(
        F.when(F.pmod(i, F.lit(4)) != 0, F.col("lat") * F.lit(10.0)).alias("elevation"))).alias("results")))
    geo = F.when(F.pmod(i, F.lit(8)) < 6, F.to_json(F.struct(F.array(F.struct(
        F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))).alias("results")))).otherwise(F.lit("{}"))
    v = F.pmod(i, F.lit(4))
    addr = F.to_json(F.struct(F.struct(
        F.when(v == 0, F.col("aoi_name")).alias("state"),
        F.when(v == 1, F.concat(F.col("aoi_name"), F.lit(" district"))).alias("state_district"),
        F.when(v == 2, F.lit("")).alias("region"),
        F.lit("India").alias("country"),
        F.when(v == 0, F.lit("Pune")).alias("city"), F.when(v == 1, F.lit("Kochi")).alias("town"),
        F.when(v == 3, F.lit("Ward 5")).alias("suburb")).alias("address")))
    return a.select("aoi_id", soil.alias("soil"), elev.alias("elev"), geo.alias("geo"), addr.alias("addr"))


@query("location_payloads", "S5 S6 S7 S8 S12", sql=ov.with_(ov.aoi_sql()) + """
SELECT aoi_id,
  CASE WHEN aoi_id % 13 = 0 OR aoi_id % 11 = 0 THEN 6.8 ELSE CAST(40 + (aoi_id * 3) % 50 AS DOUBLE) / 10.0 END AS ph,
  CASE WHEN aoi_id % 13 = 0 OR aoi_id % 11 = 0 OR aoi_id % 5 = 0 THEN 0.8 ELSE CAST(aoi_id % 30 + 2 AS DOUBLE) / 10.0 END AS organic_carbon,
  CASE WHEN aoi_id % 13 = 0 OR aoi_id % 11 = 0 OR aoi_id % 7 = 0 THEN 38.0 ELSE CAST(200 + (aoi_id * 7) % 300 AS DOUBLE) / 10.0 END AS soil_moisture,
  CASE WHEN aoi_id % 13 = 0 THEN TRUE ELSE aoi_id % 11 <> 0 END AS is_land,
  CASE WHEN aoi_id % 4 <> 0 THEN lat * 10.0 ELSE 350.0 END AS elevation,
  CASE WHEN aoi_id % 8 < 6 THEN lat END AS geo_lat, CASE WHEN aoi_id % 8 < 6 THEN lng END AS geo_lon,
  CASE aoi_id % 4 WHEN 0 THEN aoi_name WHEN 1 THEN aoi_name || ' district' ELSE 'India' END AS state,
  CASE aoi_id % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Kochi' END AS city,
  CASE aoi_id % 4 WHEN 3 THEN 'Ward 5' END AS area
FROM aoi""")
def q_location_payloads(spark, d):
    p = location_payloads(spark, d)
    soil = payloads.soil_properties("soil")
    g = payloads.geocode("geo")
    r = payloads.reverse_address("addr")
    return p.select("aoi_id", soil["ph"].alias("ph"), soil["organic_carbon"].alias("organic_carbon"),
                    soil["soil_moisture"].alias("soil_moisture"), payloads.is_land("soil").alias("is_land"),
                    payloads.elevation("elev").alias("elevation"), g["lat"].alias("geo_lat"), g["lon"].alias("geo_lon"),
                    r["state"].alias("state"), r["city"].alias("city"), r["area"].alias("area"))


# S9 / F41 ----------------------------------------------------------------------------
def enso_lines(spark, d):
    """ENSO-style text: one line per order year with 12 monthly values
    (order-count index, 2 decimals), '-999.00' where a month has no orders."""
    o = table(spark, d, "orders", "o_orderdate")
    m = o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    idx = F.format_string("%.2f", (F.col("n").cast("double") / F.lit(100.0) - F.lit(2.0)))
    months = F.array(*[F.lit(i) for i in range(1, 13)])
    per_year = m.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("m", idx))).alias("vals"))
    line = F.concat_ws("    ", F.col("y").cast("string"),
                       F.array_join(F.transform(months, lambda x: F.coalesce(F.try_element_at("vals", x), F.lit("-999.00"))), "    "))
    # the running year has no values yet: a last line of sentinels
    coming = per_year.agg((F.max("y") + 1).alias("y")).select(
        F.col("y").alias("line_no"), F.concat_ws("    ", F.col("y").cast("string"), *[F.lit("-999.00")] * 12).alias("value"))
    return per_year.select(F.col("y").alias("line_no"), line.alias("value")).unionByName(coming)


@query("enso_index", "S9 F41", sql="""
SELECT ROUND(arg_max(v, m), 2) AS mei_index,
  CASE WHEN ROUND(arg_max(v, m), 2) > 0.5 THEN 'El Niño' WHEN ROUND(arg_max(v, m), 2) < -0.5 THEN 'La Niña' ELSE 'Neutral' END AS enso_phase
FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(COUNT(*) AS DOUBLE) / 100.0 - 2.0 AS v FROM orders GROUP BY 1, 2)
WHERE y = (SELECT MAX(year(o_orderdate)) FROM orders)""")
def q_enso_index(spark, d):
    path = sinks.new_output_path(spark, "enso")
    enso_lines(spark, d).select("value").write.mode("overwrite").text(path)
    lines = files.read_text_lines(spark, path)
    lines = lines.select(F.split(F.trim("value"), r"\s+")[0].try_cast("int").alias("line_no"), "value")
    idx = payloads.enso_index(lines)
    return idx.select("mei_index", ft.enso_phase("mei_index").alias("enso_phase"))


# S10 / F24 ---------------------------------------------------------------------------
@query("climate_payload_ndvi", "S10 F24", sql=ov.with_(ov.OBS, """
dd AS (SELECT location_id, day, COUNT(*) AS n, CAST(SUM(CAST(precip AS DECIMAL(20,2))) AS DOUBLE) AS p,
         CAST(SUM(CAST(solar AS DECIMAL(20,1))) AS DOUBLE) / COUNT(solar) AS s FROM obs GROUP BY 1, 2)""") + """
SELECT location_id, period, mean_precip, mean_radiation,
  LEAST(GREATEST(COALESCE(mean_precip, 2.0) * 0.04 + COALESCE(mean_radiation, 4.0) * 0.005, 0.0), 1.0) AS ndvi
FROM (SELECT location_id, CAST((day - DATE '1970-01-01') // 16 AS BIGINT) AS period, CAST(SUM(CAST(CASE WHEN n >= 2 THEN p END AS DECIMAL(38,6))) AS DOUBLE) / COUNT(CASE WHEN n >= 2 THEN p END) AS mean_precip,
             CAST(SUM(CAST(s AS DECIMAL(38,6))) AS DOUBLE) / COUNT(s) AS mean_radiation FROM dd GROUP BY 1, 2)""")
def q_climate_payload_ndvi(spark, d):
    """One payload a location and request period of 16 days, so that its maps are bounded."""
    o = bindings.obs(spark, d)
    dd = o.groupBy("location_id", "day").agg(
        F.count(F.lit(1)).alias("n"), stats.exact_sum("precip", 2).cast("double").alias("p"),
        stats.exact_avg("solar", 1).alias("s"))
    key = F.date_format("day", "yyyyMMdd")
    period = F.floor(F.unix_date("day") / 16).alias("period")
    doc = dd.groupBy("location_id", period).agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.when(F.col("n") >= 2, F.col("p")).otherwise(F.lit(-999.0)))))
        .alias("prec"),
        F.map_from_entries(F.collect_list(F.struct(key, F.col("s")))).alias("srad"))
    js = doc.select("location_id", "period", F.to_json(F.struct(F.struct(F.struct(
        F.col("srad").alias("ALLSKY_SFC_SW_DWN"), F.col("prec").alias("PRECTOTCORR")).alias("parameter"))
        .alias("properties"))).alias("payload"))
    m = payloads.climate_means("payload")
    return js.select("location_id", "period", m["mean_precip"].alias("mean_precip"), m["mean_radiation"].alias("mean_radiation"),
                     fa.ndvi_proxy_a(m["mean_precip"], m["mean_radiation"]).alias("ndvi"))


# S11 ---------------------------------------------------------------------------------
@query("indicator_payloads", "S11", sql=ov.with_(ov.national_series_sql()) + """
SELECT country, arg_max(birth_rate, CASE WHEN birth_rate IS NOT NULL AND rn <= 3 THEN year END) AS birth_rate,
       arg_max(CAST(year AS VARCHAR), CASE WHEN birth_rate IS NOT NULL AND rn <= 3 THEN year END) AS birth_rate_date
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY year DESC) AS rn FROM national_series)
GROUP BY country""")
def q_indicator_payloads(spark, d):
    """Most-recent-3 records per country, newest first (bounded by the request
    size), written as ``[meta, records]``; the parser keeps the first record
    with a value."""
    s = bindings.national_series(spark, d)
    w = Window.partitionBy("country").orderBy(F.col("year").desc())
    recent = s.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    doc = recent.groupBy("country").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rn"), F.col("birth_rate").alias("value"), F.col("year").cast("string").alias("date")))).alias("recs"))
    js = doc.select("country", F.to_json(F.array(
        F.to_json(F.struct(F.lit(1).alias("page"))),
        F.to_json(F.transform("recs", lambda r: F.struct(r["value"].alias("value"), r["date"].alias("date")))))).alias("payload"))
    v = payloads.indicator_value("payload")
    return js.select("country", v["value"].alias("birth_rate"), v["date"].alias("birth_rate_date"))


# S1 / S2 -----------------------------------------------------------------------------
CROP_CSV_SCHEMA = "state STRING, season STRING, n DOUBLE, p DOUBLE, k DOUBLE, rainfall DOUBLE, crop STRING"


@query("csv_roundtrip", "S1 S2 S17 P1", sql=ov.with_(ov.CROP_ROWS) + """
SELECT crop, COUNT(*) AS n_rows, SUM(n) AS total_n FROM crop_rows GROUP BY crop""")
def q_csv_roundtrip(spark, d):
    rows = bindings.crop_rows(spark, d)
    path = sinks.new_output_path(spark, "crop_csv")
    # Drop derived / target-adjacent columns before export (missing names are ignored)
    out = rows.drop("crop_yield", "temperature", "soil_type", "irrigation", "not_a_column", "l_orderkey", "l_linenumber")
    out.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = files.read_csv_dataset(spark, path, CROP_CSV_SCHEMA)
    assert files.read_csv_dataset(spark, path + "-missing", CROP_CSV_SCHEMA) is None
    sheet = files.read_sheet_export(spark, path, CROP_CSV_SCHEMA)
    return (back.groupBy("crop").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("total_n"))
            .join(sheet.groupBy("crop").agg(F.count(F.lit(1)).alias("_n2")), "crop")
            .where(F.col("n_rows") == F.col("_n2")).drop("_n2"))


@query("malformed_rows_skipped", "S2", sql="""
SELECT o_orderstatus, COUNT(*) AS n_rows FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def q_malformed_rows_skipped(spark, d):
    """Rows of one priority are written with a broken numeric field; the
    spreadsheet-export reader drops exactly those."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    bad = F.col("o_orderpriority") == "5-LOW"
    txt = o.select(F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus",
                   F.when(bad, F.lit("n.a.")).otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    path = sinks.new_output_path(spark, "orders_sheet")
    txt.write.mode("overwrite").option("header", True).csv(path)
    df = files.read_sheet_export(spark, path, "key LONG, o_orderstatus STRING, price DOUBLE")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


# S3 ----------------------------------------------------------------------------------
@query("metadata_dimension", "S3 S17", sql=ov.with_(ov.STATE_PANEL) + """
SELECT state AS name, arg_max(forest_pct, year) AS rate FROM state_panel GROUP BY state""")
def q_metadata_dimension(spark, d):
    """Training writes a metadata document (latest forest share per state, a
    map bounded by the number of states); the serving side reads it back as a
    (ord, name, rate) dimension."""
    from ..operators import panels
    snap = panels.latest_non_null(bindings.state_panel(spark, d).select("state", "year", "forest_pct"), "state", "year")
    meta = snap.agg(F.map_from_entries(F.collect_list(F.struct("state", "forest_pct"))).alias("state_forest_pct"))
    path = sinks.new_output_path(spark, "metadata")
    meta.coalesce(1).write.mode("overwrite").json(path)
    dim = files.read_rate_metadata(spark, path, "state_forest_pct")
    return dim.select("name", "rate")


# S13-S16 -----------------------------------------------------------------------------
def nested_alerts(spark, d):
    from .queries_climate import alert_frame
    w = alert_frame(spark, d)
    return w.select(
        "location_id", "week",
        F.struct(F.struct("ndvi", "ndwi", "ndbi", "nbr").alias("indices"),
                 F.struct(fa.level_from_points("points").alias("level"), "points").alias("alert"),
                 fa.risk_notes("wind_kmh", "max_temp", "precip_day").alias("notes")).alias("report"))


def _flat_sql() -> str:
    from .queries_climate import ALERT_SQL, WEEKLY_SQL
    return ov.with_(ov.OBS, WEEKLY_SQL) + f"""
SELECT location_id, week, ndvi AS "report.indices.ndvi", level AS "report.alert.level", points AS "report.alert.points",
       replace(risk_notes, '|', '; ') AS "report.notes" FROM ({ALERT_SQL})"""


@query("flat_export", "S13", sql=_flat_sql())
def q_flat_export(spark, d):
    flat = sinks.flatten(nested_alerts(spark, d))
    path = sinks.new_output_path(spark, "flat_alerts")
    flat.write.mode("overwrite").option("header", True).csv(path)
    return flat.select("location_id", "week", "`report.indices.ndvi`", "`report.alert.level`",
                       "`report.alert.points`", "`report.notes`")


def _alert_sql(select: str, *views: str) -> str:
    from .queries_climate import ALERT_SQL, WEEKLY_SQL
    return ov.with_(ov.OBS, WEEKLY_SQL, *views, f"\nalerts AS ({ALERT_SQL})") + select


@query("nested_json_export", "S14", sql=_alert_sql("SELECT level, COUNT(*) AS n FROM alerts GROUP BY level"))
def q_nested_json_export(spark, d):
    df = nested_alerts(spark, d)
    path = sinks.write_nested_json(df, sinks.new_output_path(spark, "nested_alerts"))
    return spark.read.json(path).groupBy(F.col("report.alert.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("parameter_status_table", "S15 F51", sql=ov.with_(ov.OBS, __import__("terrapulse.plans.queries_climate", fromlist=["x"]).WEEKLY_SQL) + """
SELECT location_id, week, parameter, value, unit,
  CASE WHEN value IS NULL OR value = '' OR value = 'N/A' THEN 'No Data'
       WHEN regexp_matches(lower(value), 'risk|alert|severe|high') THEN 'Warning'
       WHEN contains(lower(value), 'moderate') THEN 'Monitor' ELSE 'Normal' END AS status
FROM (
  SELECT location_id, week, 'Humidity' AS parameter, COALESCE(CAST(CAST(trunc(humidity) AS BIGINT) AS VARCHAR), 'N/A') AS value, '%' AS unit FROM weekly_weather
  UNION ALL SELECT location_id, week, 'Wind band', CASE WHEN wind_kmh > 55 THEN 'High wind' WHEN wind_kmh > 35 THEN 'Moderate wind' ELSE 'Calm' END, '' FROM weekly_weather
  UNION ALL SELECT location_id, week, 'Drought', COALESCE(CASE WHEN precip_week < 50 THEN 'Drought risk' END, 'N/A'), '' FROM weekly_weather)""")
def q_parameter_status_table(spark, d):
    from .queries_climate import weekly
    w = weekly(spark, d).select(
        F.struct("location_id", "week").alias("k"),
        F.col("humidity").cast("long").cast("string").alias("hum"),
        F.when(F.col("wind_kmh") > 55, "High wind").when(F.col("wind_kmh") > 35, "Moderate wind")
         .otherwise("Calm").alias("wind_band"),
        F.when(F.col("precip_week") < 50, F.lit("Drought risk")).alias("drought"))
    t = sinks.parameter_table(w, "k", [("Humidity", "hum", "%"), ("Wind band", "wind_band", ""), ("Drought", "drought", "")])
    return t.select("k.location_id", "k.week", "parameter", "value", "unit", "status")


# a report has five lines
@query("alert_text_reports", "S16 P10", sql=_alert_sql("""
SELECT CAST(5 * COUNT(*) AS BIGINT) AS n_lines FROM alerts JOIN aoi ON aoi_id = location_id
WHERE level <> 'GREEN' AND user_email IS NOT NULL""", ov.aoi_sql()))
def q_alert_text_reports(spark, d):
    a = nested_alerts(spark, d).where(F.col("report.alert.level") != "GREEN")
    aoi = bindings.aoi(spark, d).select(F.col("aoi_id").alias("location_id"), "aoi_name", "lat", "lng", "user_email")
    j = a.join(aoi, "location_id").where(F.col("user_email").isNotNull())
    txt = j.select("location_id", sinks.alert_text(F.col("report.alert.level"), F.col("aoi_name"),
                                                   F.array_join("report.notes", " "), F.col("lat"), F.col("lng"),
                                                   F.col("week").cast("timestamp")).alias("text"))
    path = sinks.write_text_reports(txt, "text", sinks.new_output_path(spark, "alert_reports"))
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


# S19 ---------------------------------------------------------------------------------
@query("dataset_readiness", "S19", sql=ov.with_(ov.STATE_PANEL, ov.CROP_ROWS, ov.event_rows_sql(), ov.national_series_sql()) + """
SELECT 'forest_panel' AS dataset, TRUE AS available, COUNT(*) AS row_count FROM state_panel
UNION ALL SELECT 'crop_survey', TRUE, COUNT(*) FROM crop_rows
UNION ALL SELECT 'weather_events', TRUE, COUNT(*) FROM event_rows
UNION ALL SELECT 'population_series', TRUE, COUNT(*) FROM national_series
UNION ALL SELECT 'drought_grid', FALSE, 0""")
def q_dataset_readiness(spark, d):
    missing = files.read_csv_dataset(spark, sinks.new_output_path(spark, "absent"), CROP_CSV_SCHEMA)
    return sinks.readiness({"forest_panel": bindings.state_panel(spark, d), "crop_survey": bindings.crop_rows(spark, d),
                            "weather_events": bindings.event_rows(spark, d),
                            "population_series": bindings.national_series(spark, d), "drought_grid": missing})

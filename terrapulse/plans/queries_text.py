"""Message and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import alerts as fa
from ..functions import text as ft
from ..operators import panels
from ..sources import bindings
from ..sources.tables import table
from . import oracle_views as ov
from .catalog import query


def _intent_sql_expr(col: str) -> str:
    parts = []
    for intent, kws in dims.INTENT_KEYWORDS:
        cond = " OR ".join(f"contains(lower({col}), {ov.sql_str(k)})" for k in kws)
        parts.append(f"CASE WHEN {cond} THEN {ov.sql_str(intent)} END")
    return f"COALESCE(NULLIF(concat_ws(',', {', '.join(parts)}), ''), 'unknown')"


def _tokens(col: str) -> str:
    # Unicode word runs, the same boundaries as the \b of the Spark (Java) regex
    return f"regexp_split_to_array({col}, '[^\\p{{L}}\\p{{Nd}}_]+')"


def _message_sql() -> str:
    gaz = "[" + ", ".join(ov.sql_str(p) for p in dims.GAZETTEER) + "]"
    gaz_low = "[" + ", ".join(ov.sql_str(p.lower()) for p in dims.GAZETTEER) + "]"
    return ov.with_(ov.MESSAGES, f"""
tok AS (SELECT msg_id, text,
  list_filter({_tokens('text')}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{{2,}}')) AS caps,
  list_filter({_tokens('lower(text)')}, lambda w: regexp_full_match(w, '[a-z]{{4,}}')) AS lw,
  list_filter({_tokens('text')}, lambda w: regexp_full_match(w, '19[5-9][0-9]|20[0-2][0-9]')) AS yrs
  FROM messages)""") + f"""
SELECT msg_id, {_intent_sql_expr('text')} AS intents,
  COALESCE(list_filter(caps, lambda w: list_contains({gaz}, w))[1],
           list_extract({gaz}, list_position({gaz_low}, list_filter(lw, lambda w: list_contains({gaz_low}, w))[1])),
           caps[1]) AS location,
  COALESCE(CAST(yrs[1] AS INTEGER), {dims.DEFAULT_YEAR}) AS year
FROM tok"""


@query("message_intents", "F45 F46 F47", sql=_message_sql())
def q_message_intents(spark, d):
    m = bindings.messages(spark, d).select("msg_id", "text", F.lower("text").alias("low"))
    return m.select("msg_id", F.array_join(ft.intents("low", lowered=True), ",").alias("intents"),
                    ft.extract_location("text").alias("location"), ft.extract_year("text").alias("year"))


@query("intent_counts", "F45", sql=ov.with_(ov.MESSAGES) + f"""
SELECT split_part({_intent_sql_expr('text')}, ',', 1) AS first_intent, COUNT(*) AS n_messages FROM messages GROUP BY 1""")
def q_intent_counts(spark, d):
    m = bindings.messages(spark, d).select(F.lower("text").alias("low"))
    first = F.element_at(ft.intents("low", lowered=True), 1)
    return m.groupBy(first.alias("first_intent")).agg(F.count(F.lit(1)).alias("n_messages"))


@query("coordinate_parsing", "F40 P13", sql=ov.with_(ov.aoi_sql()) + """
SELECT aoi_id, txt,
  CASE WHEN len(string_split(txt, ',')) = 2 AND TRY_CAST(string_split(txt, ',')[1] AS DOUBLE) IS NOT NULL
            AND TRY_CAST(string_split(txt, ',')[2] AS DOUBLE) IS NOT NULL THEN TRY_CAST(string_split(txt, ',')[1] AS DOUBLE) END AS lat,
  CASE WHEN len(string_split(txt, ',')) = 2 AND TRY_CAST(string_split(txt, ',')[1] AS DOUBLE) IS NOT NULL
            AND TRY_CAST(string_split(txt, ',')[2] AS DOUBLE) IS NOT NULL THEN TRY_CAST(string_split(txt, ',')[2] AS DOUBLE) END AS lon,
  CASE WHEN NOT (len(string_split(txt, ',')) = 2 AND TRY_CAST(string_split(txt, ',')[1] AS DOUBLE) IS NOT NULL
            AND TRY_CAST(string_split(txt, ',')[2] AS DOUBLE) IS NOT NULL) THEN trim(txt) END AS place,
  CASE WHEN NOT (len(string_split(txt, ',')) = 2 AND TRY_CAST(string_split(txt, ',')[1] AS DOUBLE) IS NOT NULL
            AND TRY_CAST(string_split(txt, ',')[2] AS DOUBLE) IS NOT NULL) AND trim(txt) = ''
       THEN 'Latitude and Longitude are required for analysis.' END AS error
FROM (SELECT aoi_id, CASE WHEN aoi_id % 3 = 0 THEN CAST(lat AS VARCHAR) || ',' || CAST(lng AS VARCHAR)
                          WHEN aoi_id % 3 = 1 THEN aoi_name WHEN aoi_id % 6 = 5 THEN '  '
                          ELSE CAST(lat AS VARCHAR) || ',x' END AS txt FROM aoi)""")
def q_coordinate_parsing(spark, d):
    a = bindings.aoi(spark, d)
    txt = (F.when(F.pmod("aoi_id", F.lit(3)) == 0, F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string")))
           .when(F.pmod("aoi_id", F.lit(3)) == 1, F.col("aoi_name"))
           .when(F.pmod("aoi_id", F.lit(6)) == 5, F.lit("  "))
           .otherwise(F.concat(F.col("lat").cast("string"), F.lit(",x"))))
    a = a.select("aoi_id", txt.alias("txt"))
    p = ft.parse_coordinates("txt")
    # A request needs coordinates or a place name; invalid rows carry an
    # error instead of failing the job (a caller can route them to a side table)
    missing = p["lat"].isNull() & (F.coalesce(p["place"], F.lit("")) == "")
    return a.select("aoi_id", "txt", p["lat"].alias("lat"), p["lon"].alias("lon"), p["place"].alias("place"),
                    F.when(missing, F.lit("Latitude and Longitude are required for analysis.")).alias("error"))


@query("aoi_geometry", "F44", sql="""
SELECT o_custkey AS aoi_id, COUNT(*) AS n_vertices,
  CASE WHEN COUNT(*) = 1 THEN MIN(lat) + 0.05 ELSE MAX(lat) END AS north,
  CASE WHEN COUNT(*) = 1 THEN MIN(lat) - 0.05 ELSE MIN(lat) END AS south,
  CASE WHEN COUNT(*) = 1 THEN MIN(lon) + 0.05 ELSE MAX(lon) END AS east,
  CASE WHEN COUNT(*) = 1 THEN MIN(lon) - 0.05 ELSE MIN(lon) END AS west,
  (MAX(lat) + MIN(lat)) / 2.0 AS center_lat, (MAX(lon) + MIN(lon)) / 2.0 AS center_lon
FROM (SELECT o_custkey, CAST(8.0 + (o_orderkey * 7) % 29 AS DOUBLE) + (o_orderkey % 100) / 100.0 AS lat,
             CAST(68.0 + (o_orderkey * 11) % 29 AS DOUBLE) + (o_orderkey % 37) / 37.0 AS lon FROM orders)
GROUP BY o_custkey""")
def q_aoi_geometry(spark, d):
    """AOI shapes: every order of a customer is a drawn vertex; one vertex is a
    pin, which becomes a +-0.05 degree box.  One aggregate per AOI."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    v = o.select(F.col("o_custkey").alias("aoi_id"),
                 ((F.lit(8.0) + F.pmod(k * 7, F.lit(29))).cast("double") + F.pmod(k, F.lit(100)) / F.lit(100.0)).alias("lat"),
                 ((F.lit(68.0) + F.pmod(k * 11, F.lit(29))).cast("double") + F.pmod(k, F.lit(37)) / F.lit(37.0)).alias("lon"))
    g = v.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.min("lat").alias("_s"), F.max("lat").alias("_n"),
                                F.min("lon").alias("_w"), F.max("lon").alias("_e"))
    pin = F.col("n_vertices") == 1
    h = F.lit(0.05)
    return g.select("aoi_id", "n_vertices",
                    F.when(pin, F.col("_s") + h).otherwise(F.col("_n")).alias("north"),
                    F.when(pin, F.col("_s") - h).otherwise(F.col("_s")).alias("south"),
                    F.when(pin, F.col("_w") + h).otherwise(F.col("_e")).alias("east"),
                    F.when(pin, F.col("_w") - h).otherwise(F.col("_w")).alias("west"),
                    ((F.col("_n") + F.col("_s")) / F.lit(2.0)).alias("center_lat"),
                    ((F.col("_e") + F.col("_w")) / F.lit(2.0)).alias("center_lon"))


def _delta_sql() -> str:
    from .queries_urban import urban_features_sql
    metrics = [("population_m", "population_m", "future_population"),
               ("urbanization_rate", "urbanization_rate", "future_urb_rate"),
               ("infra_pressure", "infra_pressure_score", "future_infra_pressure"),
               ("urban_pop_m", "urban_pop_m", "future_urban_pop"),
               ("growth_rate", "growth_rate", "future_growth_rate")]
    union = "\nUNION ALL ".join(
        f"SELECT country, year, '{m}' AS metric, {a} AS now, {b} AS forecast, {b} - {a} AS delta, "
        f"CASE WHEN {b} - {a} >= 0 THEN '+' ELSE '-' END AS sign FROM latest" for m, a, b in metrics)
    return urban_features_sql() + f""",
latest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY year DESC) AS rn
           FROM urban_features WHERE future_population IS NOT NULL) WHERE rn = 1)
{union}"""


DELTA_PAIRS = [("population_m", "population_m", "future_population"),
               ("urbanization_rate", "urbanization_rate", "future_urb_rate"),
               ("infra_pressure", "infra_pressure_score", "future_infra_pressure"),
               ("urban_pop_m", "urban_pop_m", "future_urban_pop"),
               ("growth_rate", "growth_rate", "future_growth_rate")]


@query("forecast_deltas", "F43 W10", sql=_delta_sql())
def q_forecast_deltas(spark, d):
    from .queries_urban import urban_features
    u = urban_features(spark, d).where(F.col("future_population").isNotNull())
    latest = panels.latest_n(u, "country", "year", 1)
    ex = latest.select("country", "year", F.explode(ft.delta_rows(DELTA_PAIRS)).alias("r"))
    return ex.select("country", "year", "r.metric", "r.now", "r.forecast", "r.delta", "r.sign")


def _spei_summary_sql() -> str:
    from .queries_climate import DROUGHT_SQL, WEEKLY_SQL
    return ov.with_(ov.OBS, WEEKLY_SQL) + f"""
SELECT mean_spei, mean_temp, n_weeks,
       CASE WHEN mean_spei < -1.0 THEN 'Below -1.0 indicates drought conditions.' ELSE 'Near-normal moisture conditions on average.' END AS note
FROM (SELECT AVG(spei) AS mean_spei, COUNT(*) AS n_weeks FROM ({DROUGHT_SQL})) s
CROSS JOIN (SELECT AVG(avg_temp) AS mean_temp FROM weekly_weather) t"""


@query("spei_summary", "A7 F50", sql=_spei_summary_sql())
def q_spei_summary(spark, d):
    from .queries_climate import q_drought_indicators, weekly
    dr = q_drought_indicators(spark, d)
    w = weekly(spark, d)
    s = dr.agg(F.avg("spei").alias("mean_spei"), F.count(F.lit(1)).alias("n_weeks"))
    t = w.agg(stats_avg_temp().alias("mean_temp"))
    return s.crossJoin(t).select("mean_spei", "mean_temp", "n_weeks", fa.spei_mean_note("mean_spei").alias("note"))


def stats_avg_temp():
    return F.avg("avg_temp")


def _enso_labels_sql() -> str:
    from .queries_stats import _event_probs_sql
    lst = lambda xs: "(" + ", ".join(ov.sql_str(x) for x in xs) + ")"
    return "WITH " + _event_probs_sql().strip() + f"""
SELECT user_id AS location_id, state, (wa - 20.0) / 25.0 AS mei_index,
  CASE WHEN (wa - 20.0) / 25.0 > 0.5 THEN 'El Niño' WHEN (wa - 20.0) / 25.0 < -0.5 THEN 'La Niña' ELSE 'Neutral' END AS enso_phase,
  concat_ws(', ', CASE WHEN state IN {lst(dims.COASTAL_STATES)} THEN 'coastal' END,
                  CASE WHEN state IN {lst(dims.HILLY_STATES)} THEN 'hilly/northeast' END,
                  CASE WHEN state IN {lst(dims.DRY_STATES)} THEN 'arid/dry' END) AS region_type
FROM u2"""


@query("enso_labels", "F41 P5", sql=_enso_labels_sql())
def q_enso_labels(spark, d):
    from .queries_matching import geo_flags
    from .queries_stats import event_probabilities
    g = event_probabilities(spark, d)
    flags = geo_flags()
    mei = (F.col("wind_anom") - F.lit(20.0)) / F.lit(25.0)
    return g.select(F.col("user_id").alias("location_id"), "state", mei.alias("mei_index"),
                    ft.enso_phase(mei).alias("enso_phase"),
                    F.array_join(ft.region_tags(flags["is_coastal"], flags["is_hilly"], flags["is_dry"]), ", ")
                    .alias("region_type"))

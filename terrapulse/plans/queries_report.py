"""Unified report queries (M11, P10-P14, J12, F38, F39, F48, R5 batch form)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from ..session import scratch_path
from . import report
from .catalog import query


def _report(spark, d):
    """The report table of a data folder, brought up to date: unchanged areas are carried over."""
    return report.refresh(spark, d, scratch_path(spark, "reports", hashlib.sha256(d.rstrip("/").encode()).hexdigest()[:16]))


@query("unified_report", "M11 J12 P11 P12 P13 P14 F23 F27 F28 F29 F31 F32 F33 F34 F36 F37 F38 F39 J7 J8 J1 M9")
def q_unified_report(spark, d):
    """Scores with the models that the training job has committed; other domains are errors."""
    r = _report(spark, d)
    return r.select("aoi_id", "location", "state", "is_water", F.col("ensemble.overall_alert_level").alias("alert_level"),
                    F.array_join("ensemble.signals", "|").alias("signals"), "summary",
                    F.array_join("errors", "|").alias("errors"),
                    F.size("automation.models_run").alias("n_models_run"),
                    F.col("indices.ndwi").alias("ndwi"), F.col("indices.risk_level").alias("risk_level"),
                    F.col("reports.effects_report.forest.air_quality.category").alias("aqi_category"),
                    F.col("reports.infrastructure_needs.pressure_level").alias("pressure_level"))


@query("alert_outbox", "P10 R5 F39")
def q_alert_outbox(spark, d):
    """Non-GREEN reports with a recipient become outbox rows (instead of mail)."""
    r = _report(spark, d)
    sel = r.where((F.col("ensemble.overall_alert_level") != "GREEN") & F.col("user_email").isNotNull())
    return sel.select(F.col("user_email").alias("to_email"), F.col("location").alias("aoi_name"),
                      F.col("ensemble.overall_alert_level").alias("level"),
                      F.concat(F.lit("Environmental alert: "), F.col("ensemble.overall_alert_level"), F.lit(" - "),
                               F.col("location")).alias("subject"),
                      "summary", F.col("coordinates.lat").alias("lat"), F.col("coordinates.lon").alias("lng"))


@query("chat_answers", "F48 F45 F46")
def q_chat_answers(spark, d):
    """Every message gets an answer: the report lines of the area it names
    (case-insensitive name match, one area per name), a 'cannot locate'
    reply for unknown places, or a request for a location."""
    from ..functions import text as ft
    from ..sources import bindings
    r = _report(spark, d)
    lines = report.report_lines(r).join(r.select("aoi_id", "location"), "aoi_id")
    one = (lines.groupBy(F.lower("location").alias("_key"))
           .agg(F.min_by("answer", "aoi_id").alias("answer")))
    m = bindings.messages(spark, d).select("msg_id", ft.extract_location("text").alias("place"),
                                           F.element_at(ft.intents("text"), 1).alias("intent"))
    j = m.join(one, F.lower(m.place) == one._key, "left")
    answer = (F.when(F.col("place").isNull(), F.lit("Please specify a location."))
              .when(F.col("answer").isNull(), F.concat(F.lit("Cannot locate "), F.col("place"), F.lit(".")))
              .otherwise(F.col("answer")))
    return j.select("msg_id", "intent", "place", answer.alias("answer"))


POINTS = ("(CASE WHEN t > 45 THEN 3 WHEN t > 40 THEN 2 WHEN t > 37 THEN 1 ELSE 0 END"
          " + CASE WHEN w > 80 THEN 3 WHEN w > 55 THEN 2 WHEN w > 35 THEN 1 ELSE 0 END"
          " + CASE WHEN p > 80 THEN 2 WHEN p > 50 THEN 1 ELSE 0 END)")


def _levels_sql() -> str:
    """Views up to ``l``: the inputs, water flag and base level of every area."""
    from . import oracle_views as ov
    from . import queries_payloads  # noqa: F401  (registers the SQL used below)
    from .catalog import REGISTRY
    views, _, body = REGISTRY["weather_payload_environment"].sql.rpartition("\nSELECT wa.location_id")
    return views + "," + ov.aoi_sql() + f""",
env AS (SELECT wa.location_id{body}),
last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY week DESC) AS r FROM env) WHERE r = 1),
veg AS (SELECT location_id, LEAST(GREATEST(AVG(precip) * 0.04 + AVG(solar) * 0.005, 0.0), 1.0) AS ndvi FROM obs GROUP BY 1),
a AS (SELECT aoi_id, aoi_id % 13 <> 0 AND aoi_id % 11 = 0 AS water, COALESCE(temperature, 28.0) AS t,
             COALESCE(windspeed, 12.0) AS w, COALESCE(precipitation, 0.0) AS p, ndvi
      FROM aoi LEFT JOIN last ON aoi_id = last.location_id LEFT JOIN veg ON aoi_id = veg.location_id),
l AS (SELECT *, CASE WHEN water OR {POINTS} < 3 THEN 'GREEN' WHEN {POINTS} < 6 THEN 'YELLOW' ELSE 'RED' END AS alert_level FROM a)"""


def _rules_sql() -> str:
    missing = "; ".join(report.ERROR_TEXTS[k] for k in report.DOMAINS)
    return _levels_sql() + f"""
SELECT aoi_id, water AS is_water, alert_level,
  CASE WHEN NOT water THEN round_even(LEAST(GREATEST(p / 200.0 - 0.3, -1.0), 1.0), 3) END AS ndwi,
  CASE WHEN NOT water THEN round_even(LEAST(GREATEST(0.4 - COALESCE(NULLIF(ndvi, 0.0), 0.3), -1.0), 1.0), 3) END AS ndbi,
  CASE WHEN NOT water THEN round_even({POINTS} / 11.0, 2) END AS risk_level,
  CASE WHEN water THEN 'Location identified as water or unrecognized territory.' ELSE '' END AS signals,
  'AOI analyzed with limited ML coverage.' AS summary,
  'Alert: ' || alert_level || CASE WHEN water THEN '' ELSE chr(10) || 'Errors: {missing}' END AS answer
FROM l"""


@query("report_rules", "M11 J12 P11 P12 P13 P14 F23 F38 F39 F48 S12", sql=_rules_sql())
def q_report_rules(spark, d):
    """The report without any model: inputs joined per area, indices, base and ensemble
    level, water areas, an error entry a domain, fallback summary and answer lines."""
    r = report.unified_report(spark, d, run=())
    lines = report.report_lines(r).withColumnRenamed("aoi_id", "_id")
    j = r.join(lines, F.col("aoi_id") == F.col("_id"))
    return j.select("aoi_id", "is_water", F.col("ensemble.overall_alert_level").alias("alert_level"),
                    F.col("indices.ndwi").alias("ndwi"), F.col("indices.ndbi").alias("ndbi"),
                    F.col("indices.risk_level").alias("risk_level"),
                    F.array_join("ensemble.signals", "|").alias("signals"), "summary", "answer")


#: Model outputs by area, written once as SQL that both engines read; ``k`` and ``m`` come from the area's id.
GIVEN = {
    "crop_probs": "array((k + 1) / 32.0D, 0.25D, m / 8.0D)", "_crop_labels": "array('Maize', 'Rice', 'Wheat')",
    "_spei": "(k - 3) / 2.0D", "dcat_probs": "array(k / 16.0D, m / 8.0D, 0.25D)",
    "_drought_labels": "array('Extremely Dry', 'Moderately Dry', 'Near Normal')", "dstat_pred": "aoi_id % 2 * 1.0D",
    "dstat_probs": "array(0.25D, 0.75D)", "wev_probs": "array(0.5D, k / 16.0D, m / 8.0D)",
    "_event_labels": "array('Dust', 'Fog', 'Haze')", "_wseason": "'Winter'", "wint_pred": "k * 1.5D + 0.5D",
    "matched_state": "CASE WHEN aoi_id % 3 < 2 THEN 'Kerala' END", "falert_pred": "m * 1.0D",
    "falert_probs": "array(0.125D, 0.25D, 0.5D, 0.125D)", "fndvi_pred": "k / 16.0D", "fcover_pred": "1000.0D + k * 8",
    "faqi_pred": "k * 20.0D", "fhuman_pred": "k * 10.0D", "_extrap_pct": "20.0D", "_ndvi_used": "0.5D", "_extrap_cover": "1000.0D",
    "upop_pred": "1400.0D + k", "uurb_pred": "36.0D + k / 4.0D", "uinfra_pred": "50.0D + k * 6", "uupop_pred": "500.0D + k",
    "ugrow_pred": "k / 16.0D", "_u_urb": "36.0D", "_u_urban_pop": "500.0D"}


def _given_sql() -> str:
    from .. import dims
    g = {c: re.sub(r"([0-9.]+)D\b", r"\1::DOUBLE", e).replace("array(", "list_value(") for c, e in GIVEN.items()}
    best = lambda probs, labels: (
        f"list_sort(list_transform(range(1, 4), lambda i: {{'p': -{probs}[i], 'label': {labels}[i]}}))[1]")
    labels = " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.ALERT_LABELS)
    level = "CASE {r} WHEN 2 THEN 'RED' WHEN 1 THEN 'YELLOW' ELSE 'GREEN' END"
    return _levels_sql() + f""",
g AS (SELECT aoi_id, {", ".join(f"{e} AS {c}" for c, e in g.items())}
      FROM (SELECT aoi_id, aoi_id % 7 AS k, aoi_id % 4 AS m FROM aoi)),
b AS (
  SELECT *, {best("crop_probs", "_crop_labels")} AS crop, {best("dcat_probs", "_drought_labels")} AS dry,
         list_sum(wev_probs) AS total, {best("wev_probs", "_event_labels")} AS event, dstat_pred >= 1 AS active,
         round_even(LEAST(GREATEST(wint_pred, 1.0), 10.0), 1) AS strength, matched_state IS NOT NULL AS known,
         CASE falert_pred::INT {labels} END AS forest FROM l JOIN g USING (aoi_id)),
c AS (
  SELECT *, CASE WHEN strength >= 8 THEN 2 WHEN strength >= 4 THEN 1 ELSE 0 END AS strong,
         CASE WHEN active AND dry.label = 'Extremely Dry' THEN 2 WHEN active AND dry.label = 'Moderately Dry' THEN 1 ELSE 0 END AS drought
  FROM b),
d AS (
  SELECT *, CASE WHEN water THEN 0 ELSE GREATEST(CASE alert_level WHEN 'RED' THEN 2 WHEN 'YELLOW' THEN 1 ELSE 0 END, drought, strong,
           CASE WHEN known THEN LEAST(falert_pred, 2) ELSE 0 END, CASE WHEN uinfra_pred > 80 THEN 2 WHEN uinfra_pred > 60 THEN 1 ELSE 0 END) END::INT AS worst
  FROM c)
SELECT aoi_id, {level.format(r="worst")} AS alert_level,
  CASE WHEN water THEN 'Location identified as water or unrecognized territory.' ELSE concat_ws('|', 'crop=' || crop.label,
    'drought=' || dry.label, 'weather=' || event.label, CASE WHEN known THEN 'forest=' || forest END, 'urban_infra=' || uinfra_pred) END AS signals,
  CASE WHEN water THEN 'AOI analyzed with limited ML coverage.' ELSE concat_ws(' ', 'Crop recommendation is ' || crop.label || '.',
    'Drought outlook is ' || dry.label || ' and drought is ' || CASE WHEN active THEN 'active.' ELSE 'not active.' END,
    CASE WHEN known THEN 'Forest outlook is ' || forest || '.' END, 'Urban infrastructure pressure is ' || uinfra_pred || '.') END AS summary,
  CASE WHEN water THEN 'Alert: GREEN' ELSE concat_ws(chr(10), 'Alert: ' || {level.format(r="worst")},
    'Crop model: ' || crop.label || ' (' || round_even(-crop.p * 100, 1) || '%)', 'Drought category model: ' || dry.label,
    'Drought status model: ' || CASE WHEN active THEN 'active' ELSE 'inactive' END,
    'Weather event model: ' || event.label || ' (' || round_even(-event.p / total * 100, 1) || '%)',
    'Weather intensity model: ' || strength || '/10 (' || {level.format(r="strong")} || ')',
    CASE WHEN known THEN 'Forest alert model: ' || forest || ' (' || round_even(falert_probs[falert_pred::INT + 1] * 100, 1) || '%)' END,
    CASE WHEN known THEN 'Forest NDVI model: future NDVI ' || round_even(fndvi_pred, 3) END,
    'Urban population model: ' || upop_pred || 'M', 'Urbanization model: ' || uurb_pred || '%',
    'Urban infra model: score ' || uinfra_pred, 'Urban growth model: ' || ugrow_pred || '%',
    CASE WHEN NOT known THEN 'Errors: {report.ERROR_TEXTS["forest"]}' END) END AS answer,
  (CASE WHEN water THEN 0 WHEN known THEN 15 ELSE 10 END)::INT AS n_models_run,
  CASE WHEN NOT water THEN {level.format(r="drought")} END AS drought_level,
  CASE WHEN NOT water THEN strength END AS intensity,
  CASE WHEN NOT water AND known THEN falert_pred::INT END AS forest_code,
  CASE WHEN NOT water THEN uupop_pred END AS future_urban_population
FROM d"""


@query("report_given_outputs", "M11 P11 P12 P14 F18 F20 F38 F39 F48 T2 M10", sql=_given_sql())
def q_report_given_outputs(spark, d):
    """The report's assembly on given model outputs: entries of all models and domains, ensemble
    level over all five sources, signals, summary and every answer line."""
    from ..sources import bindings
    areas = bindings.aoi(spark, d).select("aoi_id", (F.col("aoi_id") % 7).alias("k"), (F.col("aoi_id") % 4).alias("m"))
    outputs = areas.select("aoi_id", *[F.expr(e).alias(c) for c, e in GIVEN.items()])
    r = report.unified_report(spark, d, outputs=outputs)
    lines = report.report_lines(r).withColumnRenamed("aoi_id", "_id")
    j = r.join(lines, F.col("aoi_id") == F.col("_id"))
    dom = F.col("domains")
    return j.select(
        "aoi_id", F.col("ensemble.overall_alert_level").alias("alert_level"),
        F.array_join("ensemble.signals", "|").alias("signals"), "summary", "answer",
        F.size("automation.models_run").alias("n_models_run"),
        dom["drought_monitoring"]["category"]["alert_level"].alias("drought_level"),
        dom["weather_disaster"]["intensity"]["intensity"].alias("intensity"),
        dom["forest_health"]["alert"]["deforestation_alert_code"].alias("forest_code"),
        dom["urban_growth"]["urban_population"]["future_urban_population_millions"].alias("future_urban_population"))

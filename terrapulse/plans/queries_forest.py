"""Forest panel queries: windows, rules, snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forest as ff
from ..operators import panels
from ..sources import bindings
from . import oracle_views as ov
from .catalog import query

FOREST_COLS = ["state", "year", "forest_cover", "forest_pct", "ndvi", "forest_change_yoy",
               "ndvi_change_yoy", "forest_pct_change_yoy", "very_dense_change_yoy",
               "mod_dense_change_yoy", "open_forest_change_yoy", "crop_change_yoy",
               "forest_cover_3yr_avg", "ndvi_3yr_avg", "forest_pct_3yr_avg", "forest_cover_5yr_avg",
               "ndvi_5yr_avg", "dense_to_total_ratio", "open_to_total_ratio", "scrub_to_forest_ratio",
               "crop_to_forest_ratio", "cum_forest_change", "deforestation_streak", "streak_count",
               "alert_level", "future_ndvi", "future_forest_cover", "aqi_impact_score",
               "human_impact_score"]


def forest_features(spark, d):
    return panels.forest_features(bindings.state_panel(spark, d))


@query("forest_features", "W1 W3 W5 W6 W7 F13 F14 F15 F16 T1",
       sql=ov.with_(ov.FOREST_FEATURES) + "SELECT " + ", ".join(FOREST_COLS) + " FROM forest_features")
def q_forest_features(spark, d):
    return forest_features(spark, d).select(*FOREST_COLS)


@query("forest_alert_summary", "F14 A3",
       sql=ov.with_(ov.FOREST_FEATURES) + """
SELECT alert_level, COUNT(*) AS n_rows, COUNT(DISTINCT state) AS n_states,
       MIN(year) AS first_year, MAX(year) AS last_year
FROM forest_features GROUP BY alert_level""")
def q_forest_alert_summary(spark, d):
    return (forest_features(spark, d).groupBy("alert_level")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("state").alias("n_states"),
                 F.min("year").alias("first_year"), F.max("year").alias("last_year")))


SNAP_COLS = ["year", "forest_cover", "forest_pct", "ndvi", "forest_change_yoy",
             "forest_pct_change_yoy", "ndvi_change_yoy", "future_ndvi", "future_forest_cover"]


@query("forest_latest_snapshot", "A5 S17",
       sql=ov.with_(ov.FOREST_FEATURES) + "SELECT state, "
       + ", ".join(f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN year END) AS {c}" for c in SNAP_COLS)
       + " FROM forest_features GROUP BY state")
def q_forest_latest_snapshot(spark, d):
    return panels.latest_non_null(forest_features(spark, d).select("state", *SNAP_COLS), "state", "year")


@query("forest_extrapolation", "F27 J1 F42",
       sql=ov.with_(ov.FOREST_FEATURES) + """,
snap AS (SELECT state, arg_max(year, year) AS year,
           arg_max(forest_cover, CASE WHEN forest_cover IS NOT NULL THEN year END) AS forest_cover,
           arg_max(forest_pct, CASE WHEN forest_pct IS NOT NULL THEN year END) AS forest_pct,
           arg_max(ndvi, CASE WHEN ndvi IS NOT NULL THEN year END) AS ndvi,
           arg_max(forest_change_yoy, CASE WHEN forest_change_yoy IS NOT NULL THEN year END) AS forest_change_yoy,
           arg_max(forest_pct_change_yoy, CASE WHEN forest_pct_change_yoy IS NOT NULL THEN year END) AS forest_pct_change_yoy,
           arg_max(ndvi_change_yoy, CASE WHEN ndvi_change_yoy IS NOT NULL THEN year END) AS ndvi_change_yoy
         FROM forest_features GROUP BY state)
SELECT state,
  GREATEST(0.0, forest_cover + COALESCE(NULLIF(forest_change_yoy, 0.0), 0.0) * (2005 - year)) AS extrap_cover,
  GREATEST(0.0, forest_pct + COALESCE(NULLIF(forest_pct_change_yoy, 0.0), 0.0) * (2005 - year)) AS extrap_pct,
  ndvi AS ndvi_used,
  COALESCE(ndvi_change_yoy, 0.0) AS ndvi_change,
  CASE WHEN ndvi + COALESCE(ndvi_change_yoy, 0.0) > ndvi THEN 'improving' ELSE 'declining' END AS ndvi_trend,
  CASE WHEN COALESCE(NULLIF(forest_change_yoy, 0.0), 0.0) >= 0 THEN 'GAIN' ELSE 'LOSS' END AS cover_trend
FROM snap""")
def q_forest_extrapolation(spark, d):
    snap = panels.latest_non_null(
        forest_features(spark, d).select("state", "year", "forest_cover", "forest_pct", "ndvi",
                                         "forest_change_yoy", "forest_pct_change_yoy", "ndvi_change_yoy"),
        "state", "year")
    ex = ff.extrapolate_forest("forest_cover", "forest_pct", "forest_change_yoy", "forest_pct_change_yoy",
                               "year", F.lit(2005), "ndvi", None, "ndvi_change_yoy")
    out = snap.select("state", *[v.alias(k) for k, v in ex.items()],
                      F.coalesce(F.nullif(F.col("forest_change_yoy"), F.lit(0.0)), F.lit(0.0)).alias("_yoy"))
    return out.select("state", "extrap_cover", "extrap_pct", "ndvi_used", "ndvi_change",
                      ff.ndvi_trend(F.col("ndvi_used") + F.col("ndvi_change"), "ndvi_used").alias("ndvi_trend"),
                      ff.cover_trend("_yoy").alias("cover_trend"))


def _effects_full_sql() -> str:
    a = "alert_level"
    return ov.with_(ov.FOREST_FEATURES) + f"""
SELECT state, year,
  CASE WHEN aqi_impact_score > 150 THEN 'Very Poor (AQI 200-300 range)' WHEN aqi_impact_score > 100 THEN 'Poor (AQI 150-200 range)'
       WHEN aqi_impact_score > 50 THEN 'Moderate (AQI 100-150 range)' ELSE 'Good (AQI below 100)' END AS aqi_category,
  COALESCE(NULLIF(concat_ws('|',
    CASE WHEN ndvi < 0.25 THEN 'Severe heat stress due to loss of tree cover' END,
    CASE WHEN ndvi < 0.35 THEN 'Increased dust and particulate matter' END,
    CASE WHEN {a} >= 2 THEN 'Higher vector-borne disease risk (malaria, dengue)' END,
    CASE WHEN {a} >= 3 THEN 'Mental health impact from degraded environment' END,
    CASE WHEN forest_pct < 20 THEN 'Inadequate natural carbon sink — CO2 rising' END), ''), 'No major health risks detected') AS health_risks,
  COALESCE(NULLIF(concat_ws('|',
    CASE WHEN {a} >= 2 THEN 'Reduced rainfall interception → flash flood risk' END,
    CASE WHEN {a} >= 1 THEN 'Groundwater recharge declining' END,
    CASE WHEN ndvi < 0.3 THEN 'River siltation increasing — water quality declining' END,
    CASE WHEN (future_forest_cover - forest_cover) / (forest_cover + 1.0) * 100.0 < -5 THEN 'Watershed degradation accelerating' END), ''),
    'Water security maintained') AS water_risks,
  (future_forest_cover - forest_cover) / (forest_cover + 1.0) * 100.0 AS cover_change_pct,
  CASE WHEN {a} >= 2 THEN 'High carbon release' WHEN {a} = 1 THEN 'Moderate' ELSE 'Stable' END AS carbon_impact,
  COALESCE(NULLIF(concat_ws('|',
    CASE WHEN {a} >= 1 THEN 'Reduced timber and non-timber forest produce' END,
    CASE WHEN {a} >= 2 THEN 'Tribal & rural communities losing forest income' END,
    CASE WHEN {a} >= 2 THEN 'Soil erosion reducing agricultural productivity' END,
    CASE WHEN {a} >= 3 THEN 'Complete ecosystem collapse risk in affected areas' END), ''), 'Livelihoods not significantly impacted') AS livelihood,
  CASE WHEN {a} = 3 THEN 'Critical' WHEN {a} = 2 THEN 'High' WHEN {a} = 1 THEN 'Moderate' ELSE 'Low' END AS species_risk_level,
  CASE WHEN future_ndvi > ndvi THEN 'improving' ELSE 'declining' END AS ndvi_trend,
  CASE WHEN human_impact_score > 60 THEN 'High risk' WHEN human_impact_score > 40 THEN 'Moderate risk' ELSE 'Low risk' END AS human_risk
FROM forest_features WHERE future_forest_cover IS NOT NULL"""


@query("forest_effects_full", "F35 F34 F42", sql=_effects_full_sql())
def q_forest_effects_full(spark, d):
    f = forest_features(spark, d).where(F.col("future_forest_cover").isNotNull())
    e = ff.forest_effects_full("alert_level", "aqi_impact_score", "human_impact_score", "forest_pct", "ndvi",
                               "future_forest_cover", "forest_cover")
    x = f.select("state", "year", "future_ndvi", "ndvi", "human_impact_score", e.alias("e"))
    return x.select("state", "year", F.col("e.air_quality.category").alias("aqi_category"),
                    F.array_join("e.health.risks", "|").alias("health_risks"),
                    F.array_join("e.water.risks", "|").alias("water_risks"),
                    F.col("e.water.cover_change_pct").alias("cover_change_pct"),
                    F.col("e.climate.carbon_impact").alias("carbon_impact"),
                    F.array_join("e.livelihood.impacts", "|").alias("livelihood"),
                    F.col("e.biodiversity.species_risk_level").alias("species_risk_level"),
                    ff.ndvi_trend("future_ndvi", "ndvi").alias("ndvi_trend"),
                    ff.human_risk_band("human_impact_score").alias("human_risk"))

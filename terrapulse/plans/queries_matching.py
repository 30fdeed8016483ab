"""Matching, lookup and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import matching
from ..sources import bindings
from . import oracle_views as ov
from .catalog import query
from .queries_urban import MATCH_SQL, state_match


@query("state_matching", "J2 J3 J4 J5 J6",
       sql=ov.with_(ov.aoi_sql(), MATCH_SQL) + "SELECT aoi_id, aoi_name, matched_state, match_method FROM state_match")
def q_state_matching(spark, d):
    return state_match(spark, d).select("aoi_id", "aoi_name", "matched_state", "match_method")


def _codes_sql() -> str:
    codes = ov.values(dims.WEATHER_CODES, ["code", "label"])
    return ov.with_(ov.OBS) + f"""
SELECT CAST(o.humidity AS INTEGER) AS weathercode, COALESCE(w.label, 'Code ' || CAST(CAST(o.humidity AS INTEGER) AS VARCHAR)) AS condition,
       COUNT(*) AS n_obs
FROM obs o LEFT JOIN {codes} w ON CAST(o.humidity AS INTEGER) = w.code
GROUP BY 1, 2"""


@query("weather_code_labels", "J10", sql=_codes_sql())
def q_weather_code_labels(spark, d):
    o = bindings.obs(spark, d).select(F.col("humidity").cast("int").alias("weathercode"))
    return (o.groupBy("weathercode").agg(F.count(F.lit(1)).alias("n_obs"))
            .select("weathercode", matching.weather_label("weathercode").alias("condition"), "n_obs"))


ENC_COLS = ["state", "season", "soil_type", "irrigation", "crop"]


def _encoding_sql() -> str:
    parts = [f"SELECT '{c}' AS feature, value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INTEGER) AS idx "
             f"FROM (SELECT DISTINCT {c} AS value FROM crop_rows WHERE {c} IS NOT NULL)" for c in ENC_COLS]
    return ov.with_(ov.CROP_ROWS) + "\nUNION ALL\n".join(parts)


@query("category_encoding", "J11 M1", sql=_encoding_sql())
def q_category_encoding(spark, d):
    return matching.vocabularies(bindings.crop_rows(spark, d), ENC_COLS)


def _encode_rows_sql() -> str:
    return ov.with_(ov.CROP_ROWS, """
voc AS (SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT crop AS value FROM crop_rows WHERE state <> 'NATION_0'))""") + """
SELECT c.state, COALESCE(v.idx, 0) AS crop_idx, COUNT(*) AS n_rows
FROM crop_rows c LEFT JOIN voc v ON c.crop = v.value GROUP BY 1, 2"""


@query("category_encode_unseen", "J11", sql=_encode_rows_sql())
def q_category_encode_unseen(spark, d):
    """Vocabulary fitted without one state's rows, applied to all rows: unseen -> 0."""
    rows = bindings.crop_rows(spark, d)
    vocab = matching.vocabulary(rows.where(F.col("state") != "NATION_0"), "crop")
    enc = matching.encode(rows.select("state", "crop"), "crop", vocab, "crop_idx")
    return enc.groupBy("state", "crop_idx").agg(F.count(F.lit(1)).alias("n_rows"))


def _geo_sql() -> str:
    def lst(xs):
        return "(" + ", ".join(ov.sql_str(x) for x in xs) + ")"
    return ov.with_(ov.event_rows_sql()) + f"""
SELECT state, CAST(state IN {lst(dims.COASTAL_STATES)} AS INTEGER) AS is_coastal,
       CAST(state IN {lst(dims.HILLY_STATES)} AS INTEGER) AS is_hilly,
       CAST(state IN {lst(dims.DRY_STATES)} AS INTEGER) AS is_dry, COUNT(*) AS n_events
FROM event_rows GROUP BY 1, 2, 3, 4"""


def geo_flags(state_col: str = "state"):
    s = F.col(state_col)
    return {"is_coastal": s.isin(dims.COASTAL_STATES).cast("int"),
            "is_hilly": s.isin(dims.HILLY_STATES).cast("int"),
            "is_dry": s.isin(dims.DRY_STATES).cast("int")}


@query("state_geo_flags", "P5", sql=_geo_sql())
def q_state_geo_flags(spark, d):
    ev = bindings.event_rows(spark, d)
    flags = geo_flags()
    return (ev.select("state", *[v.alias(k) for k, v in flags.items()])
            .groupBy("state", "is_coastal", "is_hilly", "is_dry").agg(F.count(F.lit(1)).alias("n_events")))


def _alert_label_sql() -> str:
    labels = ov.values(dims.ALERT_LABELS, ["code", "label"])
    return ov.with_(ov.FOREST_FEATURES) + f"""
SELECT f.alert_level, COALESCE(l.label, CAST(f.alert_level AS VARCHAR)) AS alert_label, COUNT(*) AS n_rows
FROM forest_features f LEFT JOIN {labels} l ON f.alert_level = l.code GROUP BY 1, 2"""


@query("forest_alert_labels", "J10 J11", sql=_alert_label_sql())
def q_forest_alert_labels(spark, d):
    from .queries_forest import forest_features
    f = forest_features(spark, d)
    return (f.groupBy("alert_level").agg(F.count(F.lit(1)).alias("n_rows"))
            .select("alert_level", matching.alert_label("alert_level").alias("alert_label"), "n_rows"))

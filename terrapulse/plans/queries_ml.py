"""Model queries.

Growing trees isn't SQL; what SQL can state of a training run is checked: which models there
are, how many rows each was tested on, and that every metric lies in its range. What
a fitted model says is: its node table is published to the shared folder (``catalog.PUBLISHED``
in the SQL below), and SQL walks the trees on its own features.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from .. import dims
from ..ml import domains, models, nodes
from ..ml.split import stratified_split
from . import oracle_views as ov
from .catalog import PUBLISHED, query
from .queries_climate import DROUGHT_SQL, WEEKLY_SQL
from .queries_urban import urban_features_sql

READY = dims.MODEL_NAMES + ["spei_model"]


def _eval(spark, d, domain):
    """(model, kind, target, n_test, in_range) from the stored metric table."""
    m = domains.trained(spark, d, domain)["_metrics"]
    ok = F.when(F.col("kind") == "rf_classifier", F.col("accuracy").between(0, 1)).otherwise(
        (F.col("mae") >= 0) & (F.coalesce(F.col("r2"), F.lit(0.0)) <= 1))
    return m.select("model", "kind", "target", "n_test", ok.alias("in_range"))


def _eval_sql(views: str, rows: str, domain: str) -> str:
    """Held-out rows of every target: round(n / 5) a class, or the ceiling of a fifth."""
    parts = []
    for t in domains.DOMAINS[domain][4]:
        label = {"crop_idx": "crop", "event_idx": "event_type", "category_idx": "category"}.get(t.label, t.label)
        sized = f"SELECT {label} AS cls, COUNT(*) AS n FROM {rows} WHERE {label} IS NOT NULL GROUP BY 1"
        count = "SUM(CAST(ROUND(n * 0.2) AS BIGINT))" if t.stratified else "CAST(CEIL(SUM(n) * 0.2) AS BIGINT)"
        parts.append(f"SELECT '{t.name}' AS model, '{t.kind}' AS kind, '{t.label}' AS target, "
                     f"CAST({count} AS BIGINT) AS n_test, TRUE AS in_range FROM ({sized})")
    return views + " UNION ALL ".join(parts)


FOREST_TRAINING = ov.FOREST_FEATURES + """,
forest_training AS (SELECT * FROM forest_features WHERE forest_change_yoy IS NOT NULL AND future_ndvi IS NOT NULL
                    AND future_forest_cover IS NOT NULL)"""


def _drought_views() -> str:
    return ov.with_(ov.OBS, WEEKLY_SQL, f"""
drought_rows AS (SELECT s.*, CAST(w.precip_week < 50 AND round(s.spei, 4) <= -1.0 AS DOUBLE) AS status
                 FROM ({DROUGHT_SQL}) s JOIN weekly_weather w USING (location_id, week))""")


@query("crop_model_eval", "M1 M3 M4 A9 A10 M12 S17", sql=_eval_sql(ov.with_(ov.CROP_ROWS), "crop_rows", "crop"))
def q_crop_model_eval(spark, d):
    return _eval(spark, d, "crop")


@query("weather_model_eval", "M2 M3 M5 A10 M12", sql=_eval_sql(ov.with_(ov.event_rows_sql()), "event_rows", "weather"))
def q_weather_model_eval(spark, d):
    return _eval(spark, d, "weather")


@query("drought_model_eval", "M3 M6 A10 M12", sql=_eval_sql(_drought_views(), "drought_rows", "drought"))
def q_drought_model_eval(spark, d):
    return _eval(spark, d, "drought")


@query("forest_model_eval", "M3 M7 A10 A11 M12", sql=_eval_sql(ov.with_(FOREST_TRAINING), "forest_training", "forest"))
def q_forest_model_eval(spark, d):
    return _eval(spark, d, "forest")


@query("urban_model_eval", "M2 M8 A10 M12", sql=_eval_sql(
    urban_features_sql(), "(SELECT * FROM urban_features WHERE future_population IS NOT NULL"
    " AND future_urb_rate IS NOT NULL AND future_infra_pressure IS NOT NULL)", "urban"))
def q_urban_model_eval(spark, d):
    return _eval(spark, d, "urban")


def _nodes_sql(domain: str, model: str) -> str:
    return f"nodes AS (SELECT * FROM read_parquet('{PUBLISHED}/{domain}/*.parquet') WHERE model = '{model}')"


@query("crop_feature_importances", "A12", sql="WITH " + _nodes_sql("crop", "crop_yield_predictor") + f""",
g AS (SELECT tree, feature, SUM(gain * n) AS g FROM nodes WHERE "left" >= 0 GROUP BY ALL),
s AS (SELECT feature, g / SUM(g) OVER (PARTITION BY tree) AS s FROM g),
f AS (SELECT feature, SUM(s) AS s FROM s GROUP BY feature),
i AS (SELECT feature, COALESCE(s, 0) / SUM(s) OVER () AS importance FROM (SELECT unnest({domains.CROP_FEATURES}) AS feature) LEFT JOIN f USING (feature))
SELECT feature, ROUND(importance, 9) AS importance FROM i ORDER BY i.importance DESC, feature LIMIT 10""")
def q_crop_feature_importances(spark, d):
    """The ten features that the crop model's trees gain most by."""
    f = domains.trained(spark, d, "crop")
    domains.publish(spark, f, "crop")
    top = nodes.importances(f["_nodes"].where("model = 'crop_yield_predictor'"), domains.CROP_FEATURES)
    return top.orderBy(F.desc("importance"), "feature").limit(10).select("feature", F.round("importance", 9).alias("importance"))


@query("model_readiness", "S18", sql="SELECT model, TRUE AS ready FROM "
       + ov.values([(n,) for n in READY], ["model"]))
def q_model_readiness(spark, d):
    """Every model of the registry, loaded from the store."""
    with ThreadPoolExecutor(max_workers=len(domains.DOMAINS)) as ex:  # domains without a run are trained side by side
        found = list(ex.map(lambda dom: domains.models_of(spark, d, dom), domains.DOMAINS))
    paths = {name: f["path"] for of_domain in found for name, f in of_domain.items()}
    return models.readiness(spark, READY, paths)


@query("stratified_split_sizes", "M3", sql=ov.with_(ov.CROP_ROWS) + """
SELECT crop, COUNT(*) AS n_rows, CAST(ROUND(COUNT(*) * 0.2) AS BIGINT) AS n_test, SUM(n) AS sum_n
FROM crop_rows GROUP BY crop""")
def q_stratified_split_sizes(spark, d):
    """Split sizes with a feature column kept: no row is lost or drawn twice."""
    from ..sources import bindings
    rows = bindings.crop_rows(spark, d)
    s = stratified_split(rows, "crop", ["l_orderkey", "l_linenumber"])
    return s.groupBy("crop").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_test").cast("long").alias("n_test"),
                                 F.sum("n").alias("sum_n"))


def _forest_scores_sql() -> str:
    names = domains.FOREST_FEATURES
    values = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0)" for c in names)
    return "WITH RECURSIVE " + ov.FOREST_FEATURES + f""",
{_nodes_sql("forest", "forest_alert_model")},
enc AS (SELECT state, ROW_NUMBER() OVER (ORDER BY state) - 1 AS state_enc FROM (SELECT DISTINCT state FROM forest_features)),
latest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY state ORDER BY year DESC) AS rn FROM forest_features) WHERE rn = 1),
vals AS (SELECT state, unnest({names}) AS feature, unnest([{values}]) AS v FROM latest JOIN enc USING (state)),
walk(state, tree, node) AS (
  SELECT state, tree, 0 FROM latest, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.state, w.tree, CASE WHEN v.v <= n.threshold THEN n."left" ELSE n."right" END
  FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node JOIN vals v ON v.state = w.state AND v.feature = n.feature
  WHERE n."left" >= 0),
leaves AS (SELECT w.state, n.counts FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE n."left" < 0),
votes AS (SELECT state, unnest(range(len(counts))) AS code, unnest(counts) / list_sum(counts) AS p FROM leaves),
probs AS (SELECT state, code, SUM(p) / (SELECT COUNT(DISTINCT tree) FROM nodes) AS p FROM votes GROUP BY 1, 2)
SELECT state, CAST(year AS DOUBLE) AS year, CAST(code AS INTEGER) AS alert_code, ROUND(100 * p, 6) AS confidence
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY state ORDER BY ROUND(p, 12) DESC, code) AS r FROM probs) JOIN latest USING (state) WHERE r = 1"""


@query("forest_batch_scoring", "M9 M10", sql=_forest_scores_sql())
def q_forest_batch_scoring(spark, d):
    """The alert level of every state's latest year and its confidence, by the alert model's node table."""
    from ..operators import panels, topk
    fitted = domains.trained(spark, d, "forest")
    domains.publish(spark, fitted, "forest")
    data = domains.forest_rows(spark, d, fitted["_encoders"])
    latest = domains.forest_features_of(panels.latest_n(data, "state", "year", 1).drop("rank"))
    alert = fitted["_nodes"].where("model = 'forest_alert_model'")
    scored = nodes.score(latest, alert, domains.FOREST_FEATURES, "alert", classifier=True)
    code = topk.argmax(F.transform("alert_probs", lambda p: F.round(p, 12)))
    return scored.select("state", "year", code.alias("alert_code"),
                         F.round(topk.confidence_of("alert_probs", code), 6).alias("confidence"))

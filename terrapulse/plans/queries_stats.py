"""Aggregate, top-k and lookup queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import climate as fc
from ..operators import matching, panels, stats, topk
from ..sources import bindings
from ..sources.tables import table
from . import oracle_views as ov
from .catalog import query

N_CLASSES = len(dims.EVENT_CLASSES)


# T2 / F36 / M10 ----------------------------------------------------------------------
def event_probabilities(spark, d):
    """Per location: event-class count vector (event id mod 8), Laplace
    probabilities, state, season and anomalies, in one aggregate over events."""
    ev = table(spark, d, "events", "event_id", "user_id", "value", "props")
    k = bindings.props_k(F.col("props"))
    cls = F.pmod(F.col("event_id"), F.lit(N_CLASSES))
    g = ev.groupBy("user_id").agg(
        F.array(*[F.count_if(cls == i) for i in range(N_CLASSES)]).alias("counts"),
        (stats.exact_avg("value", 2) - F.lit(100.0)).alias("precip_anom"),
        (stats.exact_avg(F.lit(0.9) * k, 1) - F.lit(20.0)).alias("wind_anom"),
        (stats.exact_avg(F.lit(10.0) + F.col("value") % F.lit(40.0), 2) - F.lit(25.0)).alias("temp_anom"),
        (F.lit(1) + F.pmod(F.sum(k), F.lit(12))).cast("int").alias("month"))
    geo = F.broadcast(spark.createDataFrame(list(enumerate(bindings.GEO_STATES)), "state_idx INT, state STRING"))
    g = g.withColumn("state_idx", F.pmod(F.col("user_id"), F.lit(len(bindings.GEO_STATES))).cast("int"))
    g = g.join(geo, "state_idx").drop("state_idx")
    return g.select("*", topk.laplace_probs("counts").alias("probs"),
                    fc.weather_season("month").alias("season"))


def _event_probs_sql() -> str:
    geo = ov.values(list(enumerate(bindings.GEO_STATES)), ["state_idx", "state"])
    cls = ov.values(list(enumerate(dims.EVENT_CLASSES)), ["idx", "event"])
    lst = lambda xs: "(" + ", ".join(ov.sql_str(x) for x in xs) + ")"
    return f"""
ev AS (SELECT user_id, event_id % {N_CLASSES} AS idx, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
u AS (SELECT user_id, COUNT(*) AS n,
        CAST(SUM(CAST(value AS DECIMAL(20,2))) AS DOUBLE) / CAST(COUNT(value) AS DOUBLE) - 100.0 AS pa,
        CAST(SUM(CAST(0.9::DOUBLE * k AS DECIMAL(20,1))) AS DOUBLE) / CAST(COUNT(k) AS DOUBLE) - 20.0 AS wa,
        CAST(SUM(CAST(10.0 + value % 40.0 AS DECIMAL(20,2))) AS DOUBLE) / CAST(COUNT(value) AS DOUBLE) - 25.0 AS ta,
        CAST(1 + SUM(k) % 12 AS INTEGER) AS month
      FROM ev GROUP BY user_id),
u2 AS (SELECT u.*, g.state,
        CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Summer'
             WHEN month IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-Monsoon' END AS season
       FROM u JOIN {geo} g ON CAST(u.user_id % {len(bindings.GEO_STATES)} AS INTEGER) = g.state_idx),
cnt AS (SELECT user_id, idx, COUNT(*) AS c FROM ev GROUP BY 1, 2),
probs AS (SELECT u2.*, cl.idx, cl.event, CAST(COALESCE(cnt.c, 0) + 1 AS DOUBLE) / CAST(u2.n + {N_CLASSES} AS DOUBLE) AS p
          FROM u2 CROSS JOIN {cls} cl LEFT JOIN cnt ON cnt.user_id = u2.user_id AND cnt.idx = cl.idx),
boosted AS (SELECT *, p * CASE
    WHEN event = 'Cyclone' AND state IN {lst(dims.COASTAL_STATES)} AND season IN ('Monsoon', 'Post-Monsoon') AND wa > 10 THEN 2.5
    WHEN event = 'Landslide' AND state IN {lst(dims.HILLY_STATES)} AND pa > 50 THEN 2.2
    WHEN event = 'Heatwave' AND state IN {lst(dims.DRY_STATES)} AND season = 'Summer' AND ta > 3 THEN 2.0
    WHEN event = 'Drought' AND state IN {lst(dims.DRY_STATES)} AND season = 'Summer' AND pa < -30 THEN 2.0
    WHEN event = 'Flood' AND season = 'Monsoon' AND pa > 80 THEN 1.8
    WHEN event = 'Cloudburst' AND season = 'Monsoon' AND pa > 80 THEN 1.6
    WHEN event = 'Thunderstorm' AND wa > 15 AND pa > 30 THEN 1.7 ELSE 1.0 END AS adj FROM probs),
normed AS (SELECT *, adj / SUM(adj) OVER (PARTITION BY user_id) AS p2 FROM boosted)"""


@query("event_top3", "T2 F36 M10", sql="WITH " + _event_probs_sql().strip() + """
SELECT user_id AS location_id, rnk, event, p2 * 100.0 AS confidence FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY p2 DESC, event) AS INTEGER) AS rnk FROM normed)
WHERE rnk <= 3""")
def q_event_top3(spark, d):
    g = event_probabilities(spark, d)
    adj = topk.boost_event_probs("probs", "state", "season", "precip_anom", "wind_anom", "temp_anom")
    top = g.select("user_id", topk.top_k(adj, dims.EVENT_CLASSES, 3).alias("top"))
    ex = top.select("user_id", F.posexplode("top").alias("pos", "t"))
    return ex.select(F.col("user_id").alias("location_id"), (F.col("pos") + 1).cast("int").alias("rnk"),
                     F.col("t.label").alias("event"), (F.col("t.p") * F.lit(100.0)).alias("confidence"))


@query("predicted_class_confidence", "M10 T2", sql="WITH " + _event_probs_sql().strip() + """
SELECT user_id AS location_id, idx AS predicted_code, event AS predicted_event, p * 100.0 AS confidence FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY p DESC, idx) AS rn FROM probs) WHERE rn = 1""")
def q_predicted_class_confidence(spark, d):
    g = event_probabilities(spark, d)
    code = topk.argmax("probs")
    labels = F.array(*[F.lit(x) for x in dims.EVENT_CLASSES])
    return g.select(F.col("user_id").alias("location_id"), code.alias("predicted_code"),
                    F.element_at(labels, code + 1).alias("predicted_event"),
                    topk.confidence_of("probs", code).alias("confidence"))


# A3 / A4 ----------------------------------------------------------------------------------
@query("dataset_profile", "A3", sql=ov.with_(ov.event_rows_sql()) + """
SELECT COUNT(*) AS n_rows, 10 AS n_columns, COUNT(DISTINCT state) AS n_distinct_state,
       COUNT(DISTINCT event_type) AS n_distinct_event_type, MIN(year(event_date)) AS min_year, MAX(year(event_date)) AS max_year
FROM event_rows""")
def q_dataset_profile(spark, d):
    e = bindings.event_rows(spark, d)
    p = stats.profile(e.withColumn("year", F.year("event_date")), ["state", "event_type"], "year")
    return p.withColumn("n_columns", F.lit(len(e.columns)))


@query("state_suggestions", "A4", sql=ov.with_(ov.event_rows_sql()) + """
SELECT string_agg(state, ', ' ORDER BY first_id, state) AS suggestions FROM (
  SELECT state, MIN(event_id) AS first_id FROM event_rows GROUP BY state ORDER BY first_id, state LIMIT 10)""")
def q_state_suggestions(spark, d):
    return stats.first_distinct(bindings.event_rows(spark, d), "state", "event_id", 10)


# A6 / A7 / P7 / F53 -------------------------------------------------------------------------
@query("crop_lookup", "A6 A7 P7 F53", sql=ov.with_(ov.CROP_ROWS, """
soil AS (SELECT state, soil_type FROM (SELECT state, soil_type, ROW_NUMBER() OVER (PARTITION BY state ORDER BY COUNT(*) DESC, soil_type) AS r
         FROM crop_rows GROUP BY state, soil_type) WHERE r = 1)""", """
crop AS (SELECT state, crop FROM (SELECT state, crop, ROW_NUMBER() OVER (PARTITION BY state ORDER BY COUNT(*) DESC, crop) AS r
         FROM crop_rows GROUP BY state, crop) WHERE r = 1)""", """
yl AS (SELECT state, AVG(crop_yield) AS mean_yield FROM crop_rows
       WHERE regexp_matches(state, '(?i)nation_1')
       GROUP BY state)""") + """
SELECT yl.state, yl.mean_yield, soil.soil_type AS top_soil, crop.crop AS top_crop,
  'In ' || yl.state || ' the most common soil is ' || soil.soil_type || ' and the most common crop is ' || crop.crop AS answer
FROM yl JOIN soil ON yl.state = soil.state JOIN crop ON yl.state = crop.state""")
def q_crop_lookup(spark, d):
    rows = bindings.crop_rows(spark, d).where(F.col("state").rlike("(?i)nation_1"))
    # one scan: a (state, soil, crop) pre-aggregate feeds both modes and the mean
    pre = rows.groupBy("state", "soil_type", "crop").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("crop_yield").alias("_sy"), F.count("crop_yield").alias("_cy"))
    soil = stats.mode_by(pre, "state", "soil_type", "top_soil", count_col="_n")
    crop = stats.mode_by(pre, "state", "crop", "top_crop", count_col="_n")
    yl = pre.groupBy("state").agg((F.sum("_sy") / F.sum("_cy")).alias("mean_yield"))
    out = yl.join(soil, "state").join(crop, "state")
    return out.select("state", "mean_yield", "top_soil", "top_crop",
                      F.format_string("In %s the most common soil is %s and the most common crop is %s",
                                      "state", "top_soil", "top_crop").alias("answer"))


def _dataset_answers_sql() -> str:
    from .queries_climate import DROUGHT_SQL, WEEKLY_SQL
    from .queries_urban import urban_features_sql
    note = ("CASE WHEN spei < -1.0 THEN 'Below -1.0 indicates drought conditions.' "
            "ELSE 'Near-normal moisture conditions on average.' END")
    first10 = "(SELECT string_agg(state, ', ' ORDER BY state) FROM (SELECT DISTINCT state FROM {t} ORDER BY state LIMIT 10))"
    return urban_features_sql() + ", " + ",".join(x.strip() for x in (ov.STATE_PANEL, ov.CROP_ROWS, ov.OBS, WEEKLY_SQL, f"""
asked AS (SELECT n_name AS q FROM nation UNION ALL SELECT r_name FROM region)""", """
fo AS (SELECT q, arg_max(forest_cover, (state, year)) AS area, arg_max(forest_pct, (state, year)) AS pct
       FROM asked LEFT JOIN state_panel ON contains(lower(state), lower(q)) GROUP BY q)""", """
hits AS (SELECT q, crop, soil_type, crop_yield FROM asked JOIN crop_rows ON contains(lower(state), lower(q)))""", """
top_crop AS (SELECT q, crop FROM (SELECT q, crop, ROW_NUMBER() OVER (PARTITION BY q ORDER BY COUNT(*) DESC, crop) AS r FROM hits GROUP BY q, crop) WHERE r = 1)""", """
top_soil AS (SELECT q, soil_type FROM (SELECT q, soil_type, ROW_NUMBER() OVER (PARTITION BY q ORDER BY COUNT(*) DESC, soil_type) AS r FROM hits GROUP BY q, soil_type) WHERE r = 1)""", """
yields AS (SELECT q, round(AVG(crop_yield), 2) AS y FROM hits GROUP BY q)""", f"""
dr AS (SELECT round(s.spei, 3) AS spei, round(t.temp, 2) AS temp FROM (SELECT AVG(spei) AS spei FROM ({DROUGHT_SQL})) s
       CROSS JOIN (SELECT AVG(avg_temp) AS temp FROM weekly_weather) t)""", """
years AS (SELECT country, string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) AS ys, MAX(year) AS hi FROM national_series GROUP BY country)""", """
po AS (SELECT y.country, y.ys, y.hi + d.i AS req, u.population_m, n.birth_rate, u.death_rate, u.urbanization_rate
       FROM years y CROSS JOIN range(0, 2) d(i) LEFT JOIN urban_features u ON u.country = y.country AND u.year = y.hi + d.i
       LEFT JOIN national_series n ON n.country = y.country AND n.year = y.hi + d.i)""")) + f"""
SELECT 'forest' AS topic, q AS asked, CASE WHEN area IS NOT NULL THEN
    '**Forest cover data for ' || q || '**' || chr(10) || '• Total recorded forest area: **' || round(area, 2)::VARCHAR || ' km²**' || chr(10)
    || '• Forest as % of geographical area: **' || round(pct, 2)::VARCHAR || '%**'
  ELSE 'No forest data found for **' || q || '**. Available states include: ' || {first10.format(t="state_panel")} || '.' END AS answer FROM fo
UNION ALL SELECT 'crop', a.q, CASE WHEN crop IS NOT NULL THEN
    '**Crop data for ' || a.q || '**' || chr(10) || '• Most common crop: **' || crop || '**' || chr(10)
    || '• Predominant soil type: **' || soil_type || '**' || chr(10) || '• Average historical yield: **' || y::VARCHAR || ' kg/hectare**'
  ELSE 'No crop data found for **' || a.q || '**. Available states: ' || {first10.format(t="crop_rows")} || '.' END
FROM asked a LEFT JOIN top_crop USING (q) LEFT JOIN top_soil USING (q) LEFT JOIN yields USING (q)
UNION ALL SELECT 'drought', '', '**Drought assessment**' || chr(10)
    || '• Average SPEI (Standardised Precipitation-Evapotranspiration Index): **' || spei::VARCHAR || '**' || chr(10)
    || '  — Interpretation: ' || {note} || chr(10) || '• Average recorded temperature: **' || temp::VARCHAR || '°C**' FROM dr
UNION ALL SELECT 'population', country || ' ' || req::VARCHAR, CASE WHEN population_m IS NOT NULL THEN
    '**Population data for ' || req::VARCHAR || '**' || chr(10) || '• Population: **' || round(population_m, 2)::VARCHAR || ' million**' || chr(10)
    || '• Birth rate: **' || coalesce(round(birth_rate, 2)::VARCHAR, 'nan') || ' per 1,000**' || chr(10)
    || '• Death rate: **' || round(death_rate, 2)::VARCHAR || ' per 1,000**' || chr(10)
    || '• Urbanisation rate: **' || round(urbanization_rate, 2)::VARCHAR || '%**'
  ELSE 'No population data for **' || req::VARCHAR || '**. Available years: [' || ys || '].' END FROM po"""


@query("dataset_answers", "F53 F50 P7 A4 W10", sql=_dataset_answers_sql())
def q_dataset_answers(spark, d):
    """Forest, crop, drought and population answers, found or not, for every state and
    region name asked and for the last year of each series and the one after it."""
    from ..functions import text as ft
    from .queries_climate import q_drought_indicators, weekly
    from .queries_urban import urban_features
    asked = table(spark, d, "nation", "n_name").select(F.col("n_name").alias("q")).unionByName(
        table(spark, d, "region", "r_name").select(F.col("r_name").alias("q")))
    panel = bindings.state_panel(spark, d).select("state", "year", "forest_cover", "forest_pct")
    hit = F.contains(F.lower("state"), F.lower("q"))
    ten = lambda rows: rows.select("state").distinct().orderBy("state").limit(10).agg(
        F.array_join(F.array_sort(F.collect_list("state")), ", ").alias("available"))
    last = F.max_by(F.struct("forest_cover", "forest_pct"), F.struct("state", "year")).alias("r")
    found = asked.join(panel, hit).groupBy("q").agg(last)
    forest = asked.join(found, "q", "left").crossJoin(ten(panel)).select(
        F.lit("forest").alias("topic"), F.col("q").alias("asked"),
        ft.forest_answer("q", F.round("r.forest_cover", 2), F.round("r.forest_pct", 2), "available").alias("answer"))
    rows = bindings.crop_rows(spark, d)
    pre = rows.groupBy("state", "soil_type", "crop").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("crop_yield").alias("_sy"), F.count("crop_yield").alias("_cy"))
    hits = asked.join(pre, hit)
    means = hits.groupBy("q").agg(F.round(F.sum("_sy") / F.sum("_cy"), 2).alias("y"))
    crops = (asked.join(stats.mode_by(hits, "q", "crop", "top_crop", count_col="_n"), "q", "left")
             .join(stats.mode_by(hits, "q", "soil_type", "top_soil", count_col="_n"), "q", "left").join(means, "q", "left"))
    crop = crops.crossJoin(ten(pre)).select(F.lit("crop").alias("topic"), F.col("q").alias("asked"), ft.crop_answer(
        "q", "top_crop", "top_soil", "y", "available").alias("answer"))
    spei = q_drought_indicators(spark, d).agg(F.round(F.avg("spei"), 3).alias("spei"))
    temp = weekly(spark, d).agg(F.round(F.avg("avg_temp"), 2).alias("temp"))
    drought = spei.crossJoin(temp).select(F.lit("drought").alias("topic"), F.lit("").alias("asked"),
                                          ft.drought_answer("spei", "temp").alias("answer"))
    series = bindings.national_series(spark, d)
    years = series.groupBy("country").agg(F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string")), ", ")
                                          .alias("ys"), F.max("year").alias("hi"))
    req = years.select("country", "ys", F.explode(F.array(F.col("hi"), F.col("hi") + 1)).alias("year"))
    facts = urban_features(spark, d).select("country", "year", "population_m", "death_rate", "urbanization_rate")
    births = series.select("country", "year", "birth_rate")
    people = req.join(facts, ["country", "year"], "left").join(births, ["country", "year"], "left")
    population = people.select(
        F.lit("population").alias("topic"), F.concat_ws(" ", "country", F.col("year").cast("string")).alias("asked"),
        ft.population_answer("year", F.round("population_m", 2), F.round("birth_rate", 2), F.round("death_rate", 2),
                             F.round("urbanization_rate", 2), "ys").alias("answer"))
    return forest.unionByName(crop).unionByName(drought).unionByName(population)


def _year_lookup_sql() -> str:
    return ov.with_(ov.STATE_PANEL, """
req AS (SELECT DISTINCT state, year + 3 AS req_year FROM state_panel)""", """
avail AS (SELECT state, string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) AS years FROM state_panel GROUP BY state)""") + """
SELECT r.state, r.req_year, p.year IS NOT NULL AS found,
  CASE WHEN p.year IS NOT NULL THEN 'Forest cover share for ' || r.state || ' in ' || CAST(r.req_year AS VARCHAR) || ' recorded'
       ELSE 'No data for ' || r.state || ' in ' || CAST(r.req_year AS VARCHAR) || '. Available years: ' || a.years END AS answer
FROM req r LEFT JOIN state_panel p ON r.state = p.state AND r.req_year = p.year JOIN avail a ON r.state = a.state"""


@query("year_lookup", "P6 T3 W10", sql=_year_lookup_sql())
def q_year_lookup(spark, d):
    panel = bindings.state_panel(spark, d).select("state", "year")
    req = panel.select("state", (F.col("year") + 3).alias("req_year")).distinct()
    avail = panel.groupBy("state").agg(F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ", ")
                                       .alias("years"))
    hit = panel.select("state", F.col("year").alias("req_year"), F.lit(True).alias("_hit"))
    j = req.join(hit, ["state", "req_year"], "left").join(avail, "state")
    found = F.col("_hit").isNotNull()
    return j.select("state", "req_year", found.alias("found"),
                    F.when(found, F.format_string("Forest cover share for %s in %d recorded", "state", "req_year"))
                    .otherwise(F.format_string("No data for %s in %d. Available years: %s", "state", "req_year", "years"))
                    .alias("answer"))


# A9 / A10 / A11 ---------------------------------------------------------------------------
@query("class_weights", "A9", sql=ov.with_(ov.CROP_ROWS) + """
SELECT crop, COUNT(*) AS n_class, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () * COUNT(*) AS DOUBLE) AS weight
FROM crop_rows GROUP BY crop""")
def q_class_weights(spark, d):
    return stats.class_weights(bindings.crop_rows(spark, d), "crop")


def _state_crops(rows):
    """One (state, crop) pre-aggregate (states x crops rows): counts and yield sums."""
    return rows.groupBy("state", "crop").agg(F.count(F.lit(1)).alias("_n"), F.sum("crop_yield").alias("_sy"),
                                             F.count("crop_yield").alias("_cy"))


def baseline_counts(spark, d):
    """(crop, pred_crop, n): how often the state's majority crop meets each crop, from one scan."""
    pre = _state_crops(bindings.crop_rows(spark, d))
    maj = stats.mode_by(pre, "state", "crop", "pred_crop", count_col="_n")
    return pre.join(maj, "state").select("crop", "pred_crop", F.col("_n").alias("n"))


def baseline_predictions(spark, d):
    """Majority crop of the state as the class prediction and the crop's mean
    yield as the regression prediction (a deterministic baseline model)."""
    rows = bindings.crop_rows(spark, d)
    pre = _state_crops(rows)
    maj = stats.mode_by(pre, "state", "crop", "pred_crop", count_col="_n")
    mean = pre.groupBy("crop").agg((F.sum("_sy") / F.sum("_cy")).alias("pred_yield"))
    return rows.join(maj, "state").join(mean, "crop")


BASE_SQL = ov.with_(ov.CROP_ROWS, """
maj AS (SELECT state, crop AS pred_crop FROM (SELECT state, crop, ROW_NUMBER() OVER (PARTITION BY state ORDER BY COUNT(*) DESC, crop) AS r
        FROM crop_rows GROUP BY state, crop) WHERE r = 1)""", """
mean AS (SELECT crop, AVG(crop_yield) AS pred_yield FROM crop_rows GROUP BY crop)""", """
pred AS (SELECT c.*, maj.pred_crop, mean.pred_yield FROM crop_rows c JOIN maj ON c.state = maj.state JOIN mean ON c.crop = mean.crop)""")


@query("prediction_metrics", "A10", sql=BASE_SQL + """
SELECT AVG(CAST(crop = pred_crop AS DOUBLE)) AS accuracy, AVG(abs(crop_yield - pred_yield)) AS mae,
  1.0 - SUM(pow(crop_yield - pred_yield, 2)) / SUM(pow(crop_yield - (SELECT AVG(crop_yield) FROM pred), 2)) AS r2,
  COUNT(*) AS n FROM pred""")
def q_prediction_metrics(spark, d):
    p = baseline_predictions(spark, d).withColumn("hit", (F.col("crop") == F.col("pred_crop")).cast("double"))
    return stats.regression_metrics(p, "crop_yield", "pred_yield", F.avg("hit").alias("accuracy"))


@query("classification_report", "A11", sql=BASE_SQL + """,
tp AS (SELECT crop AS cls, COUNT(*) AS support, COUNT(*) FILTER (WHERE crop = pred_crop) AS tp FROM pred GROUP BY crop),
pc AS (SELECT pred_crop AS cls, COUNT(*) AS pred_n FROM pred GROUP BY pred_crop),
per AS (SELECT COALESCE(tp.cls, pc.cls) AS cls, COALESCE(support, 0) AS support, COALESCE(tp, 0) AS tp, COALESCE(pred_n, 0) AS pred_n
        FROM tp FULL JOIN pc ON tp.cls = pc.cls),
per2 AS (SELECT cls, support, tp, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
per3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per2)
SELECT cls, support, precision, recall, f1 FROM per3
UNION ALL SELECT 'accuracy', SUM(support), SUM(tp) / SUM(support), SUM(tp) / SUM(support), SUM(tp) / SUM(support) FROM per3
UNION ALL SELECT 'macro avg', SUM(support), AVG(precision), AVG(recall), AVG(f1) FROM per3
UNION ALL SELECT 'weighted avg', SUM(support), SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                 SUM(f1 * support) / SUM(support) FROM per3""")
def q_classification_report(spark, d):
    return stats.classification_report(baseline_counts(spark, d), "crop", "pred_crop", "n")


# A13 - A18 --------------------------------------------------------------------------------
@query("forest_cover_trend", "A13", sql=ov.with_(ov.STATE_PANEL) + """
SELECT r.r_name AS region, p.year, SUM(p.forest_cover) AS total_cover, COUNT(*) AS n_states
FROM state_panel p JOIN nation n ON p.state = n.n_name JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY 1, 2""")
def q_forest_cover_trend(spark, d):
    p = bindings.state_panel(spark, d)
    n = table(spark, d, "nation", "n_name", "n_regionkey")
    r = table(spark, d, "region", "r_regionkey", "r_name")
    j = p.join(n, p.state == n.n_name).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region"), "year").agg(
        F.sum("forest_cover").alias("total_cover"), F.count(F.lit(1)).alias("n_states"))


def _drought_freq_sql() -> str:
    from .queries_climate import DROUGHT_SQL, WEEKLY_SQL
    return ov.with_(ov.OBS, WEEKLY_SQL) + f"""
SELECT month, category, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY month) AS share
FROM ({DROUGHT_SQL}) GROUP BY 1, 2"""


@query("drought_frequency", "A14", sql=_drought_freq_sql())
def q_drought_frequency(spark, d):
    from .queries_climate import q_drought_indicators
    dr = q_drought_indicators(spark, d)
    cnt = dr.groupBy("month", "category").agg(F.count(F.lit(1)).alias("n"))
    return cnt.select("month", "category", "n",
                      (F.col("n") / F.sum("n").over(Window.partitionBy("month"))).alias("share"))


def _urb_proj_sql() -> str:
    from .queries_urban import urban_features_sql
    return urban_features_sql() + """
SELECT country, MIN(year) AS first_year, MAX(year) AS last_year, AVG(urbanization_rate) AS avg_urbanization_rate,
       MAX(future_urb_rate) AS max_future_urb_rate,
       arg_max(future_urban_pop, CASE WHEN future_urban_pop IS NOT NULL THEN year END) AS last_future_urban_pop
FROM urban_features GROUP BY country"""


@query("urbanization_projection", "A15", sql=_urb_proj_sql())
def q_urbanization_projection(spark, d):
    from .queries_urban import urban_features
    u = urban_features(spark, d)
    return u.groupBy("country").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.avg("urbanization_rate").alias("avg_urbanization_rate"),
        F.max("future_urb_rate").alias("max_future_urb_rate"),
        F.max_by("future_urban_pop", F.when(F.col("future_urban_pop").isNotNull(), F.col("year")))
        .alias("last_future_urban_pop"))


@query("npk_by_state", "A16", sql=ov.with_(ov.CROP_ROWS) + """
SELECT state, AVG(n) AS avg_n, stddev_samp(n) AS std_n, quantile_cont(n, 0.5) AS median_n,
       AVG(p) AS avg_p, quantile_cont(p, 0.5) AS median_p, AVG(k) AS avg_k, quantile_cont(k, 0.5) AS median_k
FROM crop_rows GROUP BY state""")
def q_npk_by_state(spark, d):
    rows = bindings.crop_rows(spark, d)
    dist = stats.distribution_by_key(rows, "state", ["n", "p", "k"], 0.5)
    wide = dist.groupBy("state").pivot("metric", ["n", "p", "k"]).agg(
        F.first("mean").alias("avg"), F.first("std").alias("std"), F.first("quantile").alias("median"))
    return wide.select("state", F.col("n_avg").alias("avg_n"), F.col("n_std").alias("std_n"),
                       F.col("n_median").alias("median_n"), F.col("p_avg").alias("avg_p"),
                       F.col("p_median").alias("median_p"), F.col("k_avg").alias("avg_k"),
                       F.col("k_median").alias("median_k"))


@query("yield_by_state", "A16", sql=ov.with_(ov.CROP_ROWS) + """
SELECT state, ROUND(AVG(crop_yield), 6) AS avg_yield, ROUND(stddev_samp(crop_yield), 6) AS std_yield,
       ROUND(quantile_cont(crop_yield, 0.9), 6) AS yield_p90
FROM crop_rows GROUP BY state""")
def q_yield_by_state(spark, d):
    """A measure of almost as many values as rows."""
    dist = stats.distribution_by_key(bindings.crop_rows(spark, d), "state", ["crop_yield"], 0.9)
    return dist.select("state", F.round("mean", 6).alias("avg_yield"), F.round("std", 6).alias("std_yield"),
                       F.round("quantile", 6).alias("yield_p90"))


@query("irrigation_breakdown", "A17", sql=ov.with_(ov.CROP_ROWS) + """
SELECT irrigation, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM crop_rows GROUP BY irrigation""")
def q_irrigation_breakdown(spark, d):
    return stats.share_breakdown(bindings.crop_rows(spark, d), "irrigation")


@query("seasonal_yield", "A18", sql=ov.with_(ov.CROP_ROWS) + """
SELECT season, crop, AVG(crop_yield) AS avg_yield, COUNT(*) AS n_rows
FROM crop_rows GROUP BY ROLLUP (season, crop)""")
def q_seasonal_yield(spark, d):
    rows = bindings.crop_rows(spark, d)
    return rows.rollup("season", "crop").agg(F.avg("crop_yield").alias("avg_yield"),
                                             F.count(F.lit(1)).alias("n_rows"))


# T4 ---------------------------------------------------------------------------------------
def _levels_sql() -> str:
    cities = "(" + ", ".join(ov.sql_str(c.lower()) for c, _ in dims.CITY_URB_RATES) + ")"
    from .queries_urban import MATCH_SQL
    return ov.with_(ov.aoi_sql(), MATCH_SQL, f"""
lv AS (SELECT aoi_id, 'Area' AS level, aoi_name AS q FROM state_match WHERE contains(lower(aoi_name), ' area')
       UNION ALL SELECT aoi_id, 'City', aoi_name FROM state_match WHERE lower(aoi_name) IN {cities}
       UNION ALL SELECT aoi_id, 'State', matched_state FROM state_match WHERE match_method <> 'fallback'
       UNION ALL SELECT aoi_id, 'Location', aoi_name FROM state_match WHERE NOT contains(lower(aoi_name), ' area')
            AND lower(aoi_name) NOT IN {cities} AND match_method = 'fallback')""") + """
SELECT level, COUNT(*) AS n_queries, COUNT(DISTINCT aoi_id) AS n_aoi FROM lv GROUP BY level"""


@query("multi_level_expansion", "T4", sql=_levels_sql())
def q_multi_level_expansion(spark, d):
    a = matching.with_state_match(bindings.aoi(spark, d), "aoi_name")
    low = F.lower("aoi_name")
    is_area = F.contains(low, F.lit(" area"))
    is_city = low.isin([c.lower() for c, _ in dims.CITY_URB_RATES])
    is_state = F.col("match_method") != "fallback"
    lv = F.array_compact(F.array(
        F.when(is_area, F.struct(F.lit("Area").alias("level"), F.col("aoi_name").alias("q"))),
        F.when(is_city, F.struct(F.lit("City").alias("level"), F.col("aoi_name").alias("q"))),
        F.when(is_state, F.struct(F.lit("State").alias("level"), F.col("matched_state").alias("q")))))
    lv = F.when(F.size(lv) == 0, F.array(F.struct(F.lit("Location").alias("level"), F.col("aoi_name").alias("q")))).otherwise(lv)
    ex = a.select("aoi_id", F.explode(lv).alias("l"))
    return ex.groupBy(F.col("l.level").alias("level")).agg(F.count(F.lit(1)).alias("n_queries"),
                                                          F.countDistinct("aoi_id").alias("n_aoi"))


# W11 --------------------------------------------------------------------------------------
@query("latest_events_per_user", "W11 W10", sql="""
SELECT user_id, event_id, event_type, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rnk FROM events) WHERE rnk <= 5""")
def q_latest_events_per_user(spark, d):
    ev = table(spark, d, "events", "user_id", "event_id", "event_type", "ts")
    top = panels.top_n_per_key(ev, "user_id", [("ts", True), ("event_id", True)], 5)
    return top.select("user_id", "event_id", "event_type", F.col("rank").cast("int").alias("rank"))


@query("first_reading_per_location", "W10", sql=ov.with_(ov.OBS) + """
SELECT location_id, event_id AS first_event_id, precip AS first_precip FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY ts, event_id) AS rn FROM obs) WHERE rn = 1""")
def q_first_reading_per_location(spark, d):
    o = bindings.obs(spark, d).select("location_id", "event_id", "precip", "ts")
    first = panels.top_n_per_key(o, "location_id", [("ts", False), ("event_id", False)], 1)
    return first.select("location_id", F.col("event_id").alias("first_event_id"), F.col("precip").alias("first_precip"))

"""Urbanization series queries (training-side features, serving-side features, needs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import urban as fu
from ..operators import matching, panels
from ..sources import bindings
from . import oracle_views as ov
from .catalog import query

SCORE_YEAR = 2025  # fixed "current year" so results are reproducible

URBAN_COLS = ["country", "year", "population_m", "growth_rate", "birth_rate", "death_rate",
              "world_population_m", "world_growth_rate", "years_since_1961", "pop_growth_abs",
              "pop_rolling_3yr", "pop_rolling_5yr", "growth_rate_change", "natural_increase_rate",
              "birth_rate_trend", "death_rate_trend", "world_pop_ratio", "india_world_growth_diff",
              "urbanization_rate", "urban_pop_m", "rural_pop_m", "urb_rate_change", "urban_rural_ratio",
              "infra_pressure_score", "school_pressure", "hospital_pressure", "road_pressure",
              "future_population", "future_urb_rate", "future_infra_pressure", "future_urban_pop",
              "future_growth_rate"]


def _anchor_sql() -> str:
    return ov.values([(y, r) for y, r in dims.URB_ANCHORS], ["year", "rate"])


def urban_features_sql() -> str:
    a = dims.URB_ANCHORS
    ffill = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY country ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        for c in panels.SERIES_COLS)
    return ov.with_(ov.national_series_sql(), f"""
uf0 AS (SELECT country, year, {ffill} FROM national_series)""", """
uf1 AS (SELECT *, year - 1961 AS years_since_1961,
    COALESCE(population_m - LAG(population_m) OVER w, 0.0) AS pop_growth_abs,
    AVG(population_m) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS pop_rolling_3yr,
    AVG(population_m) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pop_rolling_5yr,
    COALESCE(growth_rate - LAG(growth_rate) OVER w, 0.0) AS growth_rate_change,
    birth_rate - death_rate AS natural_increase_rate,
    AVG(birth_rate) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS birth_rate_trend,
    AVG(death_rate) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS death_rate_trend,
    population_m / world_population_m AS world_pop_ratio,
    growth_rate - world_growth_rate AS india_world_growth_diff
  FROM uf0 WINDOW w AS (PARTITION BY country ORDER BY year))""", f"""
seg AS (SELECT * FROM (SELECT year AS y0, rate AS r0, LEAD(year) OVER (ORDER BY year) AS y1,
                             LEAD(rate) OVER (ORDER BY year) AS r1 FROM {_anchor_sql()}) WHERE y1 IS NOT NULL)""", f"""
uf2 AS (SELECT uf1.*, CASE WHEN uf1.year <= {a[0][0]} THEN CAST({a[0][1]} AS DOUBLE)
                           WHEN uf1.year >= {a[-1][0]} THEN CAST({a[-1][1]} AS DOUBLE)
                           ELSE seg.r0 + CAST(uf1.year - seg.y0 AS DOUBLE) * (seg.r1 - seg.r0) / CAST(seg.y1 - seg.y0 AS DOUBLE) END AS urbanization_rate
  FROM uf1 LEFT JOIN seg ON uf1.year >= seg.y0 AND uf1.year < seg.y1)""", """
uf3 AS (SELECT *, population_m * urbanization_rate / 100.0 AS urban_pop_m FROM uf2)""", """
uf4 AS (SELECT *, population_m - urban_pop_m AS rural_pop_m,
    COALESCE(urbanization_rate - LAG(urbanization_rate) OVER (PARTITION BY country ORDER BY year), 0.0) AS urb_rate_change
  FROM uf3)""", """
uf5 AS (SELECT *, urban_pop_m / (rural_pop_m + 1.0) AS urban_rural_ratio,
    MAX(population_m) OVER (PARTITION BY country) AS mx_pop, MAX(urbanization_rate) OVER (PARTITION BY country) AS mx_urb,
    MAX(growth_rate) OVER (PARTITION BY country) AS mx_g, MAX(urban_pop_m) OVER (PARTITION BY country) AS mx_up
  FROM uf4)""", """
uf6 AS (SELECT * EXCLUDE (mx_pop, mx_urb, mx_g, mx_up),
    LEAST(GREATEST(population_m / mx_pop * 40.0 + urbanization_rate / mx_urb * 30.0 + growth_rate / mx_g * 20.0
                   + urban_pop_m / mx_up * 10.0, 0.0), 100.0) AS infra_pressure_score,
    LEAST(GREATEST(urban_pop_m / mx_up * 100.0, 0.0), 100.0) AS school_pressure,
    LEAST(GREATEST(urban_pop_m / mx_up * 90.0, 0.0), 100.0) AS hospital_pressure,
    LEAST(GREATEST(population_m / mx_pop * 100.0, 0.0), 100.0) AS road_pressure
  FROM uf5)""", """
urban_features AS (SELECT *,
    LEAD(population_m, 5) OVER w AS future_population, LEAD(urbanization_rate, 5) OVER w AS future_urb_rate,
    LEAD(infra_pressure_score, 5) OVER w AS future_infra_pressure, LEAD(urban_pop_m, 5) OVER w AS future_urban_pop,
    LEAD(growth_rate, 5) OVER w AS future_growth_rate
  FROM uf6 WINDOW w AS (PARTITION BY country ORDER BY year))""")


def urban_features(spark, d):
    return panels.urban_features(spark, bindings.national_series(spark, d))


@query("urban_features", "W2 W4 W8 W9 J9 F30 F31 A8",
       sql=urban_features_sql() + "SELECT " + ", ".join(URBAN_COLS) + " FROM urban_features")
def q_urban_features(spark, d):
    return urban_features(spark, d).select(*URBAN_COLS)


TRAIN_FEATURES = ["years_since_1961", "population_m", "growth_rate", "birth_rate", "death_rate",
                  "pop_growth_abs", "natural_increase_rate", "urbanization_rate", "infra_pressure_score"]


@query("urban_training_rows", "P3 P4 P2",
       sql=urban_features_sql() + "SELECT country, year, "
       + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in TRAIN_FEATURES)
       + ", future_population, future_urb_rate, future_infra_pressure FROM urban_features"
       " WHERE future_population IS NOT NULL AND future_urb_rate IS NOT NULL AND future_infra_pressure IS NOT NULL")
def q_urban_training_rows(spark, d):
    df = urban_features(spark, d).dropna(subset=["future_population", "future_urb_rate", "future_infra_pressure"])
    return df.fillna(0, subset=TRAIN_FEATURES).select(
        "country", "year", *TRAIN_FEATURES, "future_population", "future_urb_rate", "future_infra_pressure")


NEEDS_COLS = ["pressure_level", "new_schools", "new_hospitals", "new_road_km", "new_homes",
              "water_demand_ml", "urb_rate_change_f", "urban_growth_m"]


@query("urban_infra_needs", "F32 F33",
       sql=urban_features_sql() + """
SELECT country, year,
  CASE WHEN future_infra_pressure > 80 THEN 'CRITICAL' WHEN future_infra_pressure > 65 THEN 'HIGH'
       WHEN future_infra_pressure > 50 THEN 'MODERATE' ELSE 'LOW' END AS pressure_level,
  CAST(trunc((future_urban_pop - urban_pop_m) * 1000.0 * 20.0) AS BIGINT) AS new_schools,
  CAST(trunc((future_urban_pop - urban_pop_m) * 1000.0) AS BIGINT) AS new_hospitals,
  CAST(trunc((future_urban_pop - urban_pop_m) * 1000.0 * 2.5) AS BIGINT) AS new_road_km,
  CAST(trunc((future_urban_pop - urban_pop_m) * 1e6 / 4.5) AS BIGINT) AS new_homes,
  (future_urban_pop - urban_pop_m) * 135.0 * 365.0 / 1e6 AS water_demand_ml,
  future_urb_rate - urbanization_rate AS urb_rate_change_f,
  future_urban_pop - urban_pop_m AS urban_growth_m,
  concat_ws('|', 
     CASE WHEN future_urb_rate > 50 THEN 'Major GDP boost from urban manufacturing and services' END,
     CASE WHEN future_urb_rate > 40 THEN 'Rising formal employment opportunities' END,
     'Urban economy contribution estimated near ' || CAST(LEAST(85, CAST(trunc(future_urb_rate * 1.8) AS BIGINT)) AS VARCHAR) || '% of GDP'
     ) AS economic,
  concat_ws('|', 
     CASE WHEN future_infra_pressure > 70 THEN 'Housing shortage risk and slum expansion pressure' END,
     CASE WHEN future_infra_pressure > 60 THEN 'Public transport system under strain' END,
     'Rural-to-urban migration accelerating',
     CASE WHEN future_urb_rate > 50 THEN 'Demographic transition toward smaller urban households' END
     ) AS social,
  concat_ws('|', 
     CASE WHEN future_infra_pressure > 65 THEN 'Air quality deterioration risk' END,
     CASE WHEN future_infra_pressure > 70 THEN 'Water scarcity risk in dense urban zones' END,
     'Healthcare access likely improves for urban residents'
     ) AS health
FROM urban_features WHERE future_urban_pop IS NOT NULL""")
def q_urban_infra_needs(spark, d):
    df = urban_features(spark, d).where(F.col("future_urban_pop").isNotNull())
    needs = fu.infrastructure_needs("future_infra_pressure", "urban_pop_m", "future_urban_pop",
                                    "urbanization_rate", "future_urb_rate")
    eff = fu.urbanization_effects("urbanization_rate", "future_urb_rate", "future_infra_pressure")
    out = df.select("country", "year", needs.alias("n"), eff.alias("e"))
    return out.select("country", "year",
                      *[F.col(f"n.{c}").alias(c) for c in NEEDS_COLS if c != "urb_rate_change_f"],
                      F.col("n.urb_rate_change").alias("urb_rate_change_f"),
                      F.array_join("e.economic", "|").alias("economic"),
                      F.array_join("e.social", "|").alias("social"),
                      F.array_join("e.health", "|").alias("health"))


SCORE_COLS = ["aoi_id", "matched_state", "city_urb_rate", "state_urb_rate", "effective_urb_rate",
              "pop_m", "urb_rate", "birth_rate", "death_rate", "world_growth",
              "urban_pop_m", "rural_pop_m", "infra_pressure_score", "road_pressure"]


def urban_scoring_sql() -> str:
    nat = dims.NATIONAL_LATEST
    n = SCORE_YEAR - nat["year"]
    city = ov.values([(i, c.lower(), r) for i, (c, r) in enumerate(dims.CITY_URB_RATES)], ["ord", "name", "rate"])
    state = ov.values([(i, c.lower(), r) for i, (c, r) in enumerate(dims.STATE_URB_RATES)], ["ord", "name", "rate"])
    return ov.with_(ov.aoi_sql(), MATCH_SQL, f"""
cr AS (SELECT a.aoi_id, arg_min(c.rate, c.ord) AS rate FROM aoi a JOIN {city} c
       ON contains(lower(a.aoi_name), c.name) OR contains(c.name, lower(a.aoi_name)) GROUP BY a.aoi_id)""", f"""
sr AS (SELECT m.aoi_id, arg_min(s.rate, s.ord) AS rate FROM state_match m JOIN {state} s
       ON contains(lower(m.matched_state), s.name) OR contains(s.name, lower(m.matched_state)) GROUP BY m.aoi_id)""", f"""
ex AS (SELECT m.aoi_id, m.matched_state, cr.rate AS city_urb_rate, sr.rate AS state_urb_rate,
    {nat['population_m']}::DOUBLE * pow(1.0 + {nat['growth_rate']}::DOUBLE / 100.0, {n}) AS pop_m,
    LEAST(55.0, {nat['urbanization_rate']}::DOUBLE + 0.4::DOUBLE * {n}) AS urb_rate,
    GREATEST(12.0, {nat['birth_rate']}::DOUBLE - 0.2::DOUBLE * {n}) AS birth_rate,
    GREATEST(6.0, {nat['death_rate']}::DOUBLE - 0.05::DOUBLE * {n}) AS death_rate,
    GREATEST(0.9, {nat['world_growth_rate']}::DOUBLE - 0.01::DOUBLE * {n}) AS world_growth
  FROM state_match m LEFT JOIN cr ON m.aoi_id = cr.aoi_id LEFT JOIN sr ON m.aoi_id = sr.aoi_id)""") + f"""
SELECT aoi_id, matched_state, city_urb_rate, state_urb_rate,
  COALESCE(NULLIF(city_urb_rate, 0.0), NULLIF(state_urb_rate, 0.0), urb_rate) AS effective_urb_rate,
  pop_m, urb_rate, birth_rate, death_rate, world_growth,
  pop_m * urb_rate / 100.0 AS urban_pop_m, pop_m - pop_m * urb_rate / 100.0 AS rural_pop_m,
  pop_m / 1500.0 * 40.0 + COALESCE(NULLIF(city_urb_rate, 0.0), NULLIF(state_urb_rate, 0.0), urb_rate) / 60.0 * 30.0
    + {nat['growth_rate']}::DOUBLE / 2.5 * 20.0 + pop_m * urb_rate / 100.0 / 600.0 * 10.0 AS infra_pressure_score,
  pop_m / {nat['population_m']}::DOUBLE * 100.0 AS road_pressure
FROM ex"""


def _match_sql() -> str:
    known = ov.values(list(enumerate(dims.FOREST_STATES)), ["ord", "state"])
    alias = ov.values([(i, a, c) for i, (a, c) in enumerate(dims.STATE_ALIASES) if c in dims.FOREST_STATES],
                      ["ord", "alias", "canonical"])
    return f"""
m_exact AS (SELECT a.aoi_id, arg_min(k.state, k.ord) AS st FROM aoi a JOIN {known} k ON lower(a.aoi_name) = lower(k.state) GROUP BY a.aoi_id),
m_sub AS (SELECT a.aoi_id, arg_min(k.state, k.ord) AS st FROM aoi a JOIN {known} k
          ON contains(lower(a.aoi_name), lower(k.state)) OR contains(lower(k.state), lower(a.aoi_name)) GROUP BY a.aoi_id),
m_alias AS (SELECT a.aoi_id, arg_min(l.canonical, l.ord) AS st FROM aoi a JOIN {alias} l
          ON contains(lower(a.aoi_name), l.alias) GROUP BY a.aoi_id),
m_pairs AS (SELECT DISTINCT a.aoi_name AS b, k.state AS a FROM aoi a ANTI JOIN m_exact USING (aoi_id) ANTI JOIN m_sub USING (aoi_id)
          ANTI JOIN m_alias USING (aoi_id) CROSS JOIN {known} k),
m_parts AS (  -- the longest common block of every part of a pair of names, then what lies on its sides
  SELECT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi, 0::BIGINT AS held FROM m_pairs
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN alo ELSE i + l END, CASE side WHEN 0 THEN i ELSE ahi END,
         CASE side WHEN 0 THEN blo ELSE j + l END, CASE side WHEN 0 THEN j ELSE bhi END, CASE side WHEN 0 THEN l ELSE 0 END
  FROM (SELECT *, best.l AS l, -best.i AS i, -best.j AS j FROM (
    SELECT *, list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {{
      'l': list_max(list_filter(range(0, least(ahi - i, bhi - j) + 1), lambda l: substr(a, i + 1, l) = substr(b, j + 1, l))),
      'i': -i, 'j': -j}})))) AS best FROM m_parts WHERE ahi > alo AND bhi > blo)) p, (SELECT unnest([0, 1]) AS side) s
  WHERE l > 0),
m_ratio AS (SELECT a, b, 2.0::DOUBLE * SUM(held) / (length(a) + length(b)) AS score FROM m_parts GROUP BY a, b),
m_fuzzy AS (SELECT x.aoi_id, r.st FROM aoi x JOIN (
          SELECT b, a AS st, ROW_NUMBER() OVER (PARTITION BY b ORDER BY score DESC, a DESC) AS rn FROM m_ratio WHERE score >= 0.4) r
          ON x.aoi_name = r.b AND r.rn = 1),
state_match AS (
  SELECT a.aoi_id, a.aoi_name,
    COALESCE(e.st, s.st, l.st, f.st, {ov.sql_str(dims.FOREST_STATES[0])}) AS matched_state,
    CASE WHEN e.st IS NOT NULL THEN 'exact' WHEN s.st IS NOT NULL THEN 'substring'
         WHEN l.st IS NOT NULL THEN 'alias' WHEN f.st IS NOT NULL THEN 'fuzzy' ELSE 'fallback' END AS match_method
  FROM aoi a LEFT JOIN m_exact e ON a.aoi_id = e.aoi_id LEFT JOIN m_sub s ON a.aoi_id = s.aoi_id
       LEFT JOIN m_alias l ON a.aoi_id = l.aoi_id LEFT JOIN m_fuzzy f ON a.aoi_id = f.aoi_id)"""


MATCH_SQL = _match_sql()


def state_match(spark, d):
    return matching.with_state_match(bindings.aoi(spark, d), "aoi_name")


@query("urban_location_scoring", "F28 F29 F31 J7 J8",
       sql=urban_scoring_sql())
def q_urban_location_scoring(spark, d):
    a = state_match(spark, d)
    ex = fu.extrapolate_demographics(F.lit(SCORE_YEAR))
    rates = matching.effective_urb_rate("aoi_name", "matched_state", ex["urb_rate"])
    feats = fu.urban_feature_row(F.lit(SCORE_YEAR), ex, rates["effective_urb_rate"])
    return a.select(
        "aoi_id", "matched_state",
        rates["city_urb_rate"].alias("city_urb_rate"), rates["state_urb_rate"].alias("state_urb_rate"),
        rates["effective_urb_rate"].alias("effective_urb_rate"),
        ex["pop_m"].alias("pop_m"), ex["urb_rate"].alias("urb_rate"), ex["birth_rate"].alias("birth_rate"),
        ex["death_rate"].alias("death_rate"), ex["world_growth"].alias("world_growth"),
        feats["urban_pop_m"].alias("urban_pop_m"), feats["rural_pop_m"].alias("rural_pop_m"),
        feats["infra_pressure_score"].alias("infra_pressure_score"), feats["road_pressure"].alias("road_pressure"))


AHEAD = 4  # years past the national row that an area is scored for


def _national_row_sql() -> str:
    return urban_features_sql() + """,
nat AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY year DESC) AS rn FROM urban_features) WHERE rn = 1),
ind AS (SELECT country, arg_max(birth_rate, CASE WHEN birth_rate IS NOT NULL AND rn <= 3 THEN year END) AS birth_rate
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY year DESC) AS rn FROM national_series) GROUP BY country),
areas AS (SELECT c.c_custkey AS aoi_id, r.r_name AS country FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
          JOIN region r ON n.n_regionkey = r.r_regionkey)
""" + f"""SELECT a.aoi_id, a.country, n.year + {AHEAD} AS year,
  n.population_m * pow(1.0 + n.growth_rate / 100.0, {AHEAD}) AS pop_m,
  LEAST(55.0, n.urbanization_rate + 0.4 * {AHEAD}) AS urb_rate,
  GREATEST(12.0, COALESCE(i.birth_rate, n.birth_rate) - 0.2 * {AHEAD}) AS birth_rate,
  GREATEST(6.0, n.death_rate - 0.05 * {AHEAD}) AS death_rate,
  GREATEST(0.9, n.world_growth_rate - 0.01 * {AHEAD}) AS world_growth
FROM areas a LEFT JOIN nat n ON a.country = n.country LEFT JOIN ind i ON a.country = i.country"""


@query("national_row_scoring", "J8 S11 F28", sql=_national_row_sql())
def q_national_row_scoring(spark, d):
    """The latest national row, overridden by the indicator payload, joined to every area
    of the country and carried forward."""
    from ..sources.tables import table
    from .queries_payloads import q_indicator_payloads
    series = ["country", "year", "population_m", "growth_rate", "birth_rate", "death_rate", "world_growth_rate",
              "urbanization_rate"]
    nat = panels.latest_n(urban_features(spark, d).select(*series), "country", "year", 1).drop("rank")
    live = q_indicator_payloads(spark, d).select("country", F.col("birth_rate").alias("live_birth_rate"))
    nat = nat.join(live, "country", "left")
    areas = (table(spark, d, "customer", "c_custkey", "c_nationkey")
             .join(table(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(table(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.col("c_custkey").alias("aoi_id"), F.col("r_name").alias("country")))
    j = areas.join(nat, "country", "left")
    ex = fu.extrapolate_demographics(
        F.col("year") + AHEAD, pop_m="population_m", growth="growth_rate", urb="urbanization_rate",
        birth=F.coalesce("live_birth_rate", "birth_rate"), death="death_rate", world_growth="world_growth_rate", base_year="year")
    return j.select("aoi_id", "country", (F.col("year") + AHEAD).alias("year"), ex["pop_m"].alias("pop_m"),
                    ex["urb_rate"].alias("urb_rate"), ex["birth_rate"].alias("birth_rate"),
                    ex["death_rate"].alias("death_rate"), ex["world_growth"].alias("world_growth"))

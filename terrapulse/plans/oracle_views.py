"""DuckDB SQL text for the bindings, used by the oracle queries.

These are independent SQL statements of the same view definitions as
``sources/bindings.py``; the correctness gate runs them in DuckDB next to the
Spark plans.
"""

from __future__ import annotations

from .. import dims
from ..sources.bindings import GEO_STATES, SERIES_ORIGIN_YEAR


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols: list[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return sql_str(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


STATE_PANEL = """
state_agg AS (
  SELECT n.n_name AS state, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS v,
         SUM(CASE WHEN o.o_orderpriority LIKE '1%' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS v1,
         SUM(CASE WHEN o.o_orderpriority LIKE '2%' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS v2,
         SUM(CASE WHEN o.o_orderpriority LIKE '3%' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS v3,
         SUM(CASE WHEN o.o_orderpriority LIKE '4%' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS v4,
         SUM(CASE WHEN o.o_orderpriority LIKE '5%' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS v5,
         COUNT(*) AS n_orders,
         COUNT(*) FILTER (WHERE o.o_orderstatus = 'F') AS n_finished
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2),
state_pct AS (
  SELECT *, CAST(100.0 AS DOUBLE) * CAST(v AS DOUBLE) / CAST(SUM(v) OVER (PARTITION BY year) AS DOUBLE) AS forest_pct
  FROM state_agg),
state_panel AS (
  SELECT state, year,
         CAST(2500.0 AS DOUBLE) * forest_pct AS forest_cover,
         (CAST(2500.0 AS DOUBLE) * forest_pct) * (CAST(v1 AS DOUBLE) / CAST(v AS DOUBLE)) AS very_dense,
         (CAST(2500.0 AS DOUBLE) * forest_pct) * (CAST(v2 AS DOUBLE) / CAST(v AS DOUBLE)) AS mod_dense,
         (CAST(2500.0 AS DOUBLE) * forest_pct) * (CAST(v3 AS DOUBLE) / CAST(v AS DOUBLE)) AS open_forest,
         (CAST(2500.0 AS DOUBLE) * forest_pct) * (CAST(v4 AS DOUBLE) / CAST(v AS DOUBLE)) AS scrub,
         forest_pct,
         CAST(n_finished AS DOUBLE) / CAST(n_orders AS DOUBLE) AS ndvi,
         (CAST(2500.0 AS DOUBLE) * forest_pct) * (CAST(v5 AS DOUBLE) / CAST(v AS DOUBLE)) AS crop_area
  FROM state_pct)"""

FOREST_FEATURES = STATE_PANEL + """,
ff1 AS (
  SELECT *,
    forest_cover - LAG(forest_cover) OVER w AS forest_change_yoy,
    ndvi - LAG(ndvi) OVER w AS ndvi_change_yoy,
    forest_pct - LAG(forest_pct) OVER w AS forest_pct_change_yoy,
    very_dense - LAG(very_dense) OVER w AS very_dense_change_yoy,
    mod_dense - LAG(mod_dense) OVER w AS mod_dense_change_yoy,
    open_forest - LAG(open_forest) OVER w AS open_forest_change_yoy,
    crop_area - LAG(crop_area) OVER w AS crop_change_yoy,
    AVG(forest_cover) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS forest_cover_3yr_avg,
    AVG(ndvi) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ndvi_3yr_avg,
    AVG(forest_pct) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS forest_pct_3yr_avg,
    AVG(forest_cover) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS forest_cover_5yr_avg,
    AVG(ndvi) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ndvi_5yr_avg,
    (very_dense + mod_dense) / (forest_cover + 1.0) AS dense_to_total_ratio,
    open_forest / (forest_cover + 1.0) AS open_to_total_ratio,
    scrub / (forest_cover + 1.0) AS scrub_to_forest_ratio,
    crop_area / (forest_cover + 1.0) AS crop_to_forest_ratio,
    LEAD(ndvi) OVER w AS future_ndvi,
    LEAD(forest_cover) OVER w AS future_forest_cover
  FROM state_panel WINDOW w AS (PARTITION BY state ORDER BY year)),
ff2 AS (
  SELECT *,
    CASE WHEN forest_change_yoy IS NULL THEN NULL
         ELSE SUM(forest_change_yoy) OVER (PARTITION BY state ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum_forest_change,
    COALESCE(CAST(forest_change_yoy < 0 AS INTEGER), 0) AS deforestation_streak
  FROM ff1),
ff3 AS (
  SELECT *, SUM(CASE WHEN prev_flag IS NULL OR prev_flag <> deforestation_streak THEN 1 ELSE 0 END)
              OVER (PARTITION BY state ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id
  FROM (SELECT *, LAG(deforestation_streak) OVER (PARTITION BY state ORDER BY year) AS prev_flag FROM ff2)),
forest_features AS (
  SELECT * EXCLUDE (prev_flag, run_id),
    CAST(ROW_NUMBER() OVER (PARTITION BY state, run_id ORDER BY year) * deforestation_streak AS INTEGER) AS streak_count,
    CASE WHEN forest_change_yoy IS NULL OR forest_change_yoy >= 0 THEN 0
         WHEN forest_change_yoy > -500 AND forest_pct_change_yoy > -1 THEN 1
         WHEN forest_change_yoy > -2000 AND forest_pct_change_yoy > -3 THEN 2
         ELSE 3 END AS alert_level,
    CASE WHEN (-COALESCE(forest_pct_change_yoy, 0.0) * 8.0 + (1.0 - ndvi) * 40.0 + crop_to_forest_ratio * 5.0) IS NULL THEN NULL
         ELSE LEAST(GREATEST(-COALESCE(forest_pct_change_yoy, 0.0) * 8.0 + (1.0 - ndvi) * 40.0 + crop_to_forest_ratio * 5.0, 0.0), 300.0) END AS aqi_impact_score,
    LEAST(GREATEST(
        (1.0 - forest_pct / 100.0) * 40.0 + (1.0 - ndvi) * 30.0
        + LEAST(GREATEST(crop_to_forest_ratio, 0.0), 10.0) * 3.0
        + LEAST(GREATEST(-COALESCE(forest_change_yoy, 0.0), 0.0), 10000.0) / 500.0, 0.0), 100.0) AS human_impact_score
  FROM ff3)"""


def national_series_sql() -> str:
    return f"""
nat_base AS (
  SELECT r.r_name AS country,
         CAST(1961 + (year(o.o_orderdate) - {SERIES_ORIGIN_YEAR}) * 12 + month(o.o_orderdate) - 1 AS INTEGER) AS year,
         o.o_orderstatus AS st, o.o_orderpriority AS pr, CAST(o.o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
national_series AS (
  SELECT country, year,
    CAST(COUNT(*) AS DOUBLE) AS population_m,
    10.0 * COUNT(*) FILTER (WHERE st = 'F') / CAST(COUNT(*) AS DOUBLE) AS growth_rate,
    CASE WHEN COUNT(*) FILTER (WHERE st = 'O') > COUNT(*) FILTER (WHERE st = 'F') THEN NULL
         ELSE 60.0 * COUNT(*) FILTER (WHERE pr = '1-URGENT') / CAST(COUNT(*) AS DOUBLE) END AS birth_rate,
    30.0 * COUNT(*) FILTER (WHERE pr = '5-LOW') / CAST(COUNT(*) AS DOUBLE) AS death_rate,
    CAST(SUM(price) AS DOUBLE) / 1000.0 AS world_population_m,
    5.0 * COUNT(*) FILTER (WHERE st = 'P') / CAST(COUNT(*) AS DOUBLE) AS world_growth_rate
  FROM nat_base GROUP BY 1, 2)"""


OBS = """
obs AS (
  SELECT user_id AS location_id, event_id, ts, CAST(ts AS DATE) AS day,
         10.0 + value % 40.0 AS temp_max,
         10.0 + value % 40.0 - CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 10.0 AS temp_min,
         value AS precip,
         0.9::DOUBLE * CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS wind_kmh,
         CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS DOUBLE) AS humidity,
         10.0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 10.0 AS solar,
         360.0::DOUBLE * CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS sunshine_s,
         CAST(8.0 + ((user_id * 7) % 29) AS DOUBLE) AS lat,
         CAST(68.0 + ((user_id * 11) % 29) AS DOUBLE) AS lon
  FROM events)"""


def event_rows_sql() -> str:
    geo = values(list(enumerate(GEO_STATES)), ["state_idx", "state"])
    return f"""
event_rows AS (
  SELECT e.event_id, CAST(e.ts AS DATE) AS event_date, e.event_type, g.state,
         e.value - 100.0 AS precipitation_anomaly_mm,
         (CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER) - 50) / 25.0 AS mei_index,
         10.0 + e.value % 40.0 - 25.0 AS temperature_anomaly_c,
         0.9::DOUBLE * CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER) - 20.0 AS wind_anomaly_kmph,
         CAST(1 + e.event_id % 7 AS INTEGER) AS duration_days,
         1.0 + e.value % 9.0 AS intensity_scale
  FROM events e JOIN {geo} g ON CAST(e.user_id % {len(GEO_STATES)} AS INTEGER) = g.state_idx)"""


CROP_SEASON_SQL = ("CASE WHEN {m} IN (11, 12, 1, 2) THEN 'Rabi' WHEN {m} IN (6, 7, 8, 9, 10) THEN 'Kharif' "
                   "WHEN {m} IN (3, 4, 5) THEN 'Summer' ELSE 'Kharif' END")

CROP_ROWS = """
crop_rows AS (
  SELECT l.l_orderkey, l.l_linenumber, n.n_name AS state,
         """ + CROP_SEASON_SQL.format(m="month(l.l_shipdate)") + """ AS season,
         l.l_quantity AS n, l.l_discount * 1000.0 AS p, l.l_tax * 1000.0 AS k,
         p.p_size * 50.0::DOUBLE AS rainfall, 15.0 + p.p_size / 2.0 AS temperature,
         p.p_brand AS soil_type,
         CASE WHEN l.l_returnflag = 'R' THEN 'Drip' WHEN l.l_returnflag = 'A' THEN 'Sprinkler' ELSE 'Rainfed' END AS irrigation,
         p.p_type AS crop, l.l_extendedprice / l.l_quantity AS crop_yield
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def aoi_sql() -> str:
    st = values(list(enumerate(dims.FOREST_STATES)), ["s_idx", "base_state"])
    al = values([(i, a) for i, (a, _) in enumerate(dims.STATE_ALIASES)], ["a_idx", "alias"])
    ns, na = len(dims.FOREST_STATES), len(dims.STATE_ALIASES)
    return f"""
aoi_base AS (
  SELECT c.*, CAST(c_custkey % {ns} AS INTEGER) AS s_idx, CAST(c_custkey % {na} AS INTEGER) AS a_idx,
         CAST(c_custkey % 8 AS INTEGER) AS variant FROM customer c),
aoi AS (
  SELECT b.c_custkey AS aoi_id,
    CASE b.variant WHEN 0 THEN s.base_state WHEN 1 THEN upper(s.base_state)
         WHEN 2 THEN substr(s.base_state, 1, 5) WHEN 3 THEN s.base_state || ' region'
         WHEN 4 THEN a.alias || ' area' WHEN 5 THEN replace(s.base_state, 'a', 'e')
         WHEN 6 THEN 'Zq' || CAST(b.c_custkey AS VARCHAR) ELSE b.c_mktsegment END AS aoi_name,
    CAST(8.5 + ((b.c_custkey * 7) % 29) AS DOUBLE) AS lat,
    CAST(68.25 + ((b.c_custkey * 13) % 29) AS DOUBLE) AS lng,
    CASE WHEN b.c_acctbal > 0 THEN lower(replace(b.c_name, '#', '')) || '@example.org' END AS user_email
  FROM aoi_base b JOIN {st} s ON b.s_idx = s.s_idx JOIN {al} a ON b.a_idx = a.a_idx)"""


MESSAGES = """
messages AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS msg_id, text FROM conversations
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS msg_id, text FROM documents)"""


def with_(*ctes: str) -> str:
    """A WITH clause; the place-name views walk down pairs of names."""
    recursive = any("m_parts" in c for c in ctes)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(c.strip() for c in ctes) + "\n"

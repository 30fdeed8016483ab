"""Streaming queries (R1-R5): each runs the stream to completion and returns
its sink as a batch DataFrame; R1-R3 and R5 have SQL for the batch equivalent."""

from __future__ import annotations

from ..streaming import jobs
from . import oracle_views as ov
from .catalog import query


@query("stream_weekly_weather", "R1", sql=ov.with_(ov.OBS) + """
SELECT location_id, CAST(date_trunc('week', ts) AS DATE) AS week,
  CAST(SUM(CAST((temp_max + temp_min) / 2.0 AS DECIMAL(20,3))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS avg_temp,
  CAST(SUM(CAST(temp_max AS DECIMAL(20,2))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS max_temp,
  CAST(SUM(CAST(precip AS DECIMAL(20,2))) AS DOUBLE) AS precip_week,
  CAST(SUM(CAST(wind_kmh AS DECIMAL(20,1))) AS DOUBLE) / CAST(COUNT(wind_kmh) AS DOUBLE) AS wind_kmh,
  COUNT(*) AS n_readings
FROM obs GROUP BY 1, 2""")
def q_stream_weekly_weather(spark, d):
    return jobs.weekly_weather_stream(spark, d)


@query("stream_vegetation", "R2 F24", sql=ov.with_(ov.OBS, """
days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM obs)""", """
wins AS (SELECT DISTINCT CAST(d AS TIMESTAMP) - (i * INTERVAL 1 DAY) AS ws
         FROM days CROSS JOIN range(0, 16) r(i))""") + """
SELECT o.location_id, w.ws AS window_start,
  CAST(SUM(CAST(o.precip AS DECIMAL(20,2))) AS DOUBLE) / COUNT(o.precip) AS mean_precip,
  CAST(SUM(CAST(o.solar AS DECIMAL(20,1))) AS DOUBLE) / COUNT(o.solar) AS mean_radiation,
  LEAST(GREATEST(CAST(SUM(CAST(o.precip AS DECIMAL(20,2))) AS DOUBLE) / COUNT(o.precip) * 0.04
    + CAST(SUM(CAST(o.solar AS DECIMAL(20,1))) AS DOUBLE) / COUNT(o.solar) * 0.005, 0.0), 1.0) AS ndvi,
  COUNT(*) AS n_readings
FROM obs o JOIN wins w ON o.ts >= w.ws AND o.ts < w.ws + INTERVAL 16 DAY
GROUP BY 1, 2""")
def q_stream_vegetation(spark, d):
    return jobs.vegetation_stream(spark, d)


@query("stream_alert_feed", "R3 F21", sql=ov.with_(ov.OBS) + """
SELECT location_id, event_id, ts, points, CASE WHEN points >= 6 THEN 'RED' ELSE 'YELLOW' END AS level FROM (
  SELECT *, CAST((CASE WHEN temp_max > 45 THEN 3 WHEN temp_max > 40 THEN 2 WHEN temp_max > 37 THEN 1 ELSE 0 END)
    + (CASE WHEN wind_kmh > 80 THEN 3 WHEN wind_kmh > 55 THEN 2 WHEN wind_kmh > 35 THEN 1 ELSE 0 END)
    + (CASE WHEN precip > 80 THEN 2 WHEN precip > 50 THEN 1 ELSE 0 END) AS INTEGER) AS points FROM obs)
WHERE points >= 3""")
def q_stream_alert_feed(spark, d):
    return jobs.alert_feed(spark, d)


@query("stream_dedup_alerts", "R4", sql=ov.with_(ov.OBS) + """
SELECT DISTINCT location_id, CAST(ts AS DATE) AS alert_day FROM obs
WHERE (CASE WHEN temp_max > 45 THEN 3 WHEN temp_max > 40 THEN 2 WHEN temp_max > 37 THEN 1 ELSE 0 END)
    + (CASE WHEN wind_kmh > 80 THEN 3 WHEN wind_kmh > 55 THEN 2 WHEN wind_kmh > 35 THEN 1 ELSE 0 END)
    + (CASE WHEN precip > 80 THEN 2 WHEN precip > 50 THEN 1 ELSE 0 END) >= 3""")
def q_stream_dedup_alerts(spark, d):
    """One alert per (location, day): which reading is kept depends on arrival
    order, so the checked output is the set of keys the stream emitted."""
    return jobs.deduplicated_alerts(spark, d).select("location_id", "alert_day")


@query("stream_alert_outbox", "R5", sql=ov.with_(ov.OBS, ov.aoi_sql()) + """
SELECT a.user_email AS to_email, a.aoi_name, t.level, 'Environmental alert: ' || t.level || ' - ' || a.aoi_name AS subject,
       a.lat, a.lng, t.event_id
FROM (SELECT location_id, event_id, CASE WHEN points >= 6 THEN 'RED' ELSE 'YELLOW' END AS level FROM (
        SELECT *, (CASE WHEN temp_max > 45 THEN 3 WHEN temp_max > 40 THEN 2 WHEN temp_max > 37 THEN 1 ELSE 0 END)
          + (CASE WHEN wind_kmh > 80 THEN 3 WHEN wind_kmh > 55 THEN 2 WHEN wind_kmh > 35 THEN 1 ELSE 0 END)
          + (CASE WHEN precip > 80 THEN 2 WHEN precip > 50 THEN 1 ELSE 0 END) AS points FROM obs) WHERE points >= 3) t
JOIN aoi a ON a.aoi_id = t.location_id WHERE a.user_email IS NOT NULL""")
def q_stream_alert_outbox(spark, d):
    return jobs.alert_outbox(spark, d)

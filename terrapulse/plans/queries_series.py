"""Windows over series of any length: every reading of an event type is one series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import long_series
from ..sources.tables import table
from .catalog import query


def reading_series(spark, d):
    """Readings in hundredths, whole numbers; ``quality`` is known for even k only."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events", "event_id", "ts", "event_type", "value", "props").select(
        "event_type", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("reading"),
        F.when(k % 2 == 0, k).alias("quality"))


@query("reading_history", "W1 W2 W3 W4 W5 W6 W7 W8 W9", sql="""
WITH r AS (SELECT event_type, ts, event_id, CAST(ROUND(value * 100) AS BIGINT) AS reading,
             CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0
                  THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS quality FROM events),
c AS (SELECT *, reading - LAG(reading) OVER w AS change, LEAD(reading) OVER w AS next_1, LEAD(reading, 5) OVER w AS next_5,
        CAST(SUM(reading) OVER (w ROWS 2 PRECEDING) AS DOUBLE) / COUNT(reading) OVER (w ROWS 2 PRECEDING) AS mean_3,
        CAST(SUM(reading) OVER (w ROWS 4 PRECEDING) AS DOUBLE) / COUNT(reading) OVER (w ROWS 4 PRECEDING) AS mean_5,
        LAST_VALUE(quality IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS filled,
        ROW_NUMBER() OVER w AS n
      FROM r WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, ts, event_id, reading, quality, change, mean_3, mean_5, next_1, next_5, filled,
  CASE WHEN change < 0 THEN 1 ELSE 0 END AS is_loss,
  CASE WHEN change IS NOT NULL THEN CAST(SUM(change) OVER (PARTITION BY event_type ORDER BY n) AS BIGINT) END AS total_change,
  CAST(n - COALESCE(MAX(CASE WHEN change < 0 THEN NULL ELSE n END) OVER (PARTITION BY event_type ORDER BY n), 0) AS INTEGER) AS loss_streak
FROM c""")
def q_reading_history(spark, d):
    return long_series.measure_history(reading_series(spark, d), "event_type", ["ts", "event_id"], "reading", "quality")

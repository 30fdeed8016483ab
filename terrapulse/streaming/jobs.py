"""Structured Streaming jobs.

Observations arrive as files in a landing folder (``readStream`` file source,
``maxFilesPerTrigger`` micro-batches), in any order of event time. Nothing is dropped for being late:

* Windowed aggregates are mergeable sums and counts. Every micro-batch writes those of its
  own rows, by batch id, through ``foreachBatch``; a window is the sum of what all
  batches say of it. There is no state to hold and none to outlive, so rows of a
  window that was complete long ago are merged like any others.
* A window counts as complete when a reading ``DELAY`` past its end has come in an earlier batch;
  rows that come after that are marked late, so that readers of complete windows know
  which were changed.
* De-duplication emits a key in the first batch that has it; later batches compare with what
  was emitted for their days, which the emitted table is partitioned by.

A batch that is run again replaces what it wrote and looks only at batches before it, and a
restarted query resumes from its checkpoint in the shared folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import alerts as fa
from ..session import scratch_path
from ..sources import bindings
from ..sources.tables import table

#: How long after a window's end readings of it are expected.
DELAY = "1 day"
MONDAY_OFFSET = "4 days"  # 1970-01-01 is a Thursday: shift windows to start on Monday

#: Files of the landing folder, each cut further at so many rows.
LANDING_FILES = 32
LANDING_ROWS = 100_000
#: Windows that one task puts together from their steps.
MERGED_ROWS = 1_000_000

_LANDED: dict[tuple[str, str, int], str] = {}


def landing_folder(spark: SparkSession, d: str, files: int = LANDING_FILES) -> str:
    """Land the events table as files: days are dealt to files by a hash, so files come in no order of event time."""
    key = (spark.sparkContext.applicationId, d, files)
    if key not in _LANDED:
        path = scratch_path(spark, "landing", f"events-{uuid.uuid4().hex[:10]}")
        ev = table(spark, d, "events")
        (ev.repartition(files, F.xxhash64(F.to_date("ts"))).write.mode("overwrite")
         .option("maxRecordsPerFile", LANDING_ROWS).parquet(path))
        _LANDED[key] = path
    return _LANDED[key]


def readings(events: DataFrame) -> DataFrame:
    """Observations from a stream (or table) of raw events."""
    k = bindings.props_k(F.col("props"))
    tmax = F.lit(10.0) + F.col("value") % F.lit(40.0)
    return events.select(
        F.col("user_id").alias("location_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        tmax.alias("temp_max"), (tmax - k / F.lit(10.0)).alias("temp_min"), F.col("value").alias("precip"),
        (F.lit(0.9) * k).alias("wind_kmh"), k.cast("double").alias("humidity"),
        (F.lit(10.0) + k / F.lit(10.0)).alias("solar"), (F.lit(360.0) * k).alias("sunshine_s"))


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """The events that lie, or arrive, in any folder of Parquet files of that schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def observation_stream(spark: SparkSession, d: str, files_per_trigger: int = 16) -> DataFrame:
    """The supplied events, landed and read as a stream."""
    return readings(event_stream(spark, landing_folder(spark, d), table(spark, d, "events").schema, files_per_trigger))


def _run(stream: DataFrame, name: str, write_batch) -> None:
    """Runs ``stream`` to completion through ``write_batch``."""
    ckpt = scratch_path(stream.sparkSession, "stream", name, uuid.uuid4().hex[:10], "checkpoint")
    q = (stream.writeStream.outputMode("append").foreachBatch(write_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


# Windows of mergeable parts ----------------------------------------------------------
def _parts(measures: dict[str, tuple[Column, int]]) -> list[Column]:
    """Exact sum (at a number of decimals) and count of every measure, and the number of rows."""
    each = [x for name, (c, scale) in measures.items()
            for x in (F.sum(c.cast(f"decimal(20,{scale})")).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n"))]
    return [*each, F.count(F.lit(1)).alias("n_readings")]


def window_writer(base: str, window: Column, measures: dict[str, tuple[Column, int]], keys: list[str], delay: str = DELAY):
    """Writes each micro-batch's parts of its windows, how far event time had come and what was complete before.

    Sliding windows are written by their steps (``window`` is then the step) and put together when they are read."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            parts = batch.groupBy(*keys, window.alias("w")).agg(*_parts(measures))
            late, upto = F.lit(False), F.lit(None).cast("timestamp")
            if batch_id > 0:
                seen = spark.read.schema("upto timestamp").parquet(*[f"{base}/progress/batch={b}" for b in range(batch_id)])
                parts = parts.join(F.broadcast(seen.agg(F.max("upto").alias("upto"))))  # one row
                upto = F.col("upto") - F.expr(f"INTERVAL {delay}")
                late = F.coalesce(F.col("w.end") <= upto, F.lit(False))
            parts.withColumns({"late": late, "complete": upto}).drop("upto").write.mode("overwrite").parquet(f"{base}/log/batch={batch_id}")
            batch.agg(F.max("ts").alias("upto")).write.mode("overwrite").parquet(f"{base}/progress/batch={batch_id}")
        finally:
            batch.unpersist()
    return write_batch


def merged_windows(spark: SparkSession, base: str, measures: dict[str, tuple[Column, int]], keys: list[str],
                   steps: int = 1) -> DataFrame:
    """The windows of all batches so far, of ``steps`` written steps each: sums and counts of the measures,
    ``n_readings`` and ``n_late`` of them.

    Steps are shuffled before they become windows, ``MERGED_ROWS`` windows a task, so a task's groups don't grow with the input."""
    log = spark.read.parquet(f"{base}/log")
    if steps > 1:
        step = F.col("w.end") - F.col("w.start")
        log = log.repartition(max(1, -(-log.count() * steps // MERGED_ROWS)), *keys)
        log = log.select("*", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_i"))
        start = F.col("w.start") - F.col("_step") * F.col("_i")
        log = log.withColumn("w", F.struct(start.alias("start"), (start + F.col("_step") * F.lit(steps)).alias("end")))
        log = log.withColumn("late", F.coalesce(F.col("w.end") <= F.col("complete"), F.lit(False)))
    sums = [F.sum(f"{name}_{part}").alias(f"{name}_{part}") for name in measures for part in ("sum", "n")]
    return log.groupBy(*keys, "w").agg(*sums, F.sum("n_readings").alias("n_readings"),
                                       F.coalesce(F.sum(F.when(F.col("late"), F.col("n_readings"))), F.lit(0)).alias("n_late"))


def _windows(stream: DataFrame, name: str, window: Column, measures: dict[str, tuple[Column, int]], steps: int = 1) -> DataFrame:
    base = scratch_path(stream.sparkSession, "stream", name, uuid.uuid4().hex[:10])
    _run(stream, name, window_writer(base, window, measures, ["location_id"]))
    return merged_windows(stream.sparkSession, base, measures, ["location_id"], steps)


def _mean(name: str) -> Column:
    return F.col(f"{name}_sum").cast("double") / F.col(f"{name}_n").cast("double")


# R1 ------------------------------------------------------------------------------
def weekly_windows(observations: DataFrame) -> DataFrame:
    """Weekly weather of every location of a stream of readings, with the readings that came late."""
    both = F.col("temp_max").isNotNull() & F.col("temp_min").isNotNull()
    measures = {"mid": (F.when(both, (F.col("temp_max") + F.col("temp_min")) / F.lit(2.0)), 3),
                "max": (F.when(both, F.col("temp_max")), 2), "precip": (F.col("precip"), 2), "wind": (F.col("wind_kmh"), 1)}
    res = _windows(observations, "weekly", F.window("ts", "7 days", "7 days", MONDAY_OFFSET), measures)
    return res.select("location_id", F.col("w.start").cast("date").alias("week"), _mean("mid").alias("avg_temp"),
                      _mean("max").alias("max_temp"), F.col("precip_sum").cast("double").alias("precip_week"),
                      _mean("wind").alias("wind_kmh"), "n_readings", "n_late")


def weekly_weather_stream(spark: SparkSession, d: str) -> DataFrame:
    return weekly_windows(observation_stream(spark, d)).drop("n_late")


# R2 ------------------------------------------------------------------------------
def vegetation_windows(observations: DataFrame) -> DataFrame:
    """16-day windows sliding by one day: vegetation proxy per location."""
    measures = {"precip": (F.col("precip"), 2), "solar": (F.col("solar"), 1)}
    res = _windows(observations, "vegetation", F.window("ts", "1 day"), measures, steps=16)
    return res.select("location_id", F.col("w.start").alias("window_start"), _mean("precip").alias("mean_precip"),
                      _mean("solar").alias("mean_radiation"), "n_readings", "n_late").withColumn(
        "ndvi", fa.ndvi_proxy_a("mean_precip", "mean_radiation"))


def vegetation_stream(spark: SparkSession, d: str) -> DataFrame:
    return vegetation_windows(observation_stream(spark, d)).select(
        "location_id", "window_start", "mean_precip", "mean_radiation", "ndvi", "n_readings")


# R3 ------------------------------------------------------------------------------
def alerts_of(observations: DataFrame) -> DataFrame:
    """Readings that raise an alert; stateless."""
    pts = fa.alert_points(F.lit(None), "temp_max", "wind_kmh", "precip")
    scored = observations.select("location_id", "event_id", "ts", pts.alias("points"), fa.level_from_points(pts).alias("level"))
    return scored.where(F.col("level") != "GREEN")


def alert_stream(spark: SparkSession, d: str) -> DataFrame:
    return alerts_of(observation_stream(spark, d))


def alert_feed(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_path(spark, "stream", "alert_feed", uuid.uuid4().hex[:10])
    q = (alert_stream(spark, d).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


# R4 ------------------------------------------------------------------------------
def first_writer(out: str, keys: list[str], day: str, schema: StructType):
    """Writes each micro-batch's rows whose keys no batch before has emitted, one a key (its earliest reading)."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        cols = batch.columns
        new = batch.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct("ts", "event_id")).alias("r")).select("r.*")
        if batch_id > 0:
            span = batch.agg(F.min(day), F.max(day)).first()
            earlier = batch.sparkSession.read.schema(schema).option("basePath", out).parquet(
                *[f"{out}/batch={b}" for b in range(batch_id)])
            earlier = earlier.where(F.col(day).between(F.lit(span[0]), F.lit(span[1])))
            same = reduce(lambda a, b: a & b, [new[k].eqNullSafe(earlier[k]) for k in keys])
            new = new.join(earlier, same, "left_anti")
        new.write.mode("overwrite").partitionBy(day).parquet(f"{out}/batch={batch_id}")
    return write_batch


def deduplicated_alerts(spark: SparkSession, d: str) -> DataFrame:
    """One alert per (location, day), whenever its readings arrive."""
    alerts = alert_stream(spark, d).withColumn("alert_day", F.to_date("ts"))
    out = scratch_path(spark, "stream", "dedup_alerts", uuid.uuid4().hex[:10], "out")
    _run(alerts, "dedup_alerts", first_writer(out, ["location_id", "alert_day"], "alert_day", alerts.schema))
    return spark.read.schema(alerts.schema).option("basePath", out).parquet(f"{out}/batch=*")


# R5 ------------------------------------------------------------------------------
def alert_outbox(spark: SparkSession, d: str) -> DataFrame:
    """Alerts joined to area recipients (stream-static join) and appended to an
    outbox table by ``foreachBatch`` instead of sending mail."""
    areas = bindings.aoi(spark, d).select(F.col("aoi_id").alias("location_id"), "aoi_name", "lat", "lng", "user_email")
    a = alert_stream(spark, d).join(areas, "location_id").where(F.col("user_email").isNotNull())
    mail = a.select(F.col("user_email").alias("to_email"), "aoi_name", "level",
                    F.concat(F.lit("Environmental alert: "), F.col("level"), F.lit(" - "), F.col("aoi_name")).alias("subject"),
                    "lat", "lng", "event_id")
    out = scratch_path(spark, "stream", "outbox", uuid.uuid4().hex[:10], "out")
    _run(mail, "outbox", outbox_writer(out))
    return spark.read.parquet(out).drop("batch_id")


def outbox_writer(out: str):
    """Writes each micro-batch to its own folder, so that a batch run again sends nothing twice."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write_batch

"""Sinks and export shapes.

Writers go to the shared folder named by ``spark.checkpoint.dir`` (or an
explicit path), never to a machine-local temp folder.  Every writer is a
distributed ``DataFrame.write``; nothing is collected to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alerts import card_status
from ..session import scratch_path


def new_output_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "out", f"{name}-{uuid.uuid4().hex[:12]}")


# S13 ------------------------------------------------------------------------------
def _flat_value(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        el = dtype.elementType
        if isinstance(el, (T.StructType, T.ArrayType, T.MapType)):
            return F.array_join(F.transform(c, lambda x: F.to_json(x)), "; ")
        return F.array_join(F.transform(c, lambda x: x.cast("string")), "; ")
    if isinstance(dtype, T.MapType):
        return F.to_json(c)
    return c


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields become dotted top-level columns; lists are joined
    with '; ' (struct elements as JSON).  Driven by the schema only."""
    cols: list[Column] = []

    def walk(prefix: str, ref: Column, dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f"{prefix}{sep}{f.name}" if prefix else f.name, ref[f.name], f.dataType)
        else:
            cols.append(_flat_value(ref, dtype).alias(prefix))
    for f in df.schema.fields:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType)
    return df.select(*cols)


def write_flat_csv(df: DataFrame, path: str) -> str:
    flatten(df).write.mode("overwrite").option("header", True).csv(path)
    return path


# S14 ------------------------------------------------------------------------------
def write_nested_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


# S15 ------------------------------------------------------------------------------
def parameter_table(df: DataFrame, key: str, params: list[tuple[str, str, str]]) -> DataFrame:
    """One (Parameter, Value, Unit, Status) row per parameter per key; a missing
    value reads 'N/A'.  ``params`` = [(label, column, unit)]."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(label).alias("parameter"),
                 F.coalesce(F.col(col).cast("string"), F.lit("N/A")).alias("value"),
                 F.lit(unit).alias("unit")) for label, col, unit in params]))
    out = df.select(key, stacked.alias("p"))
    return out.select(key, "p.parameter", "p.value", "p.unit", card_status(F.col("p.value")).alias("status"))


# S16 ------------------------------------------------------------------------------
def alert_text(level, aoi_name, summary, lat, lng, ts) -> Column:
    return F.concat_ws("\n",
                       F.concat(F.lit("ALERT LEVEL: "), F.upper(level)),
                       F.concat(F.lit("Area: "), aoi_name),
                       F.concat(F.lit("Coordinates: "), F.format_string("%.4f, %.4f", lat, lng)),
                       F.concat(F.lit("Time: "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")),
                       F.concat(F.lit("Summary: "), summary))


def write_text_reports(df: DataFrame, text_col: str, path: str) -> str:
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)
    return path


# S17 ------------------------------------------------------------------------------
def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# S19 ------------------------------------------------------------------------------
def readiness(datasets: dict[str, DataFrame | None]) -> DataFrame:
    """(dataset, available, row_count) from a dict of optional DataFrames; the
    counts are one distributed aggregate per dataset, unioned."""
    parts = []
    spark = next(d for d in datasets.values() if d is not None).sparkSession
    for name, df in datasets.items():
        if df is None:
            parts.append(spark.createDataFrame([(name, False, 0)], "dataset STRING, available BOOLEAN, row_count LONG"))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("dataset"), F.lit(True).alias("available"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

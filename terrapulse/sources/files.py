"""File sources (S1-S3, S9): schema-declared CSV / JSON / text readers.

A missing or unreadable dataset is reported as absent (``None``) instead of
failing the job, like the reference's optional datasets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


# S1 -------------------------------------------------------------------------------
def read_csv_dataset(spark: SparkSession, path: str, schema: T.StructType | str,
                     encoding: str = "ISO-8859-1") -> DataFrame | None:
    """Latin-1 CSV with a header and an explicit schema; absent -> None."""
    try:
        df = (spark.read.schema(schema).option("header", True).option("encoding", encoding)
              .option("mode", "PERMISSIVE").csv(path))
        df.schema  # noqa: B018  (forces path resolution)
        return df
    except AnalysisException:
        return None


# S2 -------------------------------------------------------------------------------
def read_sheet_export(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """Spreadsheet datasets are exported to CSV; malformed rows are skipped
    (the text fallback of the reference)."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in st.fields])
    try:
        raw = spark.read.schema(as_text).option("header", True).csv(path)
        raw.schema  # noqa: B018
    except AnalysisException:
        return None
    # A row is malformed when a present field does not convert to its type.  The
    # check names every column, so CSV column pruning cannot skip it.
    ok = None
    for f in st.fields:
        c = F.col(f.name)
        good = c.isNull() | c.try_cast(f.dataType).isNotNull() if not isinstance(f.dataType, T.StringType) else F.lit(True)
        ok = good if ok is None else (ok & good)
    return raw.where(ok).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in st.fields])


# S3 -------------------------------------------------------------------------------
def read_rate_metadata(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Multi-line JSON metadata -> (ord, name, rate) dimension from a map field;
    an unreadable file gives an empty dimension."""
    schema = T.StructType([T.StructField(field, T.MapType(T.StringType(), T.DoubleType()))])
    empty = spark.createDataFrame([], "ord INT, name STRING, rate DOUBLE")
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        return df.select(F.posexplode(F.col(field)).alias("ord", "name", "rate")).select(
            F.col("ord").cast("int"), "name", "rate")
    except AnalysisException:
        return empty


# S9 -------------------------------------------------------------------------------
def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)

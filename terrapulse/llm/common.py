"""Column and join helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.session import ensure_checkpoint_dir

#: Separators of the corpus words ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"

#: Largest key set (rows) that a semi/anti join sends to every executor; larger
#: sets take a shuffled join instead.
BROADCAST_KEYS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a whole text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    """Content key that, with the document id, identifies a row."""
    return F.xxhash64(text)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def matches(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of left columns (keys) with right columns (values)."""
    cond = F.lit(True)
    for a, b in keys.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def sized(keys: DataFrame, max_rows: int = BROADCAST_KEYS) -> DataFrame:
    """A checkpointed key set, marked for broadcast only if it is counted to be small."""
    return F.broadcast(keys) if keys.count() <= max_rows else keys

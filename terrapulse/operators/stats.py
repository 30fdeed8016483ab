"""Aggregation operators.

All are single ``groupBy`` aggregations (Spark plans partial + final
aggregation, so each task pre-aggregates before the shuffle) or windows over
already aggregated rows.  Means of measures with a known number of decimals
are summed as exact decimals, which makes them independent of partitioning
and summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.climate import _c, kmh_to_ms, seconds_to_hours, wind_bin
from .quantiles import distribution_by_key, exact_quantile  # noqa: F401  (A16)


def exact_sum(col, scale: int = 2) -> Column:
    return F.sum(_c(col).cast(f"decimal(20,{scale})"))


def exact_avg(col, scale: int = 2) -> Column:
    """Mean of a measure with at most ``scale`` decimals, summed exactly."""
    return exact_sum(col, scale).cast("double") / F.count(_c(col)).cast("double")


# A1 / A2 ----------------------------------------------------------------------------
def weekly_weather(obs: DataFrame, key: str = "location_id", ts: str = "ts",
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Weekly aggregate per location (week starts Monday).

    Pairs max/min by reading (both must be present), precipitation of the first
    reading of the week, defaults for missing humidity/solar/sunshine, wind in
    m/s and binned, and the annualized rainfall (week sum x 365/7)."""
    both = F.col("temp_max").isNotNull() & F.col("temp_min").isNotNull()
    mid = F.when(both, (F.col("temp_max") + F.col("temp_min")) / F.lit(2.0))
    # ``carry``: columns that are functions of the key (e.g. coordinates), kept as grouping keys
    g = (obs.groupBy(key, *carry, F.date_trunc("week", F.col(ts)).cast("date").alias("week"))
         .agg(exact_avg(mid, 3).alias("avg_temp"),
              exact_avg(F.when(both, F.col("temp_max")), 2).alias("max_temp"),
              exact_avg(F.when(both, F.col("temp_min")), 2).alias("min_temp"),
              F.coalesce(exact_sum("precip", 2).cast("double"), F.lit(0.0)).alias("precip_week"),
              F.coalesce(F.min_by("precip", F.struct(F.col(ts), F.col("event_id"))), F.lit(0.0)).alias("precip_day"),
              exact_avg("wind_kmh", 1).alias("wind_kmh"),
              F.coalesce(exact_avg("humidity", 0), F.lit(55.0)).alias("humidity"),
              F.coalesce(exact_avg("solar", 1), F.lit(18.0)).alias("solar"),
              F.coalesce(seconds_to_hours(exact_avg("sunshine_s", 1)), F.lit(7.0)).alias("sunshine_hours"),
              F.count(F.lit(1)).alias("n_readings")))
    return g.select("*",
                    kmh_to_ms("wind_kmh").alias("wind_ms"),
                    wind_bin(kmh_to_ms("wind_kmh")).alias("wind_bin"),
                    (F.col("precip_week") * F.lit(365.0) / F.lit(7.0)).alias("rainfall_annualized"))


# A3 ---------------------------------------------------------------------------------
def profile(df: DataFrame, distinct_cols: list[str], year_col: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    aggs += [F.countDistinct(c).alias(f"n_distinct_{c}") for c in distinct_cols]
    if year_col:
        aggs += [F.min(year_col).alias("min_year"), F.max(year_col).alias("max_year")]
    return df.agg(*aggs)


# A4 ---------------------------------------------------------------------------------
def first_distinct(df: DataFrame, col: str, order_col: str, n: int = 10, sep: str = ", ") -> DataFrame:
    """The first ``n`` distinct values by first appearance, as one text.
    Distinct values are reduced to their first position by aggregation, then
    a top-n (the limit is the feature) feeds a one-row string."""
    firsts = df.groupBy(col).agg(F.min(order_col).alias("_first"))
    top = firsts.orderBy("_first", col).limit(n)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", col))),
                                            lambda s: s[col]), sep).alias("suggestions"))


# A6 ---------------------------------------------------------------------------------
def mode_by(df: DataFrame, key: str, col: str, out: str, count_col: str | None = None) -> DataFrame:
    """Most frequent value per key, ties to the smallest value.  Counting
    (key, value) pairs is a partial + final aggregate; the pick is a window
    over the distinct pairs only.  ``count_col``: ``df`` is already a
    pre-aggregate and this column holds the row counts."""
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    cnt = df.groupBy(key, col).agg(n.alias("_n"))
    w = Window.partitionBy(key).orderBy(F.col("_n").desc(), F.col(col).asc())
    return cnt.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col(col).alias(out))


# A9 ---------------------------------------------------------------------------------
def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """sklearn 'balanced' class weights n / (k * n_c), joined to every row.
    The per-class counts are an aggregate of k rows, joined back by label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = Window.partitionBy()
    cw = counts.select(label, (F.sum("_nc").over(tot).cast("double")
                               / (F.count(F.lit(1)).over(tot) * F.col("_nc")).cast("double")).alias(out))
    return df.join(F.broadcast(cw), label)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = Window.partitionBy()
    return counts.select(label, "n_class",
                         (F.sum("n_class").over(tot).cast("double")
                          / (F.count(F.lit(1)).over(tot) * F.col("n_class")).cast("double")).alias(out))


# A10 --------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, label: str, pred: str, *more: Column) -> DataFrame:
    """MAE and R^2 = 1 - SSres/SStot in one pass (SStot is the count times the variance), with ``more`` aggregates."""
    y, p = F.col(label), F.col(pred)
    spread = F.count(y) * F.var_pop(y)
    return df.agg(F.avg(F.abs(y - p)).alias("mae"), (F.lit(1.0) - F.sum(F.pow(y - p, 2)) / spread).alias("r2"),
                  F.count(F.lit(1)).alias("n"), *more)


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


# A11 --------------------------------------------------------------------------------
def classification_report(df: DataFrame, label: str, pred: str, count_col: str | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support, plus accuracy, macro and
    weighted averages as extra rows (class names 'accuracy', 'macro avg',
    'weighted avg').  ``df`` holds predictions, or counts of them in ``count_col``.
    Every row counts for its class and for its predicted class, so one aggregate gives
    the counts of all classes; the averages are windows over that class table."""
    n = F.col(count_col) if count_col else F.lit(1).cast("long")
    y, p, zero = F.col(label), F.col(pred), F.lit(0).cast("long")
    shares = F.array(
        F.struct(y.alias("cls"), n.alias("support"), F.when(y == p, n).otherwise(zero).alias("tp"), zero.alias("pred_n")),
        F.struct(p.alias("cls"), zero.alias("support"), zero.alias("tp"), n.alias("pred_n")))
    per = df.select(F.inline(shares)).groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"))
    per = per.select(
        F.col("cls").cast("string").alias("cls"), "support",
        F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0)).alias("recall"), "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      F.lit(2.0) * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    every = Window.partitionBy()
    scores = ["precision", "recall", "f1"]
    total = F.sum("support").over(every)
    row = lambda name, values: F.struct(name.alias("cls"), F.col("support_out").alias("support"),
                                        *[v.alias(c) for c, v in zip(scores, values)])
    wide = per.select(
        "*", total.alias("support_out"), (F.sum("tp").over(every) / total).alias("accuracy"),
        F.row_number().over(Window.orderBy("cls")).alias("nr"),
        *[F.avg(c).over(every).alias(f"macro_{c}") for c in scores],
        *[(F.sum(F.col(c) * F.col("support")).over(every) / total).alias(f"weighted_{c}") for c in scores])
    own = F.struct("cls", "support", *scores)
    averages = F.array(row(F.lit("accuracy"), [F.col("accuracy")] * 3),
                       row(F.lit("macro avg"), [F.col(f"macro_{c}") for c in scores]),
                       row(F.lit("weighted avg"), [F.col(f"weighted_{c}") for c in scores]))
    return wide.select(F.inline(F.when(F.col("nr") == 1, F.concat(F.array(own), averages)).otherwise(F.array(own))))


# A17 --------------------------------------------------------------------------------
def share_breakdown(df: DataFrame, col: str, out: str = "share") -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(col, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(out))

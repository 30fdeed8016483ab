"""Panel window operators.

Every window is partitioned by the panel key (state / country / user), so
the work spreads over as many tasks as there are keys and no window ever
collapses into a single partition.  Panels are already aggregated (one row
per key and period), so a partition holds one key's history only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import forest as ff
from ..functions.alerts import clip


def _ordered(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


# W1 / W2 ---------------------------------------------------------------------
def yoy_diff(col: str, key: str, order: str, first_zero: bool = False) -> Column:
    d = F.col(col) - F.lag(col).over(_ordered(key, order))
    return F.coalesce(d, F.lit(0.0)) if first_zero else d


# W3 / W4 ---------------------------------------------------------------------
def rolling_mean(col: str, key: str, order: str, rows: int) -> Column:
    """Mean of the last ``rows`` rows (min one row, nulls ignored)."""
    return F.avg(col).over(_ordered(key, order).rowsBetween(-(rows - 1), 0))


# W5 --------------------------------------------------------------------------
def running_total(col: str, key: str, order: str) -> Column:
    """Cumulative sum; a row whose own value is null stays null."""
    w = _ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.col(col).isNotNull(), F.sum(col).over(w))


# W6 --------------------------------------------------------------------------
def with_loss_streak(df: DataFrame, change_col: str, key: str, order: str,
                     flag_col: str = "deforestation_streak", count_col: str = "streak_count") -> DataFrame:
    """Loss flag (change < 0) and the length of the current run of equal flags,
    times the flag (gaps and islands: run id = running count of flag changes)."""
    w = _ordered(key, order)
    flagged = df.withColumn(flag_col, F.coalesce((F.col(change_col) < 0).cast("int"), F.lit(0)))
    prev = F.lag(flag_col).over(w)
    runs = (flagged
            .withColumn("_new_run", F.when(prev.isNull() | (prev != F.col(flag_col)), 1).otherwise(0))
            .withColumn("_run", F.sum("_new_run").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    pos = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))
    return runs.withColumn(count_col, pos * F.col(flag_col)).drop("_new_run", "_run")


# W7 / W8 ---------------------------------------------------------------------
def lead_target(col: str, key: str, order: str, n: int = 1) -> Column:
    return F.lead(col, n).over(_ordered(key, order))


# W9 --------------------------------------------------------------------------
def forward_fill(col: str, key: str, order: str) -> Column:
    return F.last(col, ignorenulls=True).over(_ordered(key, order).rowsBetween(Window.unboundedPreceding, 0))


# Forest feature job (W1, W3, W5, W6, W7 + F13-F16) ----------------------------
YOY_COLS = [("forest_cover", "forest_change_yoy"), ("ndvi", "ndvi_change_yoy"),
            ("forest_pct", "forest_pct_change_yoy"), ("very_dense", "very_dense_change_yoy"),
            ("mod_dense", "mod_dense_change_yoy"), ("open_forest", "open_forest_change_yoy"),
            ("crop_area", "crop_change_yoy")]
ROLL_COLS = ["forest_cover", "ndvi", "forest_pct"]


def forest_features(panel: DataFrame, key: str = "state", order: str = "year") -> DataFrame:
    cols = [yoy_diff(src, key, order).alias(dst) for src, dst in YOY_COLS]
    cols += [rolling_mean(c, key, order, 3).alias(f"{c}_3yr_avg") for c in ROLL_COLS]
    cols += [rolling_mean(c, key, order, 5).alias(f"{c}_5yr_avg") for c in ("forest_cover", "ndvi")]
    df = panel.select("*", *cols)
    ratios = ff.forest_ratios("very_dense", "mod_dense", "open_forest", "scrub", "crop_area", "forest_cover")
    df = df.select("*", *[v.alias(k) for k, v in ratios.items()],
                   running_total("forest_change_yoy", key, order).alias("cum_forest_change"))
    df = with_loss_streak(df, "forest_change_yoy", key, order)
    return df.select(
        "*",
        ff.deforestation_level("forest_change_yoy", "forest_pct_change_yoy").alias("alert_level"),
        lead_target("ndvi", key, order).alias("future_ndvi"),
        lead_target("forest_cover", key, order).alias("future_forest_cover"),
        ff.aqi_impact("forest_pct_change_yoy", "ndvi", "crop_to_forest_ratio").alias("aqi_impact_score"),
        ff.human_impact("forest_pct", "ndvi", "crop_to_forest_ratio", "forest_change_yoy").alias("human_impact_score"),
    )


# A5 ----------------------------------------------------------------------------
def latest_non_null(df: DataFrame, key: str, order: str, cols: list[str] | None = None) -> DataFrame:
    """Per key, each column's last non-null value by ``order`` (pandas
    ``groupby().last()``), one partial+final aggregate, no window."""
    cols = cols or [c for c in df.columns if c != key]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    return df.groupBy(key).agg(*aggs)


# J9 ----------------------------------------------------------------------------
def interpolate_anchors(df: DataFrame, year_col: str, anchors: list[tuple[int, float]], out_col: str) -> DataFrame:
    """Piecewise-linear interpolation against fixed (year, rate) anchors, clamped
    at both ends (``np.interp``).  The segments are a tiny fixed table
    (broadcast) and the clamps are literals; the range join
    ``y0 <= year < y1`` matches at most one segment per row."""
    pts = sorted(anchors)
    seg = df.sparkSession.createDataFrame(
        [(int(y0), float(r0), int(y1), float(r1)) for (y0, r0), (y1, r1) in zip(pts, pts[1:])],
        "y0 INT, r0 DOUBLE, y1 INT, r1 DOUBLE")
    y = F.col(year_col)
    j = df.join(F.broadcast(seg), (y >= F.col("y0")) & (y < F.col("y1")), "left")
    interp = F.col("r0") + (y - F.col("y0")).cast("double") * (F.col("r1") - F.col("r0")) / (F.col("y1") - F.col("y0")).cast("double")
    val = (F.when(y <= F.lit(pts[0][0]), F.lit(float(pts[0][1])))
           .when(y >= F.lit(pts[-1][0]), F.lit(float(pts[-1][1]))).otherwise(interp))
    return j.withColumn(out_col, val).drop("y0", "r0", "y1", "r1")


# Urbanization series job (W2, W4, W8, W9, J9, F30, F31, A8) ----------------------
SERIES_COLS = ["population_m", "growth_rate", "birth_rate", "death_rate", "world_population_m",
               "world_growth_rate"]
FORECAST_ROWS = 5


def urban_features(spark: SparkSession, series: DataFrame, key: str = "country",
                   order: str = "year") -> DataFrame:
    df = series.select(key, order, *[forward_fill(c, key, order).alias(c) for c in SERIES_COLS])
    df = df.select(
        "*",
        (F.col(order) - F.lit(1961)).alias("years_since_1961"),
        yoy_diff("population_m", key, order, first_zero=True).alias("pop_growth_abs"),
        rolling_mean("population_m", key, order, 3).alias("pop_rolling_3yr"),
        rolling_mean("population_m", key, order, 5).alias("pop_rolling_5yr"),
        yoy_diff("growth_rate", key, order, first_zero=True).alias("growth_rate_change"),
        (F.col("birth_rate") - F.col("death_rate")).alias("natural_increase_rate"),
        rolling_mean("birth_rate", key, order, 3).alias("birth_rate_trend"),
        rolling_mean("death_rate", key, order, 3).alias("death_rate_trend"),
        (F.col("population_m") / F.col("world_population_m")).alias("world_pop_ratio"),
        (F.col("growth_rate") - F.col("world_growth_rate")).alias("india_world_growth_diff"),
    )
    df = interpolate_anchors(df, order, dims.URB_ANCHORS, "urbanization_rate")
    df = df.select(
        "*",
        (F.col("population_m") * F.col("urbanization_rate") / F.lit(100.0)).alias("urban_pop_m"))
    df = df.select(
        "*",
        (F.col("population_m") - F.col("urban_pop_m")).alias("rural_pop_m"),
        yoy_diff("urbanization_rate", key, order, first_zero=True).alias("urb_rate_change"))
    df = df.withColumn("urban_rural_ratio", F.col("urban_pop_m") / (F.col("rural_pop_m") + F.lit(1.0)))
    # Global maxima per series (window over the key: no single-partition collapse).
    wk = Window.partitionBy(key)
    mx = {c: F.max(c).over(wk) for c in ("population_m", "urbanization_rate", "growth_rate", "urban_pop_m")}
    df = df.select(
        "*",
        clip(F.col("population_m") / mx["population_m"] * F.lit(40.0)
             + F.col("urbanization_rate") / mx["urbanization_rate"] * F.lit(30.0)
             + F.col("growth_rate") / mx["growth_rate"] * F.lit(20.0)
             + F.col("urban_pop_m") / mx["urban_pop_m"] * F.lit(10.0), 0.0, 100.0).alias("infra_pressure_score"),
        clip(F.col("urban_pop_m") / mx["urban_pop_m"] * F.lit(100.0), 0.0, 100.0).alias("school_pressure"),
        clip(F.col("urban_pop_m") / mx["urban_pop_m"] * F.lit(90.0), 0.0, 100.0).alias("hospital_pressure"),
        clip(F.col("population_m") / mx["population_m"] * F.lit(100.0), 0.0, 100.0).alias("road_pressure"),
    )
    return df.select(
        "*",
        lead_target("population_m", key, order, FORECAST_ROWS).alias("future_population"),
        lead_target("urbanization_rate", key, order, FORECAST_ROWS).alias("future_urb_rate"),
        lead_target("infra_pressure_score", key, order, FORECAST_ROWS).alias("future_infra_pressure"),
        lead_target("urban_pop_m", key, order, FORECAST_ROWS).alias("future_urban_pop"),
        lead_target("growth_rate", key, order, FORECAST_ROWS).alias("future_growth_rate"),
    )


# W10 / W11 ------------------------------------------------------------------------
def top_n_per_key(df: DataFrame, key: str, order: list[tuple[str, bool]], n: int,
                  rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows per key by ``order`` [(column, descending)], with
    their rank.  The limit is the feature (latest n per user).

    n = 1 is one partial + final aggregate (``max_by`` over the ordering).
    For n > 1 the rank filter is planned as a group limit before and after the
    shuffle, so only candidates of a hot key are shuffled."""
    cols = df.columns
    directions = {desc for _, desc in order}
    if n == 1 and len(directions) == 1:
        pick = F.max_by if directions == {True} else F.min_by
        best = pick(F.struct(*cols), F.struct(*[F.col(c) for c, _ in order]))
        return df.groupBy(key).agg(best.alias("_b")).select(*[F.col(f"_b.{c}").alias(c) for c in cols],
                                                            F.lit(1).alias(rank_col))
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() if desc else F.col(c).asc() for c, desc in order])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def latest_n(df: DataFrame, key: str, order_col: str, n: int, descending: bool = True) -> DataFrame:
    """Latest (or first) ``n`` rows per key by one column (see ``top_n_per_key``
    for explicit tie-breaking)."""
    return top_n_per_key(df, key, [(order_col, descending)], n)

"""Views that map the supplied star-schema tables onto the environmental schemas.

The supplied data holds no climate records, so each view derives the
environmental columns deterministically from the base tables (see README).
Every view is a plain DataFrame plan over whole tables; its work grows with
the data.  The DuckDB oracle mirrors each view in ``plans/oracle_views.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from .tables import table

MONEY = "decimal(18,2)"
GEO_STATES = sorted(set(dims.COASTAL_STATES) | set(dims.HILLY_STATES) | set(dims.DRY_STATES)
                    | set(dims.FOREST_STATES))


def _geo_state_dim(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(GEO_STATES)), "state_idx INT, state STRING"))


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")


def state_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest panel keyed by (state, year): orders x customer x nation.

    state = nation name; value = sum of order prices (exact decimal);
    forest_pct = share of the year's value; forest_cover = 2500 * pct;
    cover classes = cover x value share of order priorities 1..5;
    ndvi = share of finished orders.
    """
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    price = F.col("o_totalprice").cast(MONEY)
    zero = F.lit(0).cast(MONEY)

    def prio_value(p: str) -> Column:
        return F.sum(F.when(F.col("o_orderpriority").startswith(p), price).otherwise(zero))

    agg = (orders.join(cust.hint("merge"), orders.o_custkey == cust.c_custkey)
           .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
           .groupBy(F.col("n_name").alias("state"), F.year("o_orderdate").alias("year"))
           .agg(F.sum(price).alias("v"),
                *[prio_value(str(i)).alias(f"v{i}") for i in range(1, 6)],
                F.count(F.lit(1)).alias("n_orders"),
                F.count_if(F.col("o_orderstatus") == "F").alias("n_finished")))
    from pyspark.sql import Window
    year_total = F.sum("v").over(Window.partitionBy("year"))
    pct = F.lit(100.0) * F.col("v").cast("double") / year_total.cast("double")
    panel = agg.withColumn("forest_pct", pct).withColumn("forest_cover", F.lit(2500.0) * F.col("forest_pct"))
    cover = F.col("forest_cover")
    return panel.select(
        "state", "year",
        "forest_cover",
        (cover * _share(F.col("v1"), F.col("v"))).alias("very_dense"),
        (cover * _share(F.col("v2"), F.col("v"))).alias("mod_dense"),
        (cover * _share(F.col("v3"), F.col("v"))).alias("open_forest"),
        (cover * _share(F.col("v4"), F.col("v"))).alias("scrub"),
        "forest_pct",
        _share(F.col("n_finished"), F.col("n_orders")).alias("ndvi"),
        (cover * _share(F.col("v5"), F.col("v"))).alias("crop_area"),
    )


SERIES_ORIGIN_YEAR = 1995  # first order month maps to series year 1961


def national_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographic series per region ("country") and order month.

    year = 1961 + months since 1995-01.  Birth rate is missing in months
    with more open than finished orders (exercises forward fill).
    """
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    month_idx = ((F.year("o_orderdate") - SERIES_ORIGIN_YEAR) * 12 + F.month("o_orderdate") - 1)
    n = F.count(F.lit(1)).cast("double")
    g = (orders.join(cust.hint("merge"), orders.o_custkey == cust.c_custkey)
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
         .groupBy(F.col("r_name").alias("country"), (F.lit(1961) + month_idx).alias("year"))
         .agg(n.alias("population_m"),
              (F.lit(10.0) * F.count_if(F.col("o_orderstatus") == "F") / n).alias("growth_rate"),
              F.when(F.count_if(F.col("o_orderstatus") == "O") > F.count_if(F.col("o_orderstatus") == "F"),
                     F.lit(None).cast("double"))
              .otherwise(F.lit(60.0) * F.count_if(F.col("o_orderpriority") == "1-URGENT") / n)
              .alias("birth_rate"),
              (F.lit(30.0) * F.count_if(F.col("o_orderpriority") == "5-LOW") / n).alias("death_rate"),
              (F.sum(F.col("o_totalprice").cast(MONEY)).cast("double") / F.lit(1000.0)).alias("world_population_m"),
              (F.lit(5.0) * F.count_if(F.col("o_orderstatus") == "P") / n).alias("world_growth_rate")))
    return g.withColumn("year", F.col("year").cast("int"))


def props_k(props: Column) -> Column:
    return F.regexp_extract(props, "([0-9]+)", 1).cast("int")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather observations: one row per event.

    location = user; temp_max = 10 + value mod 40; temp_min = temp_max - k/10;
    precip = value; wind = 0.9 k km/h; humidity = k; solar = 10 + k/10;
    sunshine = 360 k seconds; lat/lon from the user id.
    """
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value", "props")
    k = props_k(F.col("props"))
    tmax = F.lit(10.0) + F.col("value") % F.lit(40.0)
    return ev.select(
        F.col("user_id").alias("location_id"),
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("day"),
        tmax.alias("temp_max"),
        (tmax - k / F.lit(10.0)).alias("temp_min"),
        F.col("value").alias("precip"),
        (F.lit(0.9) * k).alias("wind_kmh"),
        k.cast("double").alias("humidity"),
        (F.lit(10.0) + k / F.lit(10.0)).alias("solar"),
        (F.lit(360.0) * k).alias("sunshine_s"),
        (F.lit(8.0) + F.pmod(F.col("user_id") * 7, F.lit(29))).cast("double").alias("lat"),
        (F.lit(68.0) + F.pmod(F.col("user_id") * 11, F.lit(29))).cast("double").alias("lon"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather-event training rows: class = event type, state from the user id."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    k = props_k(F.col("props"))
    base = ev.select(
        "event_id", F.to_date("ts").alias("event_date"), "event_type",
        F.pmod(F.col("user_id"), F.lit(len(GEO_STATES))).cast("int").alias("state_idx"),
        (F.col("value") - F.lit(100.0)).alias("precipitation_anomaly_mm"),
        ((k - F.lit(50)) / F.lit(25.0)).alias("mei_index"),
        (F.lit(10.0) + F.col("value") % F.lit(40.0) - F.lit(25.0)).alias("temperature_anomaly_c"),
        (F.lit(0.9) * k - F.lit(20.0)).alias("wind_anomaly_kmph"),
        (F.lit(1) + F.pmod(F.col("event_id"), F.lit(7))).cast("int").alias("duration_days"),
        (F.lit(1.0) + F.col("value") % F.lit(9.0)).alias("intensity_scale"),
    )
    return base.join(_geo_state_dim(spark), "state_idx").drop("state_idx")


def crop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop survey rows: lineitem x part x supplier x nation."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag")
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    supp = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    from ..functions.climate import crop_season
    j = (li.join(part.hint("merge"), li.l_partkey == part.p_partkey)
         .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    month = F.month("l_shipdate")
    return j.select(
        "l_orderkey", "l_linenumber",
        F.col("n_name").alias("state"),
        crop_season(month).alias("season"),
        F.col("l_quantity").alias("n"),
        (F.col("l_discount") * F.lit(1000.0)).alias("p"),
        (F.col("l_tax") * F.lit(1000.0)).alias("k"),
        (F.col("p_size") * F.lit(50.0)).alias("rainfall"),
        (F.lit(15.0) + F.col("p_size") / F.lit(2.0)).alias("temperature"),
        F.col("p_brand").alias("soil_type"),
        F.when(F.col("l_returnflag") == "R", "Drip").when(F.col("l_returnflag") == "A", "Sprinkler")
         .otherwise("Rainfed").alias("irrigation"),
        F.col("p_type").alias("crop"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("crop_yield"),
    )


def aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of interest from customers: messy place name, point, optional e-mail.

    Name variants by key exercise every step of the state matching cascade.
    """
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    n_states = len(dims.FOREST_STATES)
    states = F.broadcast(spark.createDataFrame(list(enumerate(dims.FOREST_STATES)), "s_idx INT, base_state STRING"))
    aliases = F.broadcast(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(dims.STATE_ALIASES)],
                                                "a_idx INT, alias STRING"))
    base = c.select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment",
        F.pmod(F.col("c_custkey"), F.lit(n_states)).cast("int").alias("s_idx"),
        F.pmod(F.col("c_custkey"), F.lit(len(dims.STATE_ALIASES))).cast("int").alias("a_idx"),
        F.pmod(F.col("c_custkey"), F.lit(8)).cast("int").alias("variant"))
    j = base.join(states, "s_idx").join(aliases, "a_idx")
    s = F.col("base_state")
    name = (F.when(F.col("variant") == 0, s)
            .when(F.col("variant") == 1, F.upper(s))
            .when(F.col("variant") == 2, F.substring(s, 1, 5))
            .when(F.col("variant") == 3, F.concat(s, F.lit(" region")))
            .when(F.col("variant") == 4, F.concat(F.col("alias"), F.lit(" area")))
            .when(F.col("variant") == 5, F.regexp_replace(s, "a", "e"))
            .when(F.col("variant") == 6, F.concat(F.lit("Zq"), F.col("c_custkey").cast("string")))
            .otherwise(F.col("c_mktsegment")))
    return j.select(
        F.col("c_custkey").alias("aoi_id"),
        name.alias("aoi_name"),
        (F.lit(8.5) + F.pmod(F.col("c_custkey") * 7, F.lit(29))).cast("double").alias("lat"),
        (F.lit(68.25) + F.pmod(F.col("c_custkey") * 13, F.lit(29))).cast("double").alias("lng"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lower(F.regexp_replace("c_name", "#", "")),
                                                F.lit("@example.org"))).alias("user_email"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: every conversation turn and every document, whole text."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return (conv.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"),
                                 F.col("turn").cast("string")).alias("msg_id"), "text")
            .unionByName(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("msg_id"),
                                     "text")))

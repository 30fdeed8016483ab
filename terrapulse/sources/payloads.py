"""Parsers for landed JSON / text payloads.

Payloads are stored as one JSON string per row (or text lines); each parser
is ``from_json`` with an explicit schema plus built-in array / map / struct
functions, so parsing runs inside the scan's tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.climate import _c, kmh_to_ms, seconds_to_hours, wind_bin

D = T.DoubleType()
ARR_D = T.ArrayType(D)

WEATHER_SCHEMA = T.StructType([
    T.StructField("current_weather", T.StructType([
        T.StructField("temperature", D), T.StructField("windspeed", D),
        T.StructField("weathercode", T.IntegerType())])),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("precipitation_sum", ARR_D), T.StructField("temperature_2m_max", ARR_D),
        T.StructField("temperature_2m_min", ARR_D), T.StructField("windspeed_10m_max", ARR_D),
        T.StructField("shortwave_radiation_sum", ARR_D), T.StructField("sunshine_duration", ARR_D)])),
    T.StructField("hourly", T.StructType([T.StructField("relativehumidity_2m", ARR_D)])),
])

SOIL_SCHEMA = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("layers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("depths", T.ArrayType(T.StructType([
            T.StructField("values", T.StructType([T.StructField("mean", D)]))])))])))]))])

ELEVATION_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("elevation", D)])))])

GEOCODE_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("latitude", D), T.StructField("longitude", D)])))])

ADDRESS_FIELDS = ["state", "state_district", "region", "province", "country", "city", "town", "county",
                  "suburb", "village", "neighbourhood"]
REVERSE_SCHEMA = T.StructType([T.StructField("address", T.StructType(
    [T.StructField(f, T.StringType()) for f in ADDRESS_FIELDS]))])

CLIMATE_SCHEMA = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("parameter", T.StructType([
        T.StructField("ALLSKY_SFC_SW_DWN", T.MapType(T.StringType(), D)),
        T.StructField("PRECTOTCORR", T.MapType(T.StringType(), D))]))]))])

INDICATOR_RECORDS = T.ArrayType(T.StructType([T.StructField("value", D), T.StructField("date", T.StringType())]))


def _non_null(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


EXACT = "decimal(38,6)"


def _dsum(arr: Column, f=lambda x: x) -> Column:
    """Sum in decimal(38,6): exact for payload values (at most 6 decimals) and
    independent of element order."""
    return F.aggregate(arr, F.lit(0).cast(EXACT), lambda a, x: a + f(x).cast(EXACT)).cast("double")


def _mean(arr: Column) -> Column:
    """Mean of the non-null elements; null for an empty list."""
    vals = _non_null(arr)
    return F.when(F.size(vals) > 0, _dsum(vals) / F.size(vals).cast("double"))


def _sum(arr: Column) -> Column:
    return _dsum(_non_null(arr))


# S4 -------------------------------------------------------------------------------
def weather_environment(payload, temp=None, wind=None, precip=None) -> Column:
    """Weather payload -> struct(current, aggregate) (the 7-day environment).

    Max/min temperatures are paired by day and a day counts only when both
    are present; nulls are dropped from every list; overrides (P9) replace
    observed values, with the documented defaults last."""
    p = F.from_json(_c(payload), WEATHER_SCHEMA)
    daily = p["daily"]
    pairs = F.filter(F.arrays_zip(daily["temperature_2m_max"].alias("mx"), daily["temperature_2m_min"].alias("mn")),
                     lambda z: z["mx"].isNotNull() & z["mn"].isNotNull())
    n_pairs = F.size(pairs)
    avg_temp = F.when(n_pairs > 0, F.aggregate(pairs, F.lit(0).cast(EXACT),
                                               lambda a, z: a + z["mx"].cast(EXACT) + z["mn"].cast(EXACT)).cast("double")
                      / (F.lit(2.0) * n_pairs))
    max_t = _mean(daily["temperature_2m_max"])
    min_t = _mean(daily["temperature_2m_min"])
    precs = _non_null(daily["precipitation_sum"])
    precip_week = F.when(F.size(precs) > 0, _sum(precs)).otherwise(F.lit(0.0))
    precip_day = F.coalesce(F.try_element_at(precs, F.lit(1)), F.lit(0.0))
    wind_avg = _mean(daily["windspeed_10m_max"])
    humidity = F.coalesce(_mean(p["hourly"]["relativehumidity_2m"]), F.lit(dims.DEFAULT_HUMIDITY))
    solar = F.coalesce(_mean(daily["shortwave_radiation_sum"]), F.lit(dims.DEFAULT_SOLAR))
    sunshine = F.coalesce(seconds_to_hours(_mean(daily["sunshine_duration"])), F.lit(dims.DEFAULT_SUNSHINE_H))
    cur = p["current_weather"]
    o_t, o_w, o_p = (_c(x) if x is not None else F.lit(None).cast("double") for x in (temp, wind, precip))
    # ``x or default``: a zero aggregate falls back to the default as well
    cur_temp = F.coalesce(o_t, cur["temperature"], F.nullif(avg_temp, F.lit(0.0)), F.lit(dims.DEFAULT_TEMP_C))
    cur_wind = F.coalesce(o_w, cur["windspeed"], F.nullif(wind_avg, F.lit(0.0)), F.lit(dims.DEFAULT_WIND_KMH))
    cur_precip = F.coalesce(o_p, precip_day)
    agg_precip = F.coalesce(o_p, precip_week)
    agg_wind = F.coalesce(o_w, wind_avg, cur_wind)
    return F.struct(
        F.struct(cur_temp.alias("temperature"), cur_wind.alias("windspeed"),
                 cur["weathercode"].alias("weathercode"), cur_precip.alias("precipitation")).alias("current"),
        F.struct(F.coalesce(o_t, avg_temp, cur_temp).alias("avg_temp"),
                 F.coalesce(o_t, max_t, cur_temp).alias("max_temp"),
                 F.coalesce(o_t, min_t, cur_temp).alias("min_temp"),
                 agg_precip.alias("precip_week"), cur_precip.alias("precip_day"),
                 agg_wind.alias("wind_kmh"), kmh_to_ms(agg_wind).alias("wind_ms"),
                 wind_bin(kmh_to_ms(agg_wind)).alias("wind_bin"),
                 humidity.alias("humidity"), solar.alias("solar"), sunshine.alias("sunshine_hours"),
                 (agg_precip * F.lit(365.0) / F.lit(7.0)).alias("rainfall_annualized")).alias("aggregate"))


# S5 -------------------------------------------------------------------------------
def soil_properties(payload) -> Column:
    """Soil layers by name -> pH, organic carbon, moisture (first depth mean / 10),
    with defaults 6.8 / 0.8 / 38.0; a null mean is skipped."""
    layers = F.from_json(_c(payload), SOIL_SCHEMA)["properties"]["layers"]

    def layer_value(name: str) -> Column:
        hit = F.filter(layers, lambda l: (l["name"] == name)
                       & F.try_element_at(l["depths"], F.lit(1))["values"]["mean"].isNotNull())
        return F.try_element_at(hit, F.lit(1))["depths"][0]["values"]["mean"] / F.lit(10.0)

    return F.struct(
        F.coalesce(layer_value("phh2o"), F.lit(dims.DEFAULT_SOIL["ph"])).alias("ph"),
        F.coalesce(layer_value("soc"), F.lit(dims.DEFAULT_SOIL["organic_carbon"])).alias("organic_carbon"),
        F.coalesce(layer_value("wv0010"), F.lit(dims.DEFAULT_SOIL["soil_moisture"])).alias("soil_moisture"))


# S6 -------------------------------------------------------------------------------
def elevation(payload) -> Column:
    first = F.try_element_at(F.from_json(_c(payload), ELEVATION_SCHEMA)["results"], F.lit(1))
    return F.coalesce(first["elevation"], F.lit(dims.DEFAULT_ALTITUDE_M))


# S7 -------------------------------------------------------------------------------
def geocode(payload) -> Column:
    first = F.try_element_at(F.from_json(_c(payload), GEOCODE_SCHEMA)["results"], F.lit(1))
    return F.struct(first["latitude"].alias("lat"), first["longitude"].alias("lon"))


# S8 -------------------------------------------------------------------------------
def reverse_address(payload, fallback=None) -> Column:
    a = F.from_json(_c(payload), REVERSE_SCHEMA)["address"]

    def pick(*names):
        return F.coalesce(*[F.nullif(a[n], F.lit("")) for n in names])
    fb = _c(fallback) if fallback is not None else F.lit(None).cast("string")
    return F.struct(F.coalesce(pick("state", "state_district", "region", "province"), pick("country"), fb).alias("state"),
                    pick("city", "town", "county").alias("city"),
                    pick("suburb", "village", "neighbourhood").alias("area"))


# S9 -------------------------------------------------------------------------------
def enso_index(lines: DataFrame, line_no_col: str = "line_no", value_col: str = "value") -> DataFrame:
    """Fixed-width ENSO text -> the last valid value of the last line that starts with a
    year and has one (2 decimals), else 0.0.  One aggregate."""
    parts = F.split(F.trim(F.col(value_col)), r"\s+")
    rows = lines.select(F.col(line_no_col).alias("line_no"), parts.alias("p")).where(
        F.col("p")[0].rlike(r"^[0-9]+$") & (F.size("p") >= 2))
    vals = rows.select("line_no", F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("pos", "v"))
    vals = vals.where(~F.col("v").isin("-999.00", "-999")).select("line_no", "pos", F.col("v").try_cast("double").alias("v"))
    picked = vals.where(F.col("v").isNotNull()).agg(F.max_by("v", F.struct("line_no", "pos")).alias("mei"))
    return picked.select(F.coalesce(F.bround("mei", 2), F.lit(0.0)).alias("mei_index"))


# S10 ------------------------------------------------------------------------------
def climate_means(payload) -> Column:
    par = F.from_json(_c(payload), CLIMATE_SCHEMA)["properties"]["parameter"]

    def mean_valid(m: Column) -> Column:
        vals = F.filter(F.map_values(m), lambda v: v != F.lit(-999.0))
        return F.when(F.size(vals) > 0, _dsum(vals) / F.size(vals).cast("double"))
    return F.struct(mean_valid(par["PRECTOTCORR"]).alias("mean_precip"),
                    mean_valid(par["ALLSKY_SFC_SW_DWN"]).alias("mean_radiation"))


# S11 ------------------------------------------------------------------------------
def indicator_value(records_json) -> Column:
    """``[meta, [{value, date}, ...]]`` -> first record with a value (list order)."""
    arr = F.from_json(_c(records_json), T.ArrayType(T.StringType()))
    recs = F.from_json(F.try_element_at(arr, F.lit(2)), INDICATOR_RECORDS)
    hit = F.try_element_at(F.filter(recs, lambda r: r["value"].isNotNull()), F.lit(1))
    return F.struct(hit["value"].alias("value"), hit["date"].alias("date"))


# S12 ------------------------------------------------------------------------------
def is_land(soil_payload) -> Column:
    """Layers present -> land; a failed call (null payload) -> land as well."""
    layers = F.from_json(_c(soil_payload), SOIL_SCHEMA)["properties"]["layers"]
    return F.when(_c(soil_payload).isNull(), F.lit(True)).otherwise(F.coalesce(F.size(layers) > 0, F.lit(False)))

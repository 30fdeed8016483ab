"""Forest formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alerts import clip
from .climate import _c


# F13 ------------------------------------------------------------------------
def forest_ratios(very_dense, mod_dense, open_forest, scrub, crop_area, cover) -> dict[str, Column]:
    denom = _c(cover) + F.lit(1.0)
    return {
        "dense_to_total_ratio": (_c(very_dense) + _c(mod_dense)) / denom,
        "open_to_total_ratio": _c(open_forest) / denom,
        "scrub_to_forest_ratio": _c(scrub) / denom,
        "crop_to_forest_ratio": _c(crop_area) / denom,
    }


# F14 ------------------------------------------------------------------------
def deforestation_level(cover_change, pct_change) -> Column:
    """0 none/gain; 1 mild (> -500 and pct > -1); 2 severe (> -2000 and pct > -3); 3 critical.
    A null percentage change compares false, as NaN does."""
    chg, pct = _c(cover_change), _c(pct_change)
    return (F.when(chg.isNull() | (chg >= 0), F.lit(0))
            .when((chg > -500) & F.coalesce(pct > -1, F.lit(False)), F.lit(1))
            .when((chg > -2000) & F.coalesce(pct > -3, F.lit(False)), F.lit(2))
            .otherwise(F.lit(3)))


# F15 ------------------------------------------------------------------------
def aqi_impact(pct_change, ndvi, crop_ratio) -> Column:
    raw = (-F.coalesce(_c(pct_change), F.lit(0.0)) * F.lit(8.0)
           + (F.lit(1.0) - _c(ndvi)) * F.lit(40.0)
           + _c(crop_ratio) * F.lit(5.0))
    return clip(raw, 0.0, 300.0)


# F16 ------------------------------------------------------------------------
def human_impact(forest_pct, ndvi, crop_ratio, cover_change) -> Column:
    raw = ((F.lit(1.0) - _c(forest_pct) / F.lit(100.0)) * F.lit(40.0)
           + (F.lit(1.0) - _c(ndvi)) * F.lit(30.0)
           + clip(crop_ratio, 0.0, 10.0) * F.lit(3.0)
           + clip(-F.coalesce(_c(cover_change), F.lit(0.0)), 0.0, 10000.0) / F.lit(500.0))
    return clip(raw, 0.0, 100.0)


# F27 ------------------------------------------------------------------------
def extrapolate_forest(cover, pct, cover_yoy, pct_yoy, hist_year, target_year,
                       hist_ndvi, live_ndvi=None, ndvi_yoy=None) -> dict[str, Column]:
    """Carry the last known trend to ``target_year``; floors at 0.

    NDVI: the live value when present, else the history; its change is
    live - history, else the recorded change (null/0 -> 0)."""
    years = _c(target_year) - _c(hist_year)
    yoy = F.coalesce(F.nullif(_c(cover_yoy), F.lit(0.0)), F.lit(0.0))
    pyoy = F.coalesce(F.nullif(_c(pct_yoy), F.lit(0.0)), F.lit(0.0))
    live = _c(live_ndvi) if live_ndvi is not None else F.lit(None).cast("double")
    return {
        "extrap_cover": F.greatest(F.lit(0.0), _c(cover) + yoy * years),
        "extrap_pct": F.greatest(F.lit(0.0), _c(pct) + pyoy * years),
        "ndvi_used": F.coalesce(live, _c(hist_ndvi)),
        "ndvi_change": F.when(live.isNotNull(), live - _c(hist_ndvi))
                        .otherwise(F.coalesce(_c(ndvi_yoy) if ndvi_yoy is not None else F.lit(None), F.lit(0.0))),
    }


# F34 ------------------------------------------------------------------------
def aqi_category(aqi) -> Column:
    a = _c(aqi)
    return (F.when(a > 150, F.lit("Very Poor")).when(a > 100, F.lit("Poor"))
            .when(a > 50, F.lit("Moderate")).otherwise(F.lit("Good")))


def species_risk(alert_level) -> Column:
    a = _c(alert_level)
    return (F.when(a == 3, F.lit("Critical")).when(a == 2, F.lit("High"))
            .when(a == 1, F.lit("Moderate")).otherwise(F.lit("Low")))


def _list_or(items: list[Column], fallback: str) -> Column:
    arr = F.array_compact(F.array(*items))
    return F.when(F.size(arr) == 0, F.array(F.lit(fallback))).otherwise(arr)


def cover_change_pct(future_cover, current_cover) -> Column:
    return (_c(future_cover) - _c(current_cover)) / (_c(current_cover) + F.lit(1.0)) * F.lit(100.0)


def forest_effects(alert_level, aqi, human, forest_pct, ndvi, future_cover, current_cover) -> Column:
    """Service form of the forest effects report, as one struct column."""
    a, n, fp = _c(alert_level), _c(ndvi), _c(forest_pct)
    risks = _list_or([
        F.when(n < 0.25, F.lit("Severe heat stress due to loss of tree cover")),
        F.when(n < 0.35, F.lit("Increased dust and particulate matter")),
        F.when(a >= 2, F.lit("Higher vector-borne disease risk")),
        F.when(fp < 20, F.lit("Inadequate natural carbon sink")),
    ], "No major health risks detected")
    return F.struct(
        F.struct(_c(aqi).alias("score"), aqi_category(aqi).alias("category")).alias("air_quality"),
        F.struct(_c(human).alias("score"), risks.alias("risks")).alias("health"),
        F.struct(cover_change_pct(future_cover, current_cover).alias("cover_change_pct")).alias("water"),
        F.struct(F.greatest(F.lit(0.0), (F.lit(0.3) - n) * F.lit(5.0)).alias("local_temp_rise_est")).alias("climate"),
        F.struct(species_risk(a).alias("species_risk_level")).alias("biodiversity"),
    )


# F35 ------------------------------------------------------------------------
def forest_effects_full(alert_level, aqi, human, forest_pct, ndvi, future_cover, current_cover) -> Column:
    """Fuller six-dimension form (air, health, water, climate, livelihood, biodiversity)."""
    a, q, n, fp = _c(alert_level), _c(aqi), _c(ndvi), _c(forest_pct)
    ccp = cover_change_pct(future_cover, current_cover)
    aqi_cat = (F.when(q > 150, F.lit("Very Poor (AQI 200-300 range)"))
               .when(q > 100, F.lit("Poor (AQI 150-200 range)"))
               .when(q > 50, F.lit("Moderate (AQI 100-150 range)"))
               .otherwise(F.lit("Good (AQI below 100)")))
    aqi_msg = (F.when(q > 150, F.lit("Severe respiratory risks. Vulnerable groups should stay indoors."))
               .when(q > 100, F.lit("Increased asthma, bronchitis risk. Outdoor activity discouraged."))
               .when(q > 50, F.lit("Mild respiratory irritation. Elderly and children at risk."))
               .otherwise(F.lit("Air quality acceptable. Forests are providing clean air.")))
    health = _list_or([
        F.when(n < 0.25, F.lit("Severe heat stress due to loss of tree cover")),
        F.when(n < 0.35, F.lit("Increased dust and particulate matter")),
        F.when(a >= 2, F.lit("Higher vector-borne disease risk (malaria, dengue)")),
        F.when(a >= 3, F.lit("Mental health impact from degraded environment")),
        F.when(fp < 20, F.lit("Inadequate natural carbon sink — CO2 rising")),
    ], "No major health risks detected")
    water = _list_or([
        F.when(a >= 2, F.lit("Reduced rainfall interception → flash flood risk")),
        F.when(a >= 1, F.lit("Groundwater recharge declining")),
        F.when(n < 0.3, F.lit("River siltation increasing — water quality declining")),
        F.when(ccp < -5, F.lit("Watershed degradation accelerating")),
    ], "Water security maintained")
    temp_rise = F.greatest(F.lit(0.0), (F.lit(0.3) - n) * F.lit(5.0))
    livelihood = _list_or([
        F.when(a >= 1, F.lit("Reduced timber and non-timber forest produce")),
        F.when(a >= 2, F.lit("Tribal & rural communities losing forest income")),
        F.when(a >= 2, F.lit("Soil erosion reducing agricultural productivity")),
        F.when(a >= 3, F.lit("Complete ecosystem collapse risk in affected areas")),
    ], "Livelihoods not significantly impacted")
    return F.struct(
        F.struct(aqi_cat.alias("category"), aqi_msg.alias("message"), q.alias("score")).alias("air_quality"),
        F.struct(health.alias("risks"), _c(human).alias("score")).alias("health"),
        F.struct(water.alias("risks"), ccp.alias("cover_change_pct")).alias("water"),
        F.struct(
            F.format_string("+%.1f°C (estimated local warming)", temp_rise).alias("local_temp_rise_est"),
            F.when(a >= 2, F.lit("High carbon release")).when(a == 1, F.lit("Moderate"))
             .otherwise(F.lit("Stable")).alias("carbon_impact"),
            F.when(a >= 2, F.lit("Disrupted rainfall patterns")).otherwise(F.lit("Stable patterns"))
             .alias("rainfall_risk")).alias("climate"),
        F.struct(livelihood.alias("impacts")).alias("livelihood"),
        F.struct(species_risk(a).alias("species_risk_level"),
                 F.format_string("%.1f%% habitat predicted to be lost next year",
                                 F.abs(F.least(F.lit(0.0), ccp))).alias("habitat_loss")).alias("biodiversity"),
    )


# F42 ------------------------------------------------------------------------
def ndvi_trend(future_ndvi, current_ndvi) -> Column:
    return F.when(_c(future_ndvi) > _c(current_ndvi), F.lit("improving")).otherwise(F.lit("declining"))


def cover_trend(cover_delta) -> Column:
    return F.when(_c(cover_delta) >= 0, F.lit("GAIN")).otherwise(F.lit("LOSS"))


def human_risk_band(human) -> Column:
    h = _c(human)
    return (F.when(h > 60, F.lit("High risk")).when(h > 40, F.lit("Moderate risk"))
            .otherwise(F.lit("Low risk")))

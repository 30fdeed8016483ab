"""Alert rules and vegetation indices."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .climate import _c, null_d


def clip(x, lo: float | None, hi: float | None) -> Column:
    """Bound a value; a null stays null (unlike bare greatest/least)."""
    x = _c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNull(), null_d()).otherwise(out)


def or_default(x, default) -> Column:
    """Python ``x or default``: null and zero both fall back."""
    return F.coalesce(F.nullif(_c(x), F.lit(0)), _c(default))


_SIGNS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq}


def ladder(x, steps, otherwise) -> Column:
    """The value of the first step (sign, limit, value) that holds; a null holds none."""
    x, out = _c(x), F
    for sign, limit, value in steps:
        out = out.when(_SIGNS[sign](x, F.lit(limit)), F.lit(value))
    return out.otherwise(F.lit(otherwise))


# F17 ------------------------------------------------------------------------
def drought_category(spei) -> Column:
    return F.when(_c(spei).isNotNull(), ladder(spei, dims.SPEI_BANDS, dims.WETTEST))


# F18 ------------------------------------------------------------------------
def drought_alert(category, active) -> Column:
    c, a = _c(category), F.coalesce(_c(active).cast("boolean"), F.lit(False))
    return (F.when(a & c.isin("Extremely Dry", "Severely Dry"), F.lit("RED"))
            .when(a & (c == "Moderately Dry"), F.lit("YELLOW"))
            .otherwise(F.lit("GREEN")))


# F19 ------------------------------------------------------------------------
def drought_severity(category) -> Column:
    return ladder(category, dims.DROUGHT_SEVERITY, "UNKNOWN")


# F20 ------------------------------------------------------------------------
def intensity_level(intensity) -> Column:
    return ladder(intensity, dims.INTENSITY_LEVELS, "GREEN")


def intensity_word(intensity) -> Column:
    """Command-line wording: Low <= 3, Moderate <= 6, High <= 8, else Extreme."""
    return ladder(intensity, dims.INTENSITY_WORDS, "Extreme")


# F21 ------------------------------------------------------------------------
def alert_points(ndvi, temp, wind, precip, cold_points: bool = False) -> Column:
    """Points from thresholds; a null input adds nothing.

    ``cold_points`` adds 2 below 5 degrees (older four-level variant, F22)."""
    inputs = {"ndvi": ndvi, "temp": temp, "wind": wind, "precip": precip}
    tables = dict(dims.ALERT_POINTS, **({"cold": dims.COLD_POINTS} if cold_points else {}))
    pts = F.lit(0)
    for name, steps in tables.items():
        pts = pts + ladder(inputs.get(name, temp), steps, 0)
    return pts.cast("int")


def level_from_points(points) -> Column:
    return ladder(points, dims.POINT_LEVELS, "GREEN")


# F22 ------------------------------------------------------------------------
def level4_from_points(points) -> Column:
    return ladder(points, dims.POINT_LEVELS_OLD, "green")


# F23 ------------------------------------------------------------------------
def indices(precip, ndvi, temp, wind, bound: float = 1.0) -> dict[str, Column]:
    p, n, t, w = map(_c, (precip, ndvi, temp, wind))
    b = bound
    return {
        "ndwi": clip(p / F.lit(200.0) - F.lit(0.3), -b, b),
        "ndbi": clip(F.lit(0.4) - or_default(n, F.lit(0.3)), -b, b),
        "nbr": clip(or_default(n, F.lit(0.4)) - t / F.lit(100.0) - w / F.lit(100.0), -b, b),
        "risk_level": alert_points(F.lit(None), t, w, p) / F.lit(11.0),
    }


# F24 ------------------------------------------------------------------------
def ndvi_proxy_a(mean_precip, mean_radiation) -> Column:
    """clip(0.04 * mean precip + 0.005 * mean radiation, 0, 1); empty lists -> 2 / 4."""
    p = F.coalesce(_c(mean_precip), F.lit(2.0))
    r = F.coalesce(_c(mean_radiation), F.lit(4.0))
    return clip(p * F.lit(0.04) + r * F.lit(0.005), 0.0, 1.0)


# F25 ------------------------------------------------------------------------
def ndvi_proxy_b(precip_sum, mean_et0) -> Column:
    """clip(0.15 + P/50 * 0.1 + ET0/5 * 0.05, 0.14, 0.6)."""
    x = (F.lit(0.15) + _c(precip_sum) / F.lit(50.0) * F.lit(0.1)
         + _c(mean_et0) / F.lit(5.0) * F.lit(0.05))
    return clip(x, 0.14, 0.6)


# F26 ------------------------------------------------------------------------
def ndvi_band(ndvi) -> Column:
    n = _c(ndvi)
    return (F.when(n > 0.6, F.lit("Dense/healthy vegetation"))
            .when(n > 0.3, F.lit("Moderate vegetation"))
            .when(n > 0.1, F.lit("Sparse vegetation / stress"))
            .otherwise(F.lit("Bare soil or urban area")))


# F38 ------------------------------------------------------------------------
LEVELS = ["GREEN", "YELLOW", "RED"]


def level_rank(level) -> Column:
    lv = _c(level)
    return F.when(lv == "RED", 2).when(lv == "YELLOW", 1).when(lv == "GREEN", 0)


def rank_level(rank) -> Column:
    r = _c(rank)
    return F.when(r >= 2, F.lit("RED")).when(r == 1, F.lit("YELLOW")).otherwise(F.lit("GREEN"))


def ensemble_level(base_level, drought_level=None, intensity_label=None, forest_code=None,
                   infra_score=None) -> Column:
    """Worst level over the sources; a failed (null) domain is ignored."""
    parts = [level_rank(base_level)]
    if drought_level is not None:
        parts.append(level_rank(drought_level))
    if intensity_label is not None:
        parts.append(level_rank(intensity_label))
    if forest_code is not None:
        fc = _c(forest_code)
        parts.append(F.when(fc >= 2, 2).when(fc >= 1, 1).when(fc.isNotNull(), 0))
    if infra_score is not None:
        s = _c(infra_score)
        parts.append(F.when(s > 80, 2).when(s > 60, 1).when(s.isNotNull(), 0))
    return rank_level(F.coalesce(F.greatest(*parts), F.lit(0)))


# F49 ------------------------------------------------------------------------
def risk_notes(wind, temp, precip) -> Column:
    w, t, p = map(_c, (wind, temp, precip))
    return F.array_compact(F.array(
        F.when(w > 60, F.lit("High wind speed — potential cyclonic or severe gale risk.")),
        F.when(t > 42, F.lit("Heatwave threshold exceeded — health risk for vulnerable populations.")),
        F.when(p > 50, F.lit("Heavy precipitation — localised flooding possible.")),
    ))


# F50 ------------------------------------------------------------------------
def spei_mean_note(mean_spei) -> Column:
    s = _c(mean_spei)
    return F.when(s < -1.0, F.lit("Below -1.0 indicates drought conditions.")).otherwise(
        F.lit("Near-normal moisture conditions on average."))


# F51 ------------------------------------------------------------------------
def card_status(value_text) -> Column:
    raw = _c(value_text).cast("string")
    v = F.lower(raw)
    return (F.when(raw.isNull() | (raw == "") | (raw == "N/A"), F.lit("No Data"))
            .when(v.rlike("risk|alert|severe|high"), F.lit("Warning"))
            .when(v.contains("moderate"), F.lit("Monitor"))
            .otherwise(F.lit("Normal")))


# F52 ------------------------------------------------------------------------
def level_label(level) -> Column:
    lv = F.lower(_c(level))
    return (F.when(lv == "green", F.lit("🟢 Normal — no significant change detected."))
            .when(lv == "yellow", F.lit("🟡 Heads Up — early signs of change. Monitor regularly."))
            .when(lv == "orange", F.lit("🟠 Warning — notable environmental stress. Action recommended."))
            .when(lv == "red", F.lit("🔴 Critical — severe conditions. Immediate intervention needed.")))

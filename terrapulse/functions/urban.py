"""Demographic and urbanization formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .climate import _c

NAT = dims.NATIONAL_LATEST


def to_millions(pop) -> Column:
    p = _c(pop)
    return F.when(p > 1000, p / F.lit(1e6)).otherwise(p)


# F28 ------------------------------------------------------------------------
def extrapolate_demographics(current_year, pop_m=None, growth=None, urb=None, birth=None,
                             death=None, world_pop=None, world_growth=None, base_year=None) -> dict[str, Column]:
    """Carry the latest national row forward ``current_year - base_year`` years.

    Population, urbanization, birth and death move only when that is > 0;
    world population and growth always use it (growth floored at 0.9)."""
    lit = lambda v, d: _c(v) if v is not None else F.lit(d)
    pop, g, u = lit(pop_m, NAT["population_m"]), lit(growth, NAT["growth_rate"]), lit(urb, NAT["urbanization_rate"])
    b, d = lit(birth, NAT["birth_rate"]), lit(death, NAT["death_rate"])
    wp, wg = lit(world_pop, NAT["world_population_m"]), lit(world_growth, NAT["world_growth_rate"])
    n = _c(current_year) - lit(base_year, NAT["year"])
    ahead = n > 0
    return {
        "years_extra": n,
        "pop_m": F.when(ahead, pop * F.pow(F.lit(1.0) + g / F.lit(100.0), n)).otherwise(pop),
        "growth_rate": g,
        "urb_rate": F.when(ahead, F.least(F.lit(55.0), u + F.lit(0.4) * n)).otherwise(u),
        "birth_rate": F.when(ahead, F.greatest(F.lit(12.0), b - F.lit(0.2) * n)).otherwise(b),
        "death_rate": F.when(ahead, F.greatest(F.lit(6.0), d - F.lit(0.05) * n)).otherwise(d),
        "world_pop_now": wp * F.pow(F.lit(1.0) + wg / F.lit(100.0), n),
        "world_growth": F.greatest(F.lit(0.9), wg - F.lit(0.01) * n),
    }


# F31 ------------------------------------------------------------------------
def infra_pressure_serving(pop_m, eff_urb, growth, urban_pop) -> Column:
    """Serving-time pressure: fixed denominators 1500 / 60 / 2.5 / 600, no clip."""
    return (_c(pop_m) / F.lit(1500.0) * F.lit(40.0) + _c(eff_urb) / F.lit(60.0) * F.lit(30.0)
            + _c(growth) / F.lit(2.5) * F.lit(20.0) + _c(urban_pop) / F.lit(600.0) * F.lit(10.0))


# F29 ------------------------------------------------------------------------
def urban_feature_row(current_year, ex: dict[str, Column], eff_urb) -> dict[str, Column]:
    """The 25 model features for one location from extrapolated national values."""
    pop, g = ex["pop_m"], ex["growth_rate"]
    urban_pop = pop * ex["urb_rate"] / F.lit(100.0)
    rural_pop = pop - urban_pop
    return {
        "years_since_1961": _c(current_year) - F.lit(1961),
        "population_m": pop,
        "growth_rate": g,
        "birth_rate": ex["birth_rate"],
        "death_rate": ex["death_rate"],
        "world_population_m": ex["world_pop_now"],
        "world_growth_rate": ex["world_growth"],
        "pop_growth_abs": pop * g / F.lit(100.0),
        "pop_rolling_3yr": pop * F.lit(0.995),
        "pop_rolling_5yr": pop * F.lit(0.988),
        "growth_rate_change": g - F.lit(NAT["growth_rate"]),
        "natural_increase_rate": ex["birth_rate"] - ex["death_rate"],
        "birth_rate_trend": ex["birth_rate"],
        "death_rate_trend": ex["death_rate"],
        "world_pop_ratio": pop / ex["world_pop_now"],
        "india_world_growth_diff": g - ex["world_growth"],
        "urbanization_rate": _c(eff_urb),
        "urban_pop_m": urban_pop,
        "rural_pop_m": rural_pop,
        "urban_rural_ratio": urban_pop / (rural_pop + F.lit(1.0)),
        "urb_rate_change": _c(eff_urb) - F.lit(NAT["urbanization_rate"]),
        "infra_pressure_score": infra_pressure_serving(pop, eff_urb, g, urban_pop),
        "school_pressure": urban_pop / F.lit(NAT["urban_pop_m"]) * F.lit(100.0),
        "hospital_pressure": urban_pop / F.lit(NAT["urban_pop_m"]) * F.lit(90.0),
        "road_pressure": pop / F.lit(NAT["population_m"]) * F.lit(100.0),
    }


# F32 ------------------------------------------------------------------------
def pressure_level(score) -> Column:
    s = _c(score)
    return (F.when(s > 80, F.lit("CRITICAL")).when(s > 65, F.lit("HIGH"))
            .when(s > 50, F.lit("MODERATE")).otherwise(F.lit("LOW")))


def infrastructure_needs(infra_score, urban_pop_m, future_urban_m, urb_rate, future_urb) -> Column:
    growth = _c(future_urban_m) - _c(urban_pop_m)
    return F.struct(
        pressure_level(infra_score).alias("pressure_level"),
        _c(infra_score).alias("infra_score"),
        (growth * F.lit(1000.0) * F.lit(20.0)).cast("long").alias("new_schools"),
        (growth * F.lit(1000.0)).cast("long").alias("new_hospitals"),
        (growth * F.lit(1000.0) * F.lit(2.5)).cast("long").alias("new_road_km"),
        (growth * F.lit(1e6) / F.lit(4.5)).cast("long").alias("new_homes"),
        (growth * F.lit(135.0) * F.lit(365.0) / F.lit(1e6)).alias("water_demand_ml"),
        (_c(future_urb) - _c(urb_rate)).alias("urb_rate_change"),
        growth.alias("urban_growth_m"),
    )


# F33 ------------------------------------------------------------------------
def urbanization_effects(urb_rate, future_urb, infra_score) -> Column:
    u, fu, s = _c(urb_rate), _c(future_urb), _c(infra_score)
    gdp = F.least(F.lit(85), (fu * F.lit(1.8)).cast("long"))
    carbon = F.bround((fu - u) * F.lit(0.8), 1)
    return F.struct(
        F.array_compact(F.array(
            F.when(fu > 50, F.lit("Major GDP boost from urban manufacturing and services")),
            F.when(fu > 40, F.lit("Rising formal employment opportunities")),
            F.format_string("Urban economy contribution estimated near %d%% of GDP", gdp))).alias("economic"),
        F.array_compact(F.array(
            F.when(fu - u > 2, F.lit("Accelerated green cover loss in peri-urban areas")),
            F.when(fu > 45, F.lit("Urban heat island effect intensifying")),
            F.when(s > 65, F.lit("Increased solid waste generation and landfill pressure")),
            F.format_string("Estimated carbon footprint rise: +%.1f%%", carbon))).alias("environment"),
        F.array_compact(F.array(
            F.when(s > 70, F.lit("Housing shortage risk and slum expansion pressure")),
            F.when(s > 60, F.lit("Public transport system under strain")),
            F.lit("Rural-to-urban migration accelerating"),
            F.when(fu > 50, F.lit("Demographic transition toward smaller urban households")))).alias("social"),
        F.array_compact(F.array(
            F.when(s > 65, F.lit("Air quality deterioration risk")),
            F.when(s > 70, F.lit("Water scarcity risk in dense urban zones")),
            F.lit("Healthcare access likely improves for urban residents"))).alias("health"),
    )

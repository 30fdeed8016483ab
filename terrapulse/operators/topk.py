"""Class-probability vectors, rule boosts and top-k.

Probabilities stay an array column per row (the model output shape), so the
boost, renormalization and top-k are per-row higher-order functions: no
explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from ..functions.climate import _c


def laplace_probs(counts) -> Column:
    """(n_i + 1) / (sum n + k) for a count array."""
    c = _c(counts)
    total = F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    k = F.size(c)
    return F.transform(c, lambda x: (x + F.lit(1)).cast("double") / (total + k).cast("double"))


# F36 -------------------------------------------------------------------------------
def boost_event_probs(probs, state, season, precip_anom, wind_anom, temp_anom,
                      classes=dims.EVENT_CLASSES) -> Column:
    """Geographic / seasonal multipliers per event class, then renormalize.  ``classes`` is
    the label list of the probabilities or a column with it."""
    st, se = _c(state), _c(season)
    p_a, w_a, t_a = _c(precip_anom), _c(wind_anom), _c(temp_anom)
    coastal, hilly, dry = st.isin(dims.COASTAL_STATES), st.isin(dims.HILLY_STATES), st.isin(dims.DRY_STATES)
    rules = [("Cyclone", coastal & se.isin("Monsoon", "Post-Monsoon") & (w_a > 10), 2.5),
             ("Landslide", hilly & (p_a > 50), 2.2),
             ("Heatwave", dry & (se == "Summer") & (t_a > 3), 2.0),
             ("Drought", dry & (se == "Summer") & (p_a < -30), 2.0),
             ("Flood", (se == "Monsoon") & (p_a > 80), 1.8),
             ("Cloudburst", (se == "Monsoon") & (p_a > 80), 1.6),
             ("Thunderstorm", (w_a > 15) & (p_a > 30), 1.7)]

    def factor(label: Column) -> Column:
        out = F.when(F.lit(False), 1.0)
        for name, holds, by in rules:
            out = out.when((label == name) & holds, by)
        return out.otherwise(1.0)

    adj = F.zip_with(_c(probs), _labels(classes), lambda p, label: p * factor(label))
    total = F.aggregate(adj, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > 0, F.transform(adj, lambda x: x / total)).otherwise(adj)


def _labels(labels) -> Column:
    return labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels])


# T2 --------------------------------------------------------------------------------
def top_k(probs, labels, k: int) -> Column:
    """Top-k (label, p) by p desc, then label asc; labels are a list or a column."""
    pairs = F.arrays_zip(_c(probs).alias("p"), _labels(labels).alias("label"))
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1)
                           .when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    return F.slice(ordered, 1, k)


# M10 -------------------------------------------------------------------------------
def confidence_of(probs, code) -> Column:
    """Probability of the predicted class (0-based code) in percent."""
    return F.element_at(_c(probs), (_c(code) + F.lit(1)).cast("int")) * F.lit(100.0)


def argmax(probs) -> Column:
    """0-based index of the first largest probability."""
    return (F.array_position(_c(probs), F.array_max(_c(probs))) - F.lit(1)).cast("int")

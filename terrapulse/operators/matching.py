"""Place-name matching and code lookups.

All reference dimensions here are fixed tables of at most a few dozen rows,
so each lookup compiles to one CASE chain over the fixed values inside a
projection: map-only, codegen'd, no join and no shuffle, and the "first
known entry in table order" rule is just the CASE order.  The fuzzy step
(``closest``) compares names that the others missed with every fixed state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.climate import _c, null_d, null_s
from .closest import closest_known



def _blank_to_null(name) -> Column:
    n = F.trim(_c(name))
    return F.when(n == "", null_s()).otherwise(_c(name))


def _first_hit(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for cond, val in pairs:
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(default) if out is not None else default


# J2 ------------------------------------------------------------------------------
def match_exact_ci(name, known: list[str] = dims.FOREST_STATES) -> Column:
    low = F.lower(_c(name))
    return _first_hit([(low == F.lit(s.lower()), F.lit(s)) for s in known], null_s())


# J3 ------------------------------------------------------------------------------
def contains_either(name: Column, known_lower: str) -> Column:
    k = F.lit(known_lower)
    return F.contains(name, k) | F.contains(k, name)


def match_substring(name, known: list[str] = dims.FOREST_STATES) -> Column:
    """First known entry (table order) where one name contains the other (case-insensitive)."""
    low = F.lower(_c(name))
    return _first_hit([(contains_either(low, s.lower()), F.lit(s)) for s in known], null_s())


# J4 ------------------------------------------------------------------------------
def match_alias(name, known: list[str] = dims.FOREST_STATES,
                aliases: list[tuple[str, str]] = dims.STATE_ALIASES) -> Column:
    """First alias contained in the lower-cased name whose canonical form is a known state."""
    low = F.lower(_c(name))
    valid = [(a, c) for a, c in aliases if c in known]
    return _first_hit([(F.contains(low, F.lit(a)), F.lit(c)) for a, c in valid], null_s())


# J5 ------------------------------------------------------------------------------
def match_fuzzy(df: DataFrame, name_col: str, out: str, known: list[str] = dims.FOREST_STATES,
                cutoff: float = 0.4, only_if=None) -> DataFrame:
    """Adds ``out``: closest known entry by common blocks; rows that aren't ``only_if`` aren't compared."""
    name = _c(name_col) if only_if is None else F.when(only_if, _c(name_col))
    return df.select("*", closest_known(name, known, cutoff).alias(out))


# J6 / cascade -----------------------------------------------------------------------
def with_state_match(df: DataFrame, name_col: str, known: list[str] = dims.FOREST_STATES,
                     cutoff: float = 0.4, out: str = "matched_state", method: str = "match_method") -> DataFrame:
    """Exact (case-insensitive), substring, alias, fuzzy, then the first known state.

    Each step is its own column so generated code stays small; only names that the
    earlier steps missed are compared block by block."""
    n = _blank_to_null(name_col)
    df = df.select("*", match_exact_ci(n, known).alias("_m_exact"),
                   match_substring(n, known).alias("_m_sub"),
                   match_alias(n, known).alias("_m_alias"))
    missed = F.col("_m_exact").isNull() & F.col("_m_sub").isNull() & F.col("_m_alias").isNull()
    df = match_fuzzy(df, name_col, "_m_fuzzy", known, cutoff, only_if=missed & n.isNotNull())
    steps = ["_m_exact", "_m_sub", "_m_alias", "_m_fuzzy"]
    labels = ["exact", "substring", "alias", "fuzzy"]
    return df.select(
        *[c for c in df.columns if c not in steps],
        F.coalesce(*[F.col(c) for c in steps], F.lit(known[0])).alias(out),
        _first_hit([(F.col(c).isNotNull(), F.lit(lbl)) for c, lbl in zip(steps, labels)],
                   F.lit("fallback")).alias(method))


# J7 ------------------------------------------------------------------------------
def rate_lookup(name, table: list[tuple[str, float]]) -> Column:
    """First entry (table order) whose name contains, or is contained in, ``name``;
    blank names match nothing."""
    n = _blank_to_null(name)
    low = F.lower(n)
    return _first_hit([(contains_either(low, k.lower()), F.lit(float(r))) for k, r in table], null_d())


def effective_urb_rate(city, state, national) -> dict[str, Column]:
    city_rate = rate_lookup(city, dims.CITY_URB_RATES)
    state_rate = rate_lookup(state, dims.STATE_URB_RATES)
    eff = F.coalesce(F.nullif(city_rate, F.lit(0.0)), F.nullif(state_rate, F.lit(0.0)), _c(national))
    return {"city_urb_rate": city_rate, "state_urb_rate": state_rate, "effective_urb_rate": eff}


# J10 -----------------------------------------------------------------------------
def weather_label(code) -> Column:
    c = _c(code)
    return _first_hit([(c == F.lit(k), F.lit(v)) for k, v in dims.WEATHER_CODES],
                      F.concat(F.lit("Code "), c.cast("string")))


def alert_label(code) -> Column:
    c = _c(code)
    return _first_hit([(c == F.lit(k), F.lit(v)) for k, v in dims.ALERT_LABELS], c.cast("string"))


# J11 -----------------------------------------------------------------------------
def vocabulary(df: DataFrame, col: str, idx_col: str = "idx") -> DataFrame:
    """Sorted vocabulary of a category column -> (value, idx) (label-encoder order).
    One distinct (partial + final aggregate) and a rank over the distinct
    values, whose count is the category cardinality, not the row count."""
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return vals.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias(idx_col))


def vocabularies(df: DataFrame, cols: list[str]) -> DataFrame:
    """All category vocabularies of ``cols`` in one pass: (feature, value, idx).
    The (feature, value) pairs are deduplicated by one partial + final
    aggregate; the ranking window runs per feature over distinct values only."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                          for c in cols])).alias("p")).select("p.feature", "p.value")
    vals = pairs.where(F.col("value").isNotNull()).distinct()
    w = Window.partitionBy("feature").orderBy("value")
    return vals.select("feature", "value", (F.row_number().over(w) - 1).cast("int").alias("idx"))


def vocab_of(vocabs: DataFrame, feature: str) -> DataFrame:
    return vocabs.where(F.col("feature") == feature).select("value", "idx")


def encode(df: DataFrame, col: str, vocab: DataFrame, out_col: str, unseen: int = 0) -> DataFrame:
    """Left join to the vocabulary; unseen values get ``unseen`` (0 like the reference)."""
    v = vocab.select(F.col("value").alias(col), F.col("idx").alias(out_col))
    return df.join(v, col, "left").withColumn(out_col, F.coalesce(F.col(out_col), F.lit(unseen)))


def decode(df: DataFrame, idx_col: str, vocab: DataFrame, out_col: str) -> DataFrame:
    v = vocab.select(F.col("idx").alias(idx_col), F.col("value").alias(out_col))
    return df.join(v, idx_col, "left")

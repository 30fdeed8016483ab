"""Closest known name by common blocks.

The similarity of two names is twice the characters in their common blocks over all their
characters: the longest common block, then again what lies to its left and to its right
(Ratcliff-Obershelp). The known name of the highest similarity from ``cutoff`` on wins, of equal
ones the later by code point. Two upper bounds, from the lengths and from the
characters regardless of order, spare most names the block search.

This recursion isn't a column expression, so names go through an Arrow-batched function;
a batch's distinct names are compared once, and rows that need no comparison pass a null.
"""

from __future__ import annotations

from difflib import get_close_matches

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def closest_known(name: Column, known: list[str], cutoff: float = 0.4) -> Column:
    """The closest of ``known`` to every non-null name, null below ``cutoff``; map-only."""
    @F.pandas_udf("string")
    def closest(names: pd.Series) -> pd.Series:
        found = {n: next(iter(get_close_matches(n, known, 1, cutoff)), None) for n in names.dropna().unique()}
        return pd.Series([found.get(n) for n in names], dtype=object)

    return closest(name)

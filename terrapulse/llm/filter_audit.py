"""Filter interaction audit: what every filter removes in every order, from 32 coalitions.

Every document becomes a failure mask of five bits. Masks are counted per part (a source),
with the documents of good quality and the toxic ones among them, so at most 32 numbers a
part and measure remain. ``v(S)``, the documents that the coalition S of filters removes
together, is the count of the masks that meet S, and everything else follows from the
table of all 32 ``v``:

* a step of an order removes ``v(prefix + filter) - v(prefix)``; what fails the filter
  and was gone before is redundant;
* the Shapley value is the exact solution of the least squares problem
  ``min sum w(S) (v(S) - sum of phi in S)^2`` over the proper coalitions, with the kernel
  ``w(S) = (m-1) / (C(m,|S|) |S| (m-|S|))`` and the constraint that phi sums to ``v(all)``.
  Its normal equations are the same for every part, so they are solved once, in rationals,
  for every unit vector ``v``; a part's values are whole-number combinations of its ``v``.

Filter E (identical to the text of a smaller id, wherever that is) needs the smallest id of
every text. Texts meet by their 256-bit hash; equal ids are counted first, then a text's
rows of one part are one row with the smallest id and its count, so a group of copies of
any size reaches a task as one row a part. Texts are never shuffled, only narrow rows.

Defined results: null text is empty (no words: fails A, and E behind an equal one);
a null source is the part of the empty string; a null id is neither smaller nor larger than
any other, so it never fails E, removes no one else and has no labels; rows that repeat
count each, and equal ids with one text don't remove each other; a document with several
labels is good (toxic) if one of them says so; an empty table has no parts; other columns
of any name are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import bind, words

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("n", "good", "toxic")


# Shapley values from all coalitions ------------------------------------------------

def _solve(matrix: list[list[Fraction]], rhs: list[list[Fraction]]) -> list[list[Fraction]]:
    """Exact solution of a regular system for several right-hand sides."""
    n = len(matrix)
    rows = [list(map(Fraction, matrix[i])) + list(map(Fraction, rhs[i])) for i in range(n)]
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[n:] for row in rows]


def shapley_coefficients(m: int = len(FILTERS)) -> list[list[Fraction]]:
    """``c[f][S]`` with ``phi_f = sum over S of c[f][S] v(S)``, from the constrained normal equations."""
    every = range(1, (1 << m) - 1)
    weight = {s: Fraction(m - 1, comb(m, k) * k * (m - k)) for s in every for k in [bin(s).count("1")]}
    has = lambda s, i: s >> i & 1
    matrix = [[sum(w for s, w in weight.items() if has(s, i) and has(s, j)) for j in range(m)] + [1] for i in range(m)]
    matrix.append([1] * m + [0])
    rhs = [[weight.get(s, 0) if has(s, i) else 0 for s in range(1 << m)] for i in range(m)]
    rhs.append([int(s == (1 << m) - 1) for s in range(1 << m)])
    return _solve(matrix, rhs)[:m]


# Masks ------------------------------------------------------------------------------

def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone: A, B, C and D."""
    def mask(w: Column) -> Column:
        n, distinct = F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
        bits = [n < 50, 100 * distinct < 65 * n, 100 * capitals > F.lit(5).cast("long") * F.length(text), text.rlike(r"[#$%&*|]")]
        return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))

    return bind(words(text), mask)


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(
        {"quality": "good", "toxic": "toxic"}[c])
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality"), flag("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the failure masks of every part."""
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).alias("body"))
    rows = rows.select("id", "part", F.unhex(F.sha2(body, 256)).alias("digest"), own_failures(body).alias("mask"))
    # Equal rows are one from here on; rows without an id meet no label and are spread by their text.
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    rows = rows.join(_labels(labels, id_col).withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    rows = rows.select("id", "part", "digest", "mask", "n", *[
        (F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS[1:]])
    least = F.struct("id", *[F.col(c).alias(f"first_{c}") for c in COUNTS])
    per_part = rows.groupBy("digest", "mask", "part").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.min(F.when(F.col("id").isNotNull(), least)).alias("least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    # One row a text and part: the smallest id of all parts is the one that stays.
    stays = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
    first = [F.when(F.col("stays"), F.col(f"least.first_{c}")).otherwise(0) for c in COUNTS]
    first[0] = first[0] + F.col("no_id")
    split = per_part.withColumn("stays", stays).select("part", "mask", *COUNTS, *[
        x.alias(f"first_{c}") for x, c in zip(first, COUNTS)])
    kinds = F.array(F.struct(F.col("mask"), *[F.col(f"first_{c}").alias(c) for c in COUNTS]),
                    F.struct((F.col("mask") + (1 << 4)).alias("mask"),
                             *[(F.col(c) - F.col(f"first_{c}")).alias(c) for c in COUNTS]))
    every = split.select("part", F.inline(kinds))
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


# Steps ------------------------------------------------------------------------------

def _steps(filters: str) -> Column:
    """All (order, step, filter, coalition before the step and after it) as a constant array."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, f in enumerate(order):
            rows.append(f"{''.join(filters[i] for i in order)}:{k + 1}:{f}:{before}:{before | 1 << f}")
            before |= 1 << f
    cells = F.transform(F.split(F.lit(",".join(rows)), ","), lambda x: F.split(x, ":"))
    return F.transform(cells, lambda c: F.struct(c[0].alias("filter_order"), c[1].cast("int").alias("step"),
                                                 c[2].cast("int").alias("f"), c[3].cast("int").alias("before"),
                                                 c[4].cast("int").alias("after")))


def coalition_table(counts: DataFrame) -> DataFrame:
    """One row a part: total and, for every measure, the removals ``v`` of all 32 coalitions; own counts by mask."""
    of = lambda c, meets: F.array(*[
        F.coalesce(F.sum(F.when(meets(s), F.col(c))), F.lit(0)) for s in range(ALL + 1)])
    return counts.groupBy("part").agg(
        F.sum("n").alias("total"), of("n", lambda s: F.col("mask") == s).alias("exactly"),
        *[of(c, lambda s: F.col("mask").bitwiseAND(s) != 0).alias(f"v_{c}") for c in COUNTS])


def shapley_times_orders(v: Column) -> Column:
    """The Shapley values times the number of orders, whole numbers, from the array of all ``v``."""
    orders = factorial(len(FILTERS))
    rows = [[c * orders for c in row] for row in shapley_coefficients()]
    if any(c.denominator != 1 for row in rows for c in row):
        raise ValueError("coefficients aren't whole")
    return F.array(*[sum((v[s] * int(c) for s, c in enumerate(row) if c), F.lit(0).cast("long")) for row in rows])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (the Shapley value of the step's filter, times 120)."""
    table = coalition_table(mask_counts(docs, labels, id_col, text_col, part_col))
    table = table.withColumn("phi", shapley_times_orders(F.col("v_n")))
    step = table.withColumn("x", F.explode(_steps(FILTERS)))
    before, after = F.col("x.before"), F.col("x.after")
    alone = after - before
    v = lambda c, s: F.get(F.col(f"v_{c}"), s)
    lost = lambda c: v(c, after) - v(c, before)
    return step.select(
        "part", "x.filter_order", "x.step", (F.col("total") - v("n", after)).alias("kept"), lost("n").alias("removed"),
        (v("n", alone) - lost("n")).alias("redundant"), F.get("exactly", alone).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("phi", F.col("x.f")).alias("shapley"))

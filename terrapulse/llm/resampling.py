"""Target-distribution importance resampling: hashed features, Gumbel keys, weighted medians.

Features (runs of up to ``run`` words) are hashed into buckets and counted once over the
corpus and once over the target texts. A bucket's gain is the log ratio of its two smoothed
shares, in floored milli-nats; a document's weight is the sum of the gains of its features.
Adding a seeded Gumbel number to the weight and taking the highest scores draws documents
without replacement in proportion to exp(weight / 1000).

* Scoring: the gains are one number a bucket and become a constant array of a projection,
  which shuffles and joins nothing.
* Selection: the scored keys (no texts) are written once, sorted inside every partition.
  A round asks every partition for the middle key of what it still holds and for its
  number of rows; the median of these medians, weighted by the numbers, has at least a
  quarter of all remaining keys on either side, so one count says which of them can go.
  Rounds go on until the pivot is the cutoff key or a bounded rest is ordered. A round
  is map-only and returns one row a partition; its number is logarithmic in the rows.
* Ranks: only the winners are sorted, by ranges; a winner's rank is its place in its
  partition behind the counts of the partitions before.

Order of the draw: higher score, then smaller id, ids before null, then the text's hash;
rows equal in all of these are interchangeable. Whole numbers decide everywhere, so
neither partitioning nor a lost executor changes the draw.

Defined results: null or wordless text has no features and weight 0, and can't be drawn
as it has too few words; a null id draws as the empty id; repeated rows are drawn each on
its own; without target texts the gains follow from the smoothing alone; an empty table
gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import bind, checkpointed

#: Buckets of the two multinomials; more cost a longer constant array.
BUCKETS = 10_000
#: Percent of the documents with enough words that are drawn, and how many words are enough.
PERCENT, MIN_WORDS = 10, 20
SEED = 2024
#: So few remaining keys are ordered at once instead of halved further.
LAST = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["s", "null_id", "id", "tie"]


def lowered_words(text: Column) -> Column:
    """Words of a whole text with A-Z (and no other letters) in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEP), "")


def features(words: Column, run: int = 1) -> Column:
    """All runs of 1 to ``run`` consecutive words, joined by a space."""
    def exactly(n: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))

    return F.concat(words, *[exactly(n) for n in range(2, run + 1)]) if run > 1 else words


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")


def _feature_buckets(text: Column, run: int, buckets: int) -> Column:
    return F.transform(bind(lowered_words(text), lambda w: features(w, run)) if run > 1 else lowered_words(text),
                       lambda f: _bucket(f, buckets))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text",
                 run: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket in milli-nats: log share in the target over log share in the corpus."""
    def counts(df: DataFrame, col: str, name: str) -> DataFrame:
        each = df.select(F.explode(_feature_buckets(F.col(col), run, buckets)).alias("bucket"))
        return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(docs, text_col, "s"), "bucket", "left").join(counts(target, target_col, "t"), "bucket", "left")
    both = both.fillna(0, ["s", "t"])
    every = Window.partitionBy()  # over one row a bucket
    d = lambda c: c.cast("double")
    ratio = ((d(F.col("t")) + 1) * (d(F.sum("s").over(every)) + buckets)
             / ((d(F.col("s")) + 1) * (d(F.sum("t").over(every)) + buckets)))
    return both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def gain_array(gains: DataFrame, buckets: int) -> Column:
    """The gains as a constant array; one row a bucket comes to the driver."""
    known = {r["bucket"]: r["gain"] for r in gains.collect()}
    return F.split(F.lit(",".join(str(known[b]) for b in range(buckets))), ",").cast("array<bigint>")


def gumbel(id_: Column, seed: int) -> Column:
    """Seeded Gumbel number of an id in floored milli-nats."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), "UTF-8"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.log(-F.log(share)) * -1000).cast("long")


def scored(docs: DataFrame, gains: Column, id_col: str = "doc_id", text_col: str = "text", run: int = 1,
           buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and the text's hash of every document."""
    def measures(words: Column) -> Column:
        def of(found: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"), F.size(found).cast("long").alias("n_features"),
                F.aggregate(found, F.lit(0).cast("long"), lambda a, f: a + F.get(gains, _bucket(f, buckets))).alias("weight"))
        return bind(features(words, run), of) if run > 1 else of(words)

    rated = docs.select(F.col(id_col).alias("doc_id"), bind(lowered_words(F.col(text_col)), measures).alias("m"),
                        F.xxhash64(text_col).alias("tie"))
    return rated.select("doc_id", "m.*", (F.col("m.weight") + gumbel(F.col("doc_id"), seed)).alias("score"), "tie")


def _keyed(rated: DataFrame) -> DataFrame:
    """The order of the draw as ascending whole numbers."""
    return rated.select("*", (-F.col("score")).alias("s"), F.col("doc_id").isNull().cast("long").alias("null_id"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))


def _above(key: tuple | None) -> Column:
    """Whether a row's key comes after ``key`` in the draw."""
    after, same = F.lit(False), F.lit(True)
    for name, value in zip(_KEY, key):
        after = after | (same & (F.col(name) > F.lit(value)))
        same = same & (F.col(name) == F.lit(value))
    return after


def _same(key: tuple) -> Column:
    out = F.lit(True)
    for name, value in zip(_KEY, key):
        out = out & (F.col(name) == F.lit(value))
    return out


def _middles(batches):
    """The lower median key of a partition's rows, which come in order, and their number."""
    parts = [b for b in batches if len(b)]
    if parts:
        rows = np.concatenate([p.to_numpy() for p in parts])
        yield pd.DataFrame([[*rows[(len(rows) - 1) // 2], len(rows)]], columns=[*_KEY, "n"])


def _weighted_median(middles: list) -> tuple:
    total, upto = sum(m["n"] for m in middles), 0
    for m in sorted(middles, key=lambda m: tuple(m[k] for k in _KEY)):
        upto += m["n"]
        if 2 * upto >= total:
            return tuple(m[k] for k in _KEY)
    raise ValueError("no rows")


def cutoff(keys: DataFrame, n: int, last: int = LAST) -> tuple | None:
    """The n-th smallest key of a checkpointed table that is sorted inside its partitions; None for n = 0."""
    if n <= 0:
        return None
    low = high = None  # open bounds: what remains lies between them
    before, remaining = 0, None
    while True:
        rest = keys.select(*_KEY)
        if low is not None:
            rest = rest.where(_above(low))
        if high is not None:
            rest = rest.where(~_above(high) & ~_same(high))
        if remaining is not None and remaining <= last:
            found = rest.orderBy(*_KEY).limit(n - before).collect()[-1]
            return tuple(found[k] for k in _KEY)
        middles = rest.mapInPandas(_middles, ", ".join(f"{k} long" for k in [*_KEY, "n"])).collect()
        pivot = _weighted_median(middles)
        total = sum(m["n"] for m in middles)
        after, same = rest.agg(F.count_if(_above(pivot)), F.count_if(_same(pivot))).first()
        ahead = total - after - same
        if before + ahead >= n:
            high, remaining = pivot, ahead
        elif before + ahead + same >= n:
            return pivot
        else:
            low, remaining, before = pivot, after, before + ahead + same


def drawn(rated: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, last: int = LAST) -> DataFrame:
    """``rated`` with ``rank`` (1, 2, 3 ... in the order of the draw; null for what isn't drawn)."""
    held = checkpointed(_keyed(rated).withColumn("able", F.col("n_words") >= min_words).sortWithinPartitions(*_KEY))
    able = held.where("able")
    n = percent * able.count() // 100
    cut = cutoff(able, n, last)
    none = F.lit(None).cast("long")
    if cut is None:
        return held.withColumn("rank", none).select(*rated.columns, "rank")
    # Rows equal to the cutoff key beyond the n-th are told by their rank.
    won = F.col("able") & ~_above(cut)
    first = checkpointed(held.where(won).orderBy(*_KEY))
    place = F.monotonically_increasing_id()
    counts = first.groupBy(F.spark_partition_id().alias("part")).count().collect()  # one row a partition
    start, upto = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        start[r["part"]], upto = upto, upto + r["count"]
    starts = F.split(F.lit(",".join(str(start.get(p, 0)) for p in range(max(start) + 1))), ",").cast("array<bigint>")
    rank = F.get(starts, F.spark_partition_id()) + place.bitwiseAND((1 << 33) - 1) + 1
    ranked = first.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return ranked.unionByName(held.where(~won).withColumn("rank", none)).select(*rated.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, run: int = 1,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight, score, tie (hash of the text) and rank."""
    gains = gain_array(bucket_gains(docs, target, text_col, target_col, run, buckets), buckets)
    return drawn(scored(docs, gains, id_col, text_col, run, buckets, seed), percent, min_words)

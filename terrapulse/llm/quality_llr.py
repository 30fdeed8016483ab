"""Quality rules: hashed n-gram log-likelihood ratio of trusted against raw text.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two smoothed
multinomials over the buckets are counted: one over the trusted documents and one
over the whole corpus. A document's score is the mean, over all its n-grams, of
``log p_trusted - log p_raw``; it is kept from ``min_llr`` on.

Everything is DataFrame code: the counts are partial aggregates over all documents, and
the weights (one number a bucket, so bounded by ``buckets``) become a constant array of
the scoring projection, which shuffles and joins nothing. Weights are whole micro-nats,
so sums and verdicts don't depend on partitioning.

Defined results: null or blank text has no words, fails the base rules and is not
kept; without trusted rows every weight is 0 and only the base rules decide; an empty
table gives an empty result; rows that repeat are scored alike, each on its own; other
columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import SPACE, bind, fresh, words

#: Buckets of the two multinomials (a power of two).
BUCKETS = 1 << 13
#: At most so many trusted labelled documents fit the target multinomial, chosen by
#: the hash of their id.
TRUSTED_ROWS = 20_000
#: Mean nats an n-gram below which a document is rejected.
MIN_LLR = -0.12
MICRO = 1_000_000


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of at most ``limit`` labelled documents of good quality that aren't toxic."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
                        & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _pairs(h: Column) -> Column:
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _bucket(x: Column, buckets: int) -> Column:
    return x.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def ngram_buckets(text: Column, buckets: int) -> Column:
    return bind(_hashes(text), lambda h: F.transform(F.concat(h, _pairs(h)), lambda x: _bucket(x, buckets)))


def bucket_weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, weight): log ratio of the smoothed multinomials in micro-nats."""
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(trusted.select(F.col("doc_id").alias("id"), F.lit(1).alias("good"))), "id", "left")
    counts = (marked.select("good", F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good")))
    every = Window.partitionBy()  # over one row a bucket
    log_p = lambda c: F.log((F.col(c) + 1) / (F.sum(c).over(every) + F.lit(buckets)))
    ratio = F.when(F.sum("good").over(every) > 0, log_p("good") - log_p("raw")).otherwise(0.0)
    return counts.select("bucket", F.round(ratio * MICRO).cast("long").alias("weight"))


def bucket_array(weights: DataFrame, buckets: int) -> Column:
    """The weights as a constant array; one row a bucket comes to the driver."""
    known = {r["bucket"]: r["weight"] for r in weights.collect()}
    return F.split(F.lit(",".join(str(known.get(b, 0)) for b in range(buckets))), ",").cast("array<bigint>")


def _total(h: Column, weights: Column, buckets: int) -> Column:
    """Sum of the weights of all n-grams of the words with hashes ``h``."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.get(weights, _bucket(x, buckets)))
    return add(h) + add(_pairs(h))


def _repeated(h: Column, window: int = 5) -> Column:
    """Words inside windows that occur at least twice in the text of the words with hashes ``h``."""

    def windows(h: Column) -> Column:
        starts = F.greatest(F.size(h) - (window - 1), F.lit(0))
        return F.transform(F.slice(h, F.lit(1), starts),
                           lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]))

    def covered(g: Column) -> Column:
        spots = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            hits = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(hits, lambda x: x["i"]))

        def union(p: Column) -> Column:
            return F.aggregate(
                p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"),
                                        i.alias("last")))["n"]

        return bind(bind(spots, twice), union)

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0)

    return bind(windows(h), count).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def rules(text: Column, weights: Column, buckets: int = BUCKETS, min_llr: float = MIN_LLR) -> Column:
    """Struct of n_words, n_repeat_words, base_failed, kept and llr of a text."""

    def verdict(x: Column) -> Column:
        failed = (x["n"] < 10) | (100 * x["again"] > 20 * x["n"])
        ngrams = F.greatest(2 * x["n"] - 1, F.lit(0))
        return F.struct(
            x["n"].alias("n_words"), x["again"].alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & (x["total"] >= F.lit(min_llr * MICRO) * ngrams)).alias("kept"),
            F.when(x["n"] > 0, x["total"] / F.greatest(ngrams, F.lit(1)) / MICRO).alias("llr"))

    parts = bind(_hashes(text), lambda h: F.struct(F.size(h).cast("long").alias("n"), _repeated(h).alias("again"),
                                                   _total(h, weights, buckets).alias("total")))
    return bind(parts, verdict)


def measure(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            buckets: int = BUCKETS, min_llr: float = MIN_LLR) -> DataFrame:
    """One row a document: doc_id, base measures, the verdict ``kept`` and llr."""
    weights = bucket_array(bucket_weights(docs, trusted, id_col, text_col, buckets), buckets)
    rated = docs.select(F.col(id_col).alias("doc_id"), rules(F.col(text_col), weights, buckets, min_llr).alias("r"),
                        *[c.alias(k) for k, c in base_measures(F.col(text_col)).items()])
    return rated.select("doc_id", "r.n_words", "word_chars", "n_symbols", "n_dup_lines", "r.n_repeat_words",
                        "r.base_failed", "r.kept", "r.llr")


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              buckets: int = BUCKETS, min_llr: float = MIN_LLR) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    weights = bucket_array(bucket_weights(docs, trusted, id_col, text_col, buckets), buckets)
    verdict = fresh(docs, "quality")
    rated = docs.withColumn(verdict, rules(F.col(text_col), weights, buckets, min_llr))
    return rated.where(F.col(verdict)["kept"]).drop(verdict)

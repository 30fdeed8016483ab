"""Source mixing: Efraimidis-Spirakis sampling to token budgets.

Every source gets a target in words: sources in code point order (null last) weigh
5, 2, 1, repeating; the targets share the whole corpus by weight, no target exceeds
``MAX_EPOCHS`` times its source, and the excess is shared again by weight. A target of
2.4 times its source takes two complete epochs of every document, then a fraction of
0.4: documents in the order of their exponential keys ``-ln(u) / quality`` until the
budget is met. The document at the boundary is taken if that ends nearer to the target.

The prefix sums are split: keys fall into ``BUCKETS`` ordered buckets a source, bucket
totals (narrow, at most ``BUCKETS`` rows a source) give every bucket its offset, and only
inside a bucket are rows sorted. So a source with a third of all rows spreads over
``BUCKETS`` groups. ``u`` comes from a hash of the id and text: reruns agree.

Defined results: null text has size 0; a null source is a source; rows that repeat count
each and are drawn next to each other; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import SPACE, fresh, matches, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
MIN_QUALITY = 0.05


def quality(text: Column) -> Column:
    """Quality weight of a document: the share of its word characters that aren't markup symbols."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    chars = F.length(F.regexp_replace(text, SPACE, ""))
    return F.greatest(F.lit(MIN_QUALITY), 1 - marks / F.greatest(chars, F.lit(1)))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the id and the text, the same on every run."""
    seed = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(seed), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source throughout.

    A target reaches its cap iff sharing what is left by weight gives it more; in the order
    of cap per weight those sources come first, so the split is found by running sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    sized = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = sized.withColumn("share", left / weights).withColumn("full", F.col("cap") / F.col("weight") < F.col("share"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(every)["share"]
    return full.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double"))
                       .otherwise(F.least(F.col("weight") * level, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight: Column | None = None) -> DataFrame:
    """``docs`` with a struct column ``mix``: size, source_size, target, copies, taken."""
    own, info = docs.columns, fresh(docs, "mix")
    x = {k: fresh(docs, f"mix_{k}") for k in ("size", "key", "bucket", "sum")}
    text = F.col(text_col)
    draw = -F.log(uniform(F.col(id_col), text)) / (quality(text) if weight is None else weight)
    rows = docs.withColumns({x["size"]: F.size(words(text)).cast("long"), x["key"]: draw}).withColumn(
        x["bucket"], F.least(F.lit(BUCKETS - 1), F.floor(F.col(x["key"]) / (1 + F.col(x["key"])) * BUCKETS)).cast("int"))
    totals = rows.groupBy(F.col(source_col).alias("source"), F.col(x["bucket"]).alias("bucket")).agg(
        F.sum(x["size"]).alias("bucket_size"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    upto = Window.partitionBy("source").orderBy("bucket")
    offsets = totals.select("source", "bucket", (F.sum("bucket_size").over(upto) - F.col("bucket_size")).alias("offset"))
    plan = offsets.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    plan = plan.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "offset", "source_size", "target")
    inside = Window.partitionBy(source_col, x["bucket"]).orderBy(x["key"], id_col, x["size"]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn(x["sum"], F.sum(x["size"]).over(inside))
    out = placed.join(plan, matches(placed, plan, {source_col: "p_source", x["bucket"]: "p_bucket"}))
    end, size = F.col("offset") + placed[x["sum"]], placed[x["size"]]
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    rest = F.col("target") - epochs * F.col("source_size")
    drawn = (size > 0) & (rest > 0) & (end - size < rest) & ((end <= rest) | (end - rest <= rest - (end - size)))
    copies = (epochs + drawn.cast("long")).cast("int")
    stats = F.struct(size.alias("size"), F.col("source_size").alias("source_size"), F.col("target").alias("target"),
                     copies.alias("copies"), (copies * size).cast("long").alias("taken"))
    return out.select(*[placed[c] for c in own], stats.alias(info))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    drawn = mix(docs, id_col, text_col, source_col)
    info, n = drawn.columns[-1], fresh(drawn, "copy")
    copies = drawn.where(F.col(info)["copies"] > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(info)["copies"])))
    return copies.select(*docs.columns)

"""Panel windows (W1-W9) on series too long for one task.

``panels`` orders a key's whole series in one task, which is right for years of a state
and wrong for a key that holds a third of all rows. Here a series is cut, in two steps:

1. *Positions.* Rows are range-partitioned by (key, order) and sorted inside each range;
   a range's rows of one key are consecutive, so a row's position in its key is its place
   there plus the rows of earlier ranges (one small row a range and key).
2. *Blocks.* A block is ``rows`` consecutive positions of a key. Frames of a bounded
   number of rows (difference, rolling mean, lead) see copies of the neighbouring
   blocks' edge rows, so they run over the very rows the plain window runs over. What
   depends on the whole past is a running sum or a running maximum: every block gives
   one summary row, the summaries of earlier blocks are its carry, and the block itself
   is scanned again with that carry. The last value that isn't null is the maximum of
   (position, value); a loss streak is the distance to the last row without a loss.

No task holds more than a range or a block with its edges, whatever one key holds; only
summaries (a key's rows / ``rows``) are ordered per key. Equal orders stay in one range
and are ordered by the row's other columns, so only identical rows are interchangeable.
Null keys are a key of their own, null orders come first. An empty table stays empty.
Running sums of whole numbers and decimals equal the plain window's; doubles are added in
another association, so their last digits may differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows a block.
BLOCK_ROWS = 100_000
#: Bits of ``monotonically_increasing_id`` that count the rows inside a partition.
_ROW_BITS = 33


def positions(df: DataFrame, key: str, order: list[str], out: str = "_pos", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 0) in its key's series."""
    ensure_checkpoint_dir(df.sparkSession)
    by = [key, *order]
    ranged = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by, F.xxhash64(*df.columns)).select("*", F.monotonically_increasing_id().alias("_id")).checkpoint()
    part = F.shiftright("_id", _ROW_BITS)
    parts = placed.groupBy(F.col(key).alias("_key"), part.alias("_part")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_key").orderBy("_part")
    starts = parts.select("_key", "_part", "_first", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    joined = placed.join(starts, placed[key].eqNullSafe(starts["_key"]) & (part == starts["_part"]))
    return joined.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias(out))


@dataclass
class Scan:
    """Columns to add. ``frames`` look at most ``back`` rows behind and ``ahead`` rows in front
    of a row; they are functions of a window in the series' order. ``stages`` are row-wise
    columns over frames. ``sums`` and ``last`` take whole pasts: running totals (null where the
    row's own value is null) and last values that aren't null. ``streaks`` are lengths of the
    current run of rows where a condition holds."""

    frames: dict[str, Callable[[WindowSpec], Column]] = field(default_factory=dict)
    stages: dict[str, Column] = field(default_factory=dict)
    sums: dict[str, str] = field(default_factory=dict)
    last: dict[str, str] = field(default_factory=dict)
    streaks: dict[str, Column] = field(default_factory=dict)
    back: int = 1
    ahead: int = 0


def scanned(df: DataFrame, key: str, order: list[str], scan: Scan, rows: int = BLOCK_ROWS,
            ranges: int | None = None, keep_position: str | None = None) -> DataFrame:
    """``df`` with the columns of ``scan``."""
    if max(scan.back, scan.ahead) > rows:
        raise ValueError("a block must hold as many rows as a frame looks behind or ahead")
    own = df.columns
    placed = positions(df, key, order, ranges=ranges).withColumn("_block", F.floor(F.col("_pos") / rows))
    framed = _framed(placed, key, scan, rows)
    framed = framed.select("*", *[c.alias(name) for name, c in scan.stages.items()])
    out = _with_pasts(framed, key, scan) if scan.sums or scan.last or scan.streaks else framed
    added = [*scan.frames, *scan.stages, *scan.sums, *scan.last, *scan.streaks]
    position = [F.col("_pos").alias(keep_position)] if keep_position else []
    return out.select(*own, *position, *added)


def _framed(placed: DataFrame, key: str, scan: Scan, rows: int) -> DataFrame:
    if not scan.frames:
        return placed
    place = F.col("_pos") % rows
    homes = F.array_compact(F.array(F.col("_block"),
                                    F.when(place >= rows - scan.back, F.col("_block") + 1),
                                    F.when((place < scan.ahead) & (F.col("_block") > 0), F.col("_block") - 1)))
    copies = placed.select("*", F.explode(homes).alias("_home"))
    w = Window.partitionBy(key, "_home").orderBy("_pos")
    return copies.select("*", *[f(w).alias(name) for name, f in scan.frames.items()]).where(F.col("_home") == F.col("_block")).drop("_home")


def _with_pasts(framed: DataFrame, key: str, scan: Scan) -> DataFrame:
    # Each past is one aggregate of a column: a sum, or the maximum of (position, value).
    parts: dict[str, tuple[Column, Callable]] = {}
    for name, col in scan.sums.items():
        parts[f"_s_{name}"] = (F.col(col), F.sum)
    for name, col in scan.last.items():
        parts[f"_l_{name}"] = (F.when(F.col(col).isNotNull(), F.struct("_pos", F.col(col).alias("v"))), F.max)
    for name, holds in scan.streaks.items():
        parts[f"_k_{name}"] = (F.when(~F.coalesce(holds, F.lit(False)), F.col("_pos")), F.max)
    rows = framed.select("*", *[c.alias(p) for p, (c, _) in parts.items()])
    blocks = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(*[agg(p).alias(p) for p, (_, agg) in parts.items()])
    past = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carries = blocks.select("_key", "_of", *[agg(p).over(past).alias(f"{p}_c") for p, (_, agg) in parts.items()])
    joined = rows.join(carries, rows[key].eqNullSafe(carries["_key"]) & (rows["_block"] == carries["_of"]))
    w = Window.partitionBy(key, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = {p: agg(p).over(w).alias(f"{p}_u") for p, (_, agg) in parts.items()}
    here = joined.select("*", *upto.values())
    added = []
    for name, col in scan.sums.items():
        total = F.coalesce(F.col(f"_s_{name}_c") + F.col(f"_s_{name}_u"), f"_s_{name}_u")
        added.append(F.when(F.col(col).isNotNull(), total).alias(name))
    for name in scan.last:
        added.append(F.coalesce(F.col(f"_l_{name}_u"), F.col(f"_l_{name}_c"))["v"].alias(name))
    for name in scan.streaks:
        added.append((F.col("_pos") - F.coalesce(f"_k_{name}_u", f"_k_{name}_c", F.lit(-1))).cast("int").alias(name))
    return here.select(*framed.columns, *added)


# W1, W3, W5, W6, W7 of one measure, W2, W4, W8, W9 likewise ----------------------------
def difference(col: str) -> Callable[[WindowSpec], Column]:
    return lambda w: F.col(col) - F.lag(col).over(w)


def rolling_mean(col: str, rows: int) -> Callable[[WindowSpec], Column]:
    return lambda w: F.avg(col).over(w.rowsBetween(-(rows - 1), 0))


def lead(col: str, rows: int = 1) -> Callable[[WindowSpec], Column]:
    return lambda w: F.lead(col, rows).over(w)


def measure_history(df: DataFrame, key: str, order: list[str], measure: str, gappy: str, rows: int = BLOCK_ROWS,
                    ranges: int | None = None) -> DataFrame:
    """A measure's change, rolling means over 3 and 5 rows, next and fifth next value, total change,
    loss flag and loss streak, and the last known value of ``gappy``."""
    change = F.col("change")
    return scanned(df, key, order, Scan(
        frames={"change": difference(measure), "mean_3": rolling_mean(measure, 3), "mean_5": rolling_mean(measure, 5),
                "next_1": lead(measure), "next_5": lead(measure, 5)},
        stages={"is_loss": F.coalesce((change < 0).cast("int"), F.lit(0))},
        sums={"total_change": "change"}, last={"filled": gappy}, streaks={"loss_streak": change < 0},
        back=4, ahead=5), rows, ranges)

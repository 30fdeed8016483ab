"""Nearest neighbours by shifted space-filling curves.

Vectors are scaled to the largest norm and extended by one coordinate, so that the
largest inner product is the smallest distance on a sphere. Each of ``CURVES`` random
orthogonal projections to ``DIMS`` coordinates, shifted at random, is ordered along a
Hilbert curve; Spark range-partitions the (curve, key) rows and every row gets its rank
on its curve. A query's candidates are the rows within ``window`` ranks of it on any
curve: ranks are cut into blocks, queries go to the blocks that their window touches, and
each block is one small group that scores its queries against its rows. The partial
results of a query merge by score.

The window is calibrated: the true neighbours of at most ``SAMPLE`` queries (by hash
order, against all rows in blocks) are looked up on the curves, and the window is the
rank distance that reaches ``RECALL`` of them on their nearest curve. So it follows the
data: narrow where vectors cluster, wide where they are spread evenly.

Identical vectors are one row of the index; of their ids the ``k + 1`` smallest can be
among the k nearest, so those are what a result is expanded to. Blocks are cut by rank,
so no key, however common, makes a large one.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do null ids or vectors of another length than the most frequent one
(the shorter one of equals); rows that repeat are one candidate; fewer candidates than k
give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed

K = 20
CURVES = 16
DIMS = 4
BITS = 8
SAMPLE = 256
RECALL = 0.96
SEED = 20
MIN_BLOCK, MAX_BLOCK = 256, 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates below 2**bits."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    top = 1 << (bits - 1)
    level = top
    while level > 1:  # undo the rotations and reflections from the coarsest level on
        low = level - 1
        for i in range(len(axes)):
            flip = (axes[i] & level) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(flip, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    level = top
    while level > 1:
        turn = np.where(axes[-1] & level, turn ^ (level - 1), turn)
        level >>= 1
    axes = [a ^ turn for a in axes]
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | ((a >> b) & 1)
    return key


def curve_frames(dim: int, curves: int, dims: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, shift) of each curve, from the seed."""
    rng = np.random.default_rng(seed)
    dims = min(dim, dims)
    return [(np.linalg.qr(rng.standard_normal((dim, dims)))[0], rng.random(dims)) for _ in range(curves)]


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _keyed(dim: int, norm: float, curves: int, dims: int, bits: int):
    frames = curve_frames(dim + 1, curves, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vector"), dim)
            own = np.linalg.norm(v, axis=1)
            for asks, scale, rest in ((False, norm, np.sqrt(np.maximum(0, 1 - (own / norm) ** 2))), (True, own, np.zeros(len(v)))):
                rows = batch.filter(batch.column("asks")) if asks else batch
                if not rows.num_rows:
                    continue
                x = np.column_stack([v / np.reshape(scale, (-1, 1)), rest])
                if asks:
                    x = x[batch.column("asks").to_numpy(zero_copy_only=False)]
                for c, (frame, shift) in enumerate(frames):
                    spread = 0.5 + 0.5 * np.tanh(0.8 * np.sqrt(dim) * (x @ frame))
                    cells = np.minimum(((spread + shift) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.num_rows, c, np.int32)), pa.array(hilbert_keys(cells, bits)), rows.column("id"),
                         pa.array(np.full(rows.num_rows, asks)), rows.column("vector")], ["curve", "key", "id", "asks", "vector"])
    return run


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows to be found of each curve in a sorted partition; a query has the number of the next one."""
    curve, seen = -1, 0
    for batch in batches:
        c = batch.column("curve").to_numpy()
        found = ~batch.column("asks").to_numpy(zero_copy_only=False)
        before = np.cumsum(found) - found
        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.array([], int)
        for s, e in zip(starts, np.append(starts[1:], len(c))):
            if c[s] != curve:
                curve, seen = c[s], 0
            part = batch.slice(s, e - s)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in ("part", "curve", "id", "asks", "vector")), pa.array(seen + before[s:e] - before[s])],
                ["part", "curve", "id", "asks", "vector", "place"])
            seen += int(found[s:e].sum())


def ranked(index: DataFrame, dim: int, norm: float, curves: int, dims: int, bits: int) -> DataFrame:
    """(curve, id, asks, vector, rank) for every row and query on every curve."""
    keyed = index.mapInArrow(_keyed(dim, norm, curves, dims, bits),
                             "curve int, key long, id long, asks boolean, vector array<float>")
    # The range partitions are cut by sampling; the checkpoint fixes them for both readers below.
    parts = checkpointed(keyed.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id", "asks")
                         .withColumn("part", F.spark_partition_id()))
    local = parts.mapInArrow(_local_ranks, "part int, curve int, id long, asks boolean, vector array<float>, place long")
    counts = parts.groupBy("curve", "part").agg(F.sum((~F.col("asks")).cast("long")).alias("n"))
    upto = Window.partitionBy("curve").orderBy("part")
    offsets = counts.select("curve", "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    return checkpointed(local.join(offsets, ["curve", "part"]).select(
        "curve", "id", "asks", "vector", (F.col("before") + F.col("place")).alias("rank")))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(ids) > k:
        floor = np.partition(scores, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _scored(dim: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        v = _matrix(table.column("vector").combine_chunks(), dim)
        own, others = ids[~asks], v[~asks]
        rows = []
        if len(own):
            for q, x in zip(ids[asks], v[asks]):
                s = others @ x
                top = _best(s, own, k)
                rows.append((q, own[top], s[top]))
        return pa.table({"query": pa.array([r[0] for r in rows], pa.int64()),
                         "ids": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                         "scores": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})
    return run


def _merged(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks().flatten().to_numpy()
        scores = table.column("scores").combine_chunks().flatten().to_numpy()
        ids, first = np.unique(ids, return_index=True)
        top = _best(scores[first], ids, k)
        return pa.table({"query": pa.array(np.full(len(top), table.column("query")[0].as_py()), pa.int64()),
                         "id": pa.array(ids[top]), "score": pa.array(scores[first][top])})
    return run


def _exact(queries: list[tuple[int, list[float]]], dim: int, k: int):
    ids = np.array([q for q, _ in queries], np.int64)
    asked = np.array([v for _, v in queries], np.float64).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, v = batch.column("id").to_numpy(), _matrix(batch.column("vector"), dim)
            tops = [(_best(s, own, k), s) for s in asked @ v.T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([own[t] for t, _ in tops], pa.list_(pa.int64())),
                 pa.array([s[t] for t, s in tops], pa.list_(pa.float64()))], ["query", "ids", "scores"])
    return run


_PARTIAL = "query long, ids array<long>, scores array<double>"
_RESULT = "query long, id long, score double"


def calibrated_window(index: DataFrame, ranks: DataFrame, dim: int, k: int, sample: int, recall: float) -> int:
    """Ranks on either side that hold ``recall`` of the sampled queries' true neighbours on some curve."""
    chosen = index.where("asks").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vector").collect()
    if not chosen:
        return 1
    queries = [(r["id"], list(r["vector"])) for r in chosen]
    true = (index.select("id", "vector").mapInArrow(_exact(queries, dim, k), _PARTIAL)
            .groupBy("query").applyInArrow(_merged(k), _RESULT).where(F.col("query") != F.col("id")))
    # At most ``sample * k`` pairs.
    true = F.broadcast(checkpointed(true))
    at = ranks.where(~F.col("asks")).select("curve", "id", "rank")
    ours = F.broadcast(ranks.where("asks").join(F.broadcast(true.select("query").distinct()), F.col("id") == F.col("query"))
                       .select("curve", "query", F.col("rank").alias("q_rank")))
    away = (at.join(true, "id").join(ours, ["curve", "query"]).groupBy("query", "id")
            .agg(F.min(F.abs(F.col("rank") - F.col("q_rank"))).alias("away")))
    got = away.agg(F.percentile("away", F.lit(recall)).alias("w")).first()["w"]
    return max(1, int(np.ceil(got or 0)))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K,
           curves: int = CURVES, dims: int = DIMS, bits: int = BITS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose id is divisible by ``every``."""
    value = F.col(vector_col).cast("array<float>")
    fine = (F.col("vec_id").isNotNull() & (F.size("vector") > 0)
            & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
            & F.exists("vector", lambda x: x != 0))
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("vector")).where(
        F.col("vector").isNotNull()).where(fine)
    size = clean.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], out)
    dim = size["dim"]
    rows = clean.where(F.size("vector") == dim).withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")})
    asks = F.col("vec_id") % every == 0
    index = checkpointed(rows.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.first("vector").alias("vector"),
                                                    F.max(asks).alias("asks")))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = float(index.agg(F.sqrt(F.max(square)).alias("m")).first()["m"])
    ranks = ranked(index.select("id", "vector", "asks"), dim, norm, curves, dims, bits)
    window = calibrated_window(index, ranks, dim, k + 1, sample, recall)
    block = int(min(MAX_BLOCK, max(MIN_BLOCK, window)))
    found = ranks.where(~F.col("asks")).select("curve", F.floor(F.col("rank") / block).alias("block"), "id", "asks", "vector")
    reach = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor((F.col("rank") + window) / block))
    asked = ranks.where("asks").select("curve", F.explode(reach).alias("block"), "id", "asks", "vector")
    partial = found.unionByName(asked).groupBy("curve", "block").applyInArrow(_scored(dim, k + 1), _PARTIAL)
    near = checkpointed(partial.groupBy("query").applyInArrow(_merged(k + 1), _RESULT))

    same = Window.partitionBy("h", "g").orderBy("vec_id")
    ids = rows.select("vec_id", "h", "g").distinct()
    members = (ids.withColumn("nr", F.row_number().over(same)).where(F.col("nr") <= k + 1)
               .join(index.select("h", "g", "id"), ["h", "g"]).select("id", "vec_id"))
    queries = ids.where(asks).join(index.select("h", "g", F.col("id").alias("query")), ["h", "g"]).select(
        "query", F.col("vec_id").alias("query_id"))
    full = near.join(members, "id").join(queries, "query").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

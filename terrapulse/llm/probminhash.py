"""Near-duplicates: ProbMinHash signatures of weighted word shingles, banded and verified.

A document is the multiset of its 5-word shingles, weighted by count. Each shingle is a
Poisson process whose rate is its weight; its arrivals fall on random registers, and a
register keeps the shingle that arrives first. A process ends as soon as its next arrival
is later than every register's. Equal registers of two documents estimate their
probability Jaccard, which for shingles that occur once is the plain Jaccard similarity.

Documents with the same words are one class first. Signatures are cut into ``BANDS``
bands of ``ROWS`` registers; classes that share a band are candidates: at a similarity
of 0.8 a pair is missed with a probability of 5e-5. Candidates are verified exactly
(probability Jaccard of the shingle counts), and verified links make classes by
connected components.

No bucket emits all of its pairs: its classes are compared with the smallest one, the
links found are contracted, and only classes of a bucket that still lie in different
components are compared again, those outside the bucket's largest component against
all that aren't in their own. So every candidate pair is either verified or known to be
in one component, and a bucket of copies costs one comparison a member. Buckets around
the same largest component form a region. Regions with up to ``REGION_PAIRS`` pairs left
list them; larger ones are dealt in blocks of nodes, whose pairs are compared exactly
inside the task that holds both blocks, and only links leave it. What is left there are
near misses, so this step alone grows with their number times the region's.

Words are ``[^\\x20\\x09-\\x0D]+`` in lower case. Defined results: texts of one to four
words are one shingle; null and blank texts have none and stay alone; rows that repeat
a doc_id are one document, and if their texts differ it is linked by each of them; a null
doc_id has a null class unless it copies a document that has one; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, fresh, sized, text_key, words
from terrapulse.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: By how much a summed probability Jaccard may lie below the threshold by rounding.
TOLERANCE = 1e-9
BANDS = 25
ROWS = 5
#: Words that one step of the signature code holds at a time (or one document, if longer).
STEP_WORDS = 100_000
#: Pairs left in a region up to which they are listed, and nodes a block of a larger one.
REGION_PAIRS = 1_000
BLOCK = 256


def _gold(k: int) -> np.uint64:
    """The k-th step of a Weyl sequence."""
    return np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted, from the word hashes of documents laid end to end."""
    h = _mixed(hashes.astype(np.int64).view(np.uint64))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    code, room = h.copy(), ends[doc] - np.arange(len(h))
    for k in range(1, SHINGLE):
        follows = np.zeros_like(h)
        follows[:-k or None] = h[k:]
        code = _mixed(code + _gold(k) + np.where(room > k, follows, np.uint64(0)))
    first = np.arange(len(h)) == (ends - lengths)[doc]
    keep = (room >= SHINGLE) | (first & (lengths[doc] < SHINGLE))
    doc, code = doc[keep], code[keep]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], code[starts], np.diff(np.append(starts, len(doc)))


def signatures(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) register contents; documents without shingles keep zeros."""
    time = np.full(n_docs * m, np.inf)
    winner = np.zeros(n_docs * m, np.uint64)
    size = np.bincount(doc, minlength=n_docs)
    # A document with few shingles needs many arrivals of each to fill its registers.
    burst = np.maximum(1, np.minimum(m, (2 * m) // np.maximum(size, 1)))[doc]
    at, step = np.zeros(len(doc)), 0
    while len(doc):
        width = int(burst.max())
        for j in range(width):
            go = burst > j
            d, c = doc[go], code[go]
            r = _mixed(c + _gold(step + j + 1))
            u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            at[go] -= np.log(u) / weight[go]
            slot = d * m + (_mixed(r ^ _gold(1)) % np.uint64(m)).astype(np.int64)
            t = at[go]
            np.minimum.at(time, slot, t)
            won = time[slot] == t
            winner[slot[won]] = c[won]
        step += width
        latest = time.reshape(n_docs, m).max(axis=1)
        alive = at < latest[doc]
        doc, code, weight, burst, at = doc[alive], code[alive], weight[alive], burst[alive], at[alive]
    return winner.reshape(n_docs, m)


def _steps(lengths: np.ndarray) -> Iterator[slice]:
    """Slices of documents with about STEP_WORDS words."""
    group = (np.cumsum(lengths) - lengths) // STEP_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(lengths)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False), offsets


def _banded(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _flat(batch, "hashes")
            lengths = np.diff(offsets)
            for s in _steps(lengths):
                part = lengths[s]
                doc, code, count = shingles(values[offsets[s.start]:offsets[s.stop]], part)
                sig = signatures(doc, code, count.astype(np.float64), len(part), bands * rows)
                keys = np.zeros((len(part), bands), np.uint64)
                for r in range(rows):
                    keys = _mixed(keys + _gold(1) + sig.reshape(len(part), bands, rows)[:, :, r])
                keys = _mixed(keys + np.arange(bands, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * bands, keys.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s.start:s.stop], batch.column("same")[s.start:s.stop],
                                                  lists], ["doc_id", "same", "bands"])
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = _flat(batch, "hashes")
        lengths = np.diff(offsets)
        for s in _steps(lengths):
            part = lengths[s]
            doc, code, count = shingles(values[offsets[s.start]:offsets[s.stop]], part)
            cut = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[s.start:s.stop], pa.ListArray.from_arrays(cut, code.view(np.int64)),
                 pa.ListArray.from_arrays(cut, count.astype(np.int32))], ["node", "codes", "counts"])


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted keys ``a`` and ``b``."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    u, v = x[i].astype(np.float64), y[j].astype(np.float64)
    order = np.argsort(v / u, kind="stable")
    u, v = u[order], v[order]
    ratio = v / u
    # For element i: elements with a ratio up to its own count by x / x_i, the others by y / y_i.
    below = np.cumsum(u)[np.searchsorted(ratio, ratio, side="right") - 1]
    total_v = v.sum()
    above = total_v - np.cumsum(v)[np.searchsorted(ratio, ratio, side="right") - 1]
    only_x, only_y = x.sum() - u.sum(), y.sum() - v.sum()
    return float(np.sum(1.0 / ((only_x + below) / u + (only_y + above) / v)))


def similar(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two weighted sets are at least ``similarity`` alike: sets whose counts are all 1
    by one division of whole numbers, others within ``TOLERANCE`` of the summed value."""
    if x.max(initial=1) == 1 and y.max(initial=1) == 1:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common / max(len(a) + len(b) - common, 1) >= similarity
    return probability_jaccard(a, x, b, y) >= similarity - TOLERANCE


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [_flat(batch, c) for c in ("codes", "counts", "codes_b", "counts_b")]
            keep = []
            for n in range(batch.num_rows):
                a, x, b, y = (v[o[n]:o[n + 1]] for v, o in cols)
                keep.append(similar(a, x, b, y, similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, codes, counts): the shingles of the documents in ``nodes`` (n_id), one row a different text."""
    texts = docs.join(sized(nodes), docs[id_col] == nodes["n_id"], "left_semi").select(
        F.col(id_col).alias("doc_id"), _hashes(F.col(text_col)).alias("hashes"))
    sets = texts.mapInArrow(_counted, "node long, codes array<long>, counts array<int>")
    return sets.repartition("node").dropDuplicates()  # also the partitioning of the joins by node


def _links(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The candidate pairs (a, b) that are similar."""
    nodes = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("n_id")).distinct())
    sets = _sets(nodes, docs, id_col, text_col)
    other = sets.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"), F.col("counts").alias("counts_b"))
    both = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(other, "b")
    return both.select("a", "b", "codes", "counts", "codes_b", "counts_b").mapInArrow(_verified(similarity), "a long, b long")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Common codes of every pair of sets, some columns of the incidence matrices at a time."""
    keys = np.unique(np.concatenate([*x, *y])) if x and y else np.array([], np.int64)
    out = np.zeros((len(x), len(y)))
    for at in range(0, len(keys), columns):
        part = keys[at:at + columns]
        a, b = np.zeros((len(x), len(part)), np.float32), np.zeros((len(y), len(part)), np.float32)
        for m, sets in ((a, x), (b, y)):
            for n, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                m[n, np.searchsorted(part, own)] = 1
        out += a @ b.T
    return out


def _blocks_linked(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        node, root, left = (table.column(c).to_numpy() for c in ("node", "root", "left"))
        columns = [table.column(c).combine_chunks() for c in ("codes", "counts")]
        (codes, cut), (counts, _) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in columns)
        order = [np.argsort(codes[a:b].view(np.uint64), kind="stable") for a, b in zip(cut, cut[1:])]
        sets = [codes[a:b].view(np.uint64)[o] for a, b, o in zip(cut, cut[1:], order)]
        weights = [counts[a:b][o] for a, b, o in zip(cut, cut[1:], order)]
        xs, ys = np.flatnonzero(left), np.flatnonzero(~left)
        common = _overlaps([sets[i] for i in xs], [sets[i] for i in ys])
        size, plain = np.array([len(s) for s in sets]), np.array([not len(w) or w.max() == 1 for w in weights])
        jaccard = common / np.maximum(size[xs][:, None] + size[ys][None, :] - common, 1)
        sure = plain[xs][:, None] & plain[ys][None, :]
        apart = root[xs][:, None] != root[ys][None, :]
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in zip(*np.nonzero(apart & (common > 0) & (~sure | (jaccard >= similarity)))):
            a, b = xs[i], ys[j]
            key = (node[a], root[b])  # one link to a component is enough
            if key not in out and (sure[i, j] or similar(sets[a], weights[a], sets[b], weights[b], similarity)):
                out[key] = (node[a], node[b])
        return pa.table({"a": pa.array([a for a, _ in out.values()], pa.int64()),
                         "b": pa.array([b for _, b in out.values()], pa.int64())})
    return run


def _region_links(region: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Links of the nodes outside a large region's largest component, block by block.

    region: (largest, node, root, n_left, n_all), one row a node of a region.
    """
    nodes = checkpointed(region.select(F.col("node").alias("n_id")).distinct())
    held = region.join(_sets(nodes, docs, id_col, text_col), "node")
    count = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), count(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), count(n) - 1)
    columns = ["node", "root", "codes", "counts"]
    xs = held.where(F.col("root") != F.col("largest")).select(
        "largest", own("n_left").alias("i"), F.explode(all_of("n_all")).alias("j"), *columns, F.lit(True).alias("left"))
    ys = held.select("largest", F.explode(all_of("n_left")).alias("i"), own("n_all").alias("j"), *columns, F.lit(False).alias("left"))
    return xs.unionByName(ys).groupBy("largest", "i", "j").applyInArrow(_blocks_linked(similarity), "a long, b long")


def _several_texts(signed: DataFrame, copies: DataFrame) -> DataFrame:
    """Links (a, b) of documents whose rows have different texts to the classes of these texts."""
    texts = signed.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    ids = checkpointed(texts.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where(
        F.col("low") != F.col("high")).select(F.col("doc_id").alias("n_id")))
    rows = texts.join(sized(ids), F.col("doc_id") == F.col("n_id"), "left_semi").select("doc_id", "same")
    return rows.join(copies.select("same", "node"), "same").where(F.col("doc_id") != F.col("node")).select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id): every document with the smallest doc_id of its class."""
    lowered = F.array_join(words(F.lower(F.col(text_col))), " ")
    same = F.when(lowered != "", F.md5(lowered))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), same.alias("same"), _hashes(F.col(text_col)).alias("hashes"))
    signed = checkpointed(ids.mapInArrow(_banded(bands, rows), "doc_id long, same string, bands array<long>"))
    copies = signed.where(F.col("same").isNotNull()).groupBy("same").agg(
        F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")).where(F.col("node").isNotNull())
    buckets = copies.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1)
    members = checkpointed(buckets.join(shared.select("bucket", "a"), "bucket"))
    pairs = checkpointed(members.where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct())
    links = checkpointed(_links(pairs, docs, id_col, text_col, similarity).unionByName(_several_texts(signed, copies)))
    roots = components(links)

    # What the comparison with the smallest member has left open: buckets over several components.
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).where(
        F.col("parts") > 1).select("bucket", F.col("top.root").alias("largest"))
    region = checkpointed(placed.join(largest, "bucket").select("largest", "node", "root").distinct())
    counts = region.groupBy("largest").agg(
        F.sum((F.col("root") != F.col("largest")).cast("long")).alias("n_left"), F.count("*").alias("n_all"))
    region = checkpointed(region.join(counts, "largest"))
    few = F.col("n_left") * F.col("n_all") <= REGION_PAIRS
    small = region.where(few).select("largest", "node", "root")
    left = small.where(F.col("root") != F.col("largest")).select("largest", F.col("node").alias("x"), F.col("root").alias("x_root"))
    cross = left.join(small, "largest").where(F.col("root") != F.col("x_root")).select(
        F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    more = checkpointed(cross.join(pairs, ["a", "b"], "left_anti"))
    all_links = (links.unionByName(_links(more, docs, id_col, text_col, similarity))
                 .unionByName(_region_links(region.where(~few), docs, id_col, text_col, similarity)))
    roots = components(all_links).select(F.col("node").alias("r_node"), "root")

    nodes = signed.join(copies.select("same", "node"), "same", "left").withColumn("node", F.coalesce("node", "doc_id"))
    return nodes.join(roots, F.col("node") == F.col("r_node"), "left").select(
        "doc_id", F.coalesce("root", "node").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one with the smallest doc_id, and one row of each of its texts."""
    gone = classes(docs, id_col, text_col, similarity).where(F.col("doc_id") != F.col("class_id"))
    gone = checkpointed(gone.select(F.col("doc_id").alias("g_id")).distinct())
    kept = docs.join(sized(gone), docs[id_col] == gone["g_id"], "left_anti")
    key = fresh(docs, "text_key")
    return kept.withColumn(key, text_key(F.col(text_col))).dropDuplicates([id_col, key]).drop(key)

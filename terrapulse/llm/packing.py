"""Best-fit packing of tokenized documents into sequences, by large-item matching.

Documents are cut into pieces of at most ``CAPACITY`` tokens. Pieces above a third of the
capacity are large: greedy matching pairs each, from the largest on, with the largest
partner that still fits, at most two a sequence. Smaller pieces then go, from the largest
on, into the tightest gap that holds them, and open a sequence where none does.

A piece's place depends on its length alone, so the plan is made from the histogram of
lengths: at most ``CAPACITY`` rows, whatever the corpus. It comes as runs: "pieces number
r0 to r1 of length l go to sequences b0 to b1 at offset o". Steps work on whole runs, so
the plan's size depends on the capacity and not on the number of pieces. Pieces are
numbered within their length by hashed groups whose sizes are summed first, so that a
length shared by a third of all pieces is numbered by many tasks. Full pieces, the most
frequent at scale, fill a sequence each: they take any unused number, without a shuffle.

Defined results: null text is empty and is the end token alone; rows that repeat are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed
from terrapulse.llm.texts import Remembered, grouped

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Groups that the pieces of one length are numbered by.
GROUPS = 64
#: Words and their stems remembered, see ``Remembered``.
REMEMBERED, STEMS = 200_000, 100_000
#: Letters that lower-case and normalise one by one, then ASCII punctuation: both are
#: pre-tokens of their own.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of white-space separated words as little-endian bytes, remembered up to a bound.

    The tokenizer drops white space and never joins over it, so a text's ids are its words'
    ids in order. Plain words go straight to the tokenizer's model, the others through all
    of its steps.
    """

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.words, self.stems = Remembered(REMEMBERED, self.word), Remembered(STEMS, self.stem)
        self.tails = Remembered(STEMS, self.whole)
        # how the tokenizer writes each letter beyond ASCII for its model
        self.letters = {c: self.tok.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}

    def whole(self, text: str) -> bytes:
        return _bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def stem(self, letters: str) -> bytes:
        written = letters if letters.isascii() else letters.translate(self.letters)
        return _bytes([t.id for t in self.tok.model.tokenize(written)])

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.stems[word.lower()]
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return self.whole(word)
        letters, tail = plain.groups()
        ids = self.stems[letters.lower()]
        return ids + self.tails[tail] if tail else ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Each distinct word of the texts is looked up once."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        ids = list(map(self.words.__getitem__, coded.dictionary.to_pylist()))
        table, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        word = coded.indices.to_numpy()
        size = sizes[word]
        ends = np.cumsum(size)
        # token k of a word stands k places after the word's first one, here as in the table
        shift = (np.cumsum(sizes) - sizes)[word] - (ends - size)
        tokens = table[np.repeat(shift, size) + np.arange(size.sum())].tobytes()
        cuts = 4 * np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [tokens[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _bytes(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """A worker's memory of words, which outlives its tasks."""
    return WordIds(path)


class _Cutter:
    """Cuts the ids of one document after the other into pieces, as they come."""

    def __init__(self, capacity: int, end_id: int):
        self.full, self.end, self.rows = 4 * capacity, _bytes([end_id]), []
        self.begin(None)

    def begin(self, doc_id: int | None) -> None:
        self.doc_id, self.rest, self.piece, self.start = doc_id, b"", 0, 0

    def add(self, ids: bytes) -> None:
        self.rest += ids
        while len(self.rest) >= self.full:
            self._cut()

    def finish(self) -> None:
        self.add(self.end)
        if self.rest:
            self._cut()

    def _cut(self) -> None:
        part, self.rest = self.rest[:self.full], self.rest[self.full:]
        self.rows.append((self.doc_id, self.piece, self.start, len(part) // 4, zlib.crc32(part)))
        self.piece, self.start = self.piece + 1, self.start + len(part) // 4


def _pieces(path: str, capacity: int, end_id: int):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(path)
        for batch in batches:
            docs, cutter, now = batch.column("doc_id").to_pylist(), _Cutter(capacity, end_id), None
            for group in grouped(batch.column("text")):
                for (row, _), part in zip(group, ids([text for _, text in group])):
                    if row != now:
                        if now is not None:
                            cutter.finish()
                        cutter.begin(docs[row])
                        now = row
                    cutter.add(part)
            if now is not None:
                cutter.finish()
            columns = list(zip(*cutter.rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first piece number, pieces, first sequence, offset) that place every piece."""
    out: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: runs (first sequence, sequences)
    sizes: list[int] = []  # gaps that there are, sorted

    def add_gap(gap: int, first: int, n: int) -> None:
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    def place(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    third = capacity / 3
    large = sorted(n for n in left if n > third)
    open_ = list(large)  # lengths that still have pieces, ascending
    while open_:
        big = open_[-1]
        at = bisect_left(open_, capacity - big + 1) - 1  # the largest partner that fits
        partner = open_[at] if at >= 0 else None
        if partner == big:
            n = left[big] // 2
            if n:
                place(big, n, sequences, 0)
                place(big, n, sequences, big)
                add_gap(capacity - 2 * big, sequences, n)
                sequences += n
            elif at > 0:
                partner = open_[at - 1]
            else:
                partner = None
        if partner is not None and partner != big:
            n = min(left[big], left[partner])
            place(big, n, sequences, 0)
            place(partner, n, sequences, big)
            add_gap(capacity - big - partner, sequences, n)
            sequences += n
            if not left[partner]:
                open_.remove(partner)
        elif partner is None:
            n = left[big]
            place(big, n, sequences, 0)
            add_gap(capacity - big, sequences, n)
            sequences += n
        if not left[big]:
            open_.remove(big)
    for length in sorted((n for n in left if n <= third), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # none fits: as many new sequences as full ones need
                n = -(-left[length] // (capacity // length))
                add_gap(capacity, sequences, n)
                sequences += n
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            take = min(n, left[length])
            place(length, take, first, capacity - gap)
            add_gap(gap - length, first, take)
            if take < n:
                add_gap(gap, first + take, n - take)
    return out


def _placed(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    lengths, starts = np.unique(table[:, 0], return_index=True)
    stops = np.append(starts[1:], len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            row = np.empty(len(length), np.int64)
            for k in np.searchsorted(lengths, np.unique(length)):
                mine = length == lengths[k]
                first = table[starts[k]:stops[k], 1]
                row[mine] = starts[k] + np.searchsorted(first, number[mine], side="right") - 1
            sequence = table[row, 3] + number - table[row, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence), pa.array(table[row, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def numbered(pieces: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... within each length."""
    rows = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    counts = rows.groupBy("length", "grp").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("grp")
    offsets = counts.select(F.col("length").alias("o_length"), F.col("grp").alias("o_grp"),
                            (F.sum("n").over(upto) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("within", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, (F.col("length") == F.col("o_length")) & (F.col("grp") == F.col("o_grp")))
    return joined.select(*pieces.columns, (F.col("before") + F.col("within")).alias("number"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = checkpointed(token_pieces(docs, id_col, text_col, path, capacity, end_id))
    # One row a length: at most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram.pop(capacity, None)
    placed = numbered(pieces.where(F.col("length") < capacity)).mapInArrow(
        _placed(plan(histogram, capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # The plan numbers at most one sequence a piece from 0 on; the checkpoint keeps rows in their places.
    above = F.monotonically_increasing_id() + F.lit(sum(histogram.values()))
    full = pieces.where(F.col("length") == capacity).select(*pieces.columns, above.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)

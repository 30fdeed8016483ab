"""Substring dedup: sliding spans of consecutive sentences, joined globally.

A text is cut after sentence ends and line ends; the pieces concatenate to the text.
From every sentence on, the shortest run of at least ``span`` sentences and ``min_words``
words is hashed (96 bits, over the words and their sentence ends), so that short sentences don't meet by chance.
With ``whole``, as in the registered query, every repeated passage of over 50 words loses its
later copies, but for some words at its edges: runs that end at each sentence are hashed too (shortest
backwards, where no run from a sentence on ends there); sentences of over ``LONG`` words are cut further at
content-defined places (the largest word hash of every ``WINDOW`` words), and so are texts
without blanks, whose characters count as words; runs of at least ``span`` such pieces
and ``LONG_RUN`` words, one of them of a cut sentence, are hashed as well.
The occurrence with the smallest (doc_id, position) is the first one; sentences covered
by any other occurrence are removed.

A task takes its texts in blocks of ``BLOCK_BYTES`` (one text at least), in Arrow batches, and hashes all runs of
a block with prefix sums of words and prefix hashes. Of equal runs in a block only the first goes on: the
others are later ones whatever the other tasks hold, and only the places they cover go on, merged. So a passage shared by
a third of all documents costs one row a block. One shuffle by run hash finds the first of all blocks, the
rows that aren't it go to their document, where only positions to remove are gathered.

Defined results: null text stays null and has no sentences; texts of fewer than
``span`` sentences or ``min_words`` words are unchanged; rows that repeat a doc_id and text are one document;
an empty table gives an empty result; other columns pass through. A text of more than
``BLOCK_BYTES`` is a block of its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapulse.llm.common import fresh, matches, text_key

SPAN = 2
MIN_WORDS = 10
#: Words up to which a sentence isn't cut, words a cut looks over, and words of a run of cut sentences:
#: 51 common words hold such a run, or one of two sentences, wherever they begin.
LONG = 16
WINDOW = 16
LONG_RUN = 20
#: Text a task hashes at a time, and word hashes it remembers.
BLOCK_BYTES = 8 << 20
KEPT_WORDS = 1 << 20
#: Multipliers of the prefix hashes (odd) and what the last word of a sentence adds.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_END = 0xA0761D6478BD642F
#: Characters of scripts without blanks, and their sentence ends.
_DENSE = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
          "\uf900-\ufaff\U00020000-\U0003ffff")
_BLANK = r"\x20\x09-\x0D"
#: Zero-width places after a sentence end and its blank, or after a line end.
BREAK = r"(?<=[.!?][\x20\x09\r])|(?<=\n)"
_BREAK = re.compile(BREAK.encode())
_DENSE_BREAK = re.compile(BREAK + "|(?<=[\u3002\uff01\uff1f])")
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_DENSE_WORD = re.compile(f"[{_DENSE}]|[^{_BLANK}{_DENSE}]+")
#: Items: words with the blanks after them, and blanks that begin a sentence.
_ITEM = re.compile(f"[^{_BLANK}]+[{_BLANK}]*|[{_BLANK}]+".encode())
_DENSE_ITEM = re.compile(f"(?:[{_DENSE}]|[^{_BLANK}{_DENSE}]+)[{_BLANK}]*|[{_BLANK}]+")


class _Hashes(dict):
    """Hashes of words, computed once while they are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def _sentences(text: str | None, whole: bool) -> Iterator[tuple]:
    """(sentence, its words, whether it begins with a blank); bytes, or str with scripts without blanks."""
    text = text or ""
    if whole and not text.isascii() and _HAS_DENSE.search(text):
        for s in filter(None, _DENSE_BREAK.split(text)):
            yield s, [w.encode() for w in _DENSE_WORD.findall(s)], s[0] in " \t\n\x0b\x0c\r"
    else:
        for s in filter(None, _BREAK.split(text.encode())):
            yield s, s.split(), s[:1].isspace()


@dataclass
class Units:
    """Sentences, or the parts they are cut into, that hold a word: one entry each, in order."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: np.ndarray
    cut: np.ndarray

    @classmethod
    def held(cls, *columns: np.ndarray) -> Units:
        keep = columns[3] > 0
        return cls(*[c[keep] for c in columns])


@dataclass
class Layout:
    """The pieces of a block of texts. Items are words, and a blank that begins a long sentence."""

    ends: np.ndarray        # whether a piece ends at an item
    text_items: np.ndarray  # items before each text, and all
    n_pieces: np.ndarray    # pieces a text
    words: np.ndarray       # word hashes
    sentences: Units
    parts: Units


def layout(texts: list[str | None], whole: bool) -> Layout:
    hashes, known = array("Q"), _Hashes()
    owner, size, lead = array("q"), array("q"), array("b")
    text_items = np.zeros(len(texts) + 1, np.int64)
    blank = known[b""]
    for d, text in enumerate(texts):
        for _, words, begins_blank in _sentences(text, whole):
            extra = begins_blank and len(words) > LONG
            if extra:
                hashes.append(blank)
            hashes.extend(map(known.__getitem__, words))
            owner.append(d)
            size.append(len(words) + extra)
            lead.append(extra)
        text_items[d + 1] = len(hashes)
    items = np.array(hashes, np.uint64)
    doc, n_items, lead = np.array(owner, np.int64), np.array(size, np.int64), np.array(lead, np.int64)
    stop = np.cumsum(n_items)
    start = stop - n_items
    n_words = n_items - lead
    ends = np.zeros(len(items), bool)
    ends[stop[n_items > 0] - 1] = True
    sentence = np.repeat(np.arange(len(doc)), n_items)
    if whole and len(items) >= WINDOW:
        # A hash with the place in its last 32 bits; the largest of WINDOW places by doubling.
        best = (items.astype(np.uint32).view(np.int32).astype(np.int64) << 32) + np.arange(len(items))
        step = 1
        while step < WINDOW:
            ahead = min(step, WINDOW - step)
            best = np.maximum(best[:-ahead], best[ahead:])
            step += ahead
        inside = sentence[:len(best)]
        within = (n_words[inside] > LONG) & (np.arange(len(best)) + WINDOW <= stop[inside])
        ends[best[within] & 0xFFFFFFFF] = True
    ended = np.concatenate([[0], np.cumsum(ends)])
    n_parts = np.maximum(ended[stop] - ended[start], 1)
    before = np.cumsum(n_parts) - n_parts
    number = before - before[np.searchsorted(doc, doc)]
    is_word = np.ones(len(items), bool)
    is_word[start[lead > 0]] = False
    so_far = np.concatenate([[0], np.cumsum(is_word)])
    place = np.flatnonzero(ends)
    of = sentence[place]
    part_number = number[of] + np.arange(len(place)) - ended[start[of]]
    part_words = np.diff(so_far[place + 1], prepend=0)
    return Layout(
        ends, text_items, np.bincount(doc, n_parts, len(texts)).astype(np.int64), items[is_word],
        Units.held(doc, number, number + n_parts - 1, n_words, np.zeros(len(doc), bool)),
        Units.held(doc[of], part_number, part_number, part_words, n_parts[of] > 1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _runs(u: Units, hashes: np.ndarray, span: int, at_least: int, both: bool, only_cut: bool) -> list[np.ndarray]:
    """(text, first piece, last piece, two hashes) of every run."""
    n = len(u.words)
    upto = np.concatenate([[0], np.cumsum(u.words)])
    low, high = np.searchsorted(u.doc, u.doc, "left"), np.searchsorted(u.doc, u.doc, "right")
    every = np.arange(n)
    # A unit has a word at least, so the words before each unit increase and a run's end is one search.
    a, b = every, np.maximum(every + span, np.searchsorted(upto, upto[:-1] + at_least, "left"))
    ok = b <= high
    a, b = a[ok], b[ok]
    if both:
        z = every + 1
        y = np.minimum(z - span, np.searchsorted(upto, upto[1:] - at_least, "right") - 1)
        # If the run needs its last unit, the run from its first unit on is the same.
        ok = (y >= low) & (z - y > span) & (upto[z - 1] - upto[np.maximum(y, 0)] >= at_least)
        a, b = np.concatenate([a, y[ok]]), np.concatenate([b, z[ok]])
    if only_cut:
        cuts = np.concatenate([[0], np.cumsum(u.cut)])
        ok = cuts[b] > cuts[a]
        a, b = a[ok], b[ok]
    marked = hashes.copy()
    marked[upto[1:] - 1] += np.uint64(_END)
    found = []
    for base in _BASES:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marked * _powers(base, len(marked))[:-1], dtype=np.uint64)])
        back = _powers(pow(base, -1, 1 << 64), len(marked))
        found.append((sums[upto[b]] - sums[upto[a]]) * back[upto[a]])
    return [u.doc[a], u.first[a], u.last[b - 1], found[0].view(np.int64), (found[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)]


def block_runs(texts: list[str | None], span: int, min_words: int, whole: bool) -> tuple[np.ndarray, ...]:
    """(text, first piece, last piece, h, g) of all runs of a block of texts."""
    at = layout(texts, whole)
    found = [_runs(at.sentences, at.words, span, min_words, whole, False)]
    if whole:
        found.append(_runs(at.parts, at.words, span, max(LONG_RUN, min_words), True, True))
    return tuple(np.concatenate(c) for c in zip(*found))


def _first_and_later(doc, start, end, h, g) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Row numbers of the first of equal runs, and (text, first piece, last piece) that others cover, merged."""
    place = (doc << 32) | start
    order = np.lexsort((place, g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    firsts = order[new]
    # Equal runs at one place are one.
    other = order[~new & (place[order] != place[firsts][np.cumsum(new) - 1])] if len(order) else order
    other = other[np.argsort(place[other], kind="stable")]
    low, high = place[other], (doc[other] << 32) | end[other]
    reach = np.maximum.accumulate(high) if len(high) else high
    opens = np.ones(len(low), bool)
    opens[1:] = low[1:] > reach[:-1] + 1
    closes = np.append(opens[1:], True)[:len(low)]
    low, high = low[opens], reach[closes]
    return firsts, (low >> 32, low & 0xFFFFFFFF, high & 0xFFFFFFFF)


def _blocks(lengths: np.ndarray) -> Iterator[slice]:
    """Neighbouring texts of ``BLOCK_BYTES`` together."""
    number = np.cumsum(lengths) // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(lengths)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if a < b)


def runs(docs: DataFrame, id_col: str, text_col: str, span: int, min_words: int, whole: bool = False) -> DataFrame:
    """(doc_id, text_key, pieces, h, g): the first of equal runs in a block of texts by the piece numbers it begins
    and ends with (in one long, as every run is shuffled); and, with null ``g``, the pieces of a document
    that runs other than the first cover."""
    text = F.col(text_col)
    # Later rows have no run hash; they are spread by document.
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    source = source.withColumn("spread", F.xxhash64("doc_id", "text_key"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("pieces", T.LongType()),
                           T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType())])
    names = [f.name for f in schema]

    def rows(batch: pa.RecordBatch, which: np.ndarray, start, end, h, g: pa.Array) -> pa.RecordBatch:
        rows = pa.array(which)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start << 32) | end), pa.array(h), g], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for part in _blocks(pc.fill_null(pc.binary_length(whole_batch.column(2)), 0).to_numpy(zero_copy_only=False)):
                batch = whole_batch.slice(part.start, part.stop - part.start)
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                # In the order of places, each document once.
                once = {k: i for i, k in reversed(list(enumerate(keys)))}
                order = np.array([once[k] for k in sorted(once, key=lambda k: (k[0] is not None, 0 if k[0] is None else k[0], k[1]))], np.int64)
                found = block_runs(batch.column(2).take(pa.array(order)).to_pylist(), span, min_words, whole)
                firsts, (doc, start, end) = _first_and_later(*found)
                yield rows(batch, order[found[0][firsts]], found[1][firsts], found[2][firsts], found[3][firsts], pa.array(found[4][firsts]))
                if len(doc):
                    spread = batch.column(3).take(pa.array(order[doc])).to_numpy(zero_copy_only=False)
                    yield rows(batch, order[doc], start, end, spread, pa.nulls(len(doc), pa.int32()))

    return source.mapInArrow(hashed, schema)


def repeated_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                    min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """(r_id, r_key, removed): the piece numbers of a document that a non-first repeated span covers."""
    every = runs(docs, id_col, text_col, span, min_words, whole)
    place = F.struct("doc_id", "text_key", "pieces")
    # A run has one row a block of texts at most, and a document's later rows are few.
    first = F.min(place).over(Window.partitionBy("h", "g"))
    later = every.withColumn("first", first).where(F.col("g").isNull() | ~place.eqNullSafe(F.col("first")))
    gathered = later.groupBy("doc_id", "text_key").agg(F.collect_set("pieces").alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(
        F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))))
    return gathered.select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"),
                           F.sort_array(covered).alias("removed"))


def _pieces(text: str | None, whole: bool, ends: np.ndarray) -> list[str]:
    """The pieces of a text by its items' ends."""
    out, at = [], 0
    for s, words, begins_blank in _sentences(text, whole):
        size = len(words) + (begins_blank and len(words) > LONG)
        cuts = np.flatnonzero(ends[at:at + size]) + 1
        at += size
        if len(cuts) < 2:
            parts = [s]
        else:
            items = (_ITEM if isinstance(s, bytes) else _DENSE_ITEM).findall(s)
            parts = [s[:0].join(items[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]
        out += [p.decode() if isinstance(p, bytes) else p for p in parts]
    return out


def _rest(texts: list[str | None], removed: list, whole: bool) -> Iterator[tuple[str | None, int]]:
    """(text without the removed pieces, number of pieces)."""
    at = layout(texts, whole)
    for i, (text, gone) in enumerate(zip(texts, removed)):
        if gone is not None:
            ends, gone = at.ends[at.text_items[i]:at.text_items[i + 1]], set(gone.tolist())
            # Copies lose all pieces.
            text = "" if len(gone) == at.n_pieces[i] else "".join(p for n, p in enumerate(_pieces(text, whole, ends)) if n not in gone)
        yield text, at.n_pieces[i]


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """``docs`` with the text cleaned, and a struct column ``span_dedup`` (n_pieces, n_removed, removed)."""
    key, info = fresh(docs, "text_key"), fresh(docs, "span_dedup")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    gone = repeated_pieces(docs, id_col, text_col, span, min_words, whole)

    @F.pandas_udf("text string, n_pieces int")
    def rest(text: pd.Series, removed: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        out = []
        for part in _blocks(np.array([len(t or "") for t in texts], np.int64)):
            out += _rest(texts[part], removed.iloc[part].tolist(), whole)
        return pd.DataFrame(out, columns=["text", "n_pieces"])

    joined = keyed.join(gone, matches(keyed, gone, {id_col: "r_id", key: "r_key"}), "left")
    cleaned = fresh(joined, "rest")
    joined = joined.withColumn(cleaned, rest(keyed[text_col], F.col("removed")))
    removed = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    stats = F.struct(F.col(cleaned)["n_pieces"].alias("n_pieces"), F.size(removed).alias("n_removed"),
                     removed.alias("removed"))
    return joined.select(*[F.col(cleaned)["text"].alias(c) if c == text_col else keyed[c] for c in docs.columns], stats.alias(info))

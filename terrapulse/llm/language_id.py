"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

A text is lower-cased; every run of characters that aren't letters is one word boundary.
Its subwords are the runs of 2 to 4 characters of a word together with its two boundaries,
hashed into a fixed number of buckets. A text's vector is the mean of its subwords'
embeddings, and a linear softmax over it gives the language. Embeddings and softmax are
trained together by stochastic gradient descent in numpy; a temperature and a rejection
threshold are then fitted on rows that the descent hasn't seen.

* Fitting: at most ``FIT_ROWS`` labelled documents a language, those with the smallest
  seeded hash of id and text. Only their keys are ranked; the texts are read by a join
  with these few keys. Whole texts become sparse counts (at most one entry a bucket) in
  Spark tasks, and one task descends over that bounded sample.
* Scoring: embeddings and softmax are both linear, so they are multiplied into one number a
  bucket and language before the tasks get them (a megabyte a few languages). A
  task then adds up rows of that table, text by text and in parts of bounded size; nothing
  is shuffled.
* Rejection: ``accepted`` is false where the calibrated probability is below the smallest
  threshold that keeps ``PRECISION`` of the calibration rows above it right. The language
  is named all the same, so that callers can choose.

Defined results: null text or text without a letter is ``und`` with score 0 and not
accepted; where nothing is labelled every text is; a null id counts as the empty id; rows
with a null language are predicted but not learned from; repeated rows are predicted
alike; an empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import checkpointed, fresh

#: Labelled documents a language that fit the model; every fifth of them calibrates it.
FIT_ROWS = 400
BITS = 14
SIZES = (2, 3, 4)
DIMENSIONS, EPOCHS, RATE, BATCH = 16, 12, 0.5, 16
#: Few rows are passed over more often, up to so many steps.
LEAST_STEPS = 600
SEED = 13
#: Share of right answers wanted among the accepted ones.
PRECISION = 0.99
UNKNOWN = "und"
#: Characters of a text that are looked at together.
PART = 1 << 18


# Subwords ---------------------------------------------------------------------------

@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


def _parts(text: str) -> Iterator[np.ndarray]:
    """Letters of a text with one 0 for every run of others, in parts cut at boundaries if there are any."""
    rest = np.zeros(1, np.uint32)
    for at in range(0, len(text), PART):
        codes = np.frombuffer(text[at:at + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(0))
        codes = np.concatenate([rest, codes])
        if at + PART >= len(text):
            codes = np.concatenate([codes, np.zeros(1, np.uint32)])
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[0] = True
        codes = codes[keep]
        # What follows the last boundary goes on in the next part; a longer word is cut.
        stop = int(np.flatnonzero(codes == 0)[-1]) if not codes.all() else 0
        if len(codes) - stop > PART or at + PART >= len(text):
            stop = len(codes) - 1
        rest = codes[stop:]
        yield codes[:stop + 1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


def subword_buckets(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a whole text, part by part."""
    for codes in _parts(text):
        # Runs that hold a boundary inside belong to no word.
        inner = np.cumsum(codes == 0)
        h = codes * np.uint32(0x9E3779B1)
        for n in range(2, max(SIZES) + 1):
            if len(codes) < n:
                break
            tail = codes[n - 1:]
            h = (h[:len(tail)] * np.uint32(0x01000193)) ^ (tail * np.uint32(0x85EBCA6B))
            if n in SIZES:
                whole = inner[n - 2:len(codes) - 1] == inner[:len(tail)]
                # A run of two may be a letter and a boundary, but not two boundaries.
                yield _mixed(h[whole] + np.uint32(n)) >> np.uint32(32 - bits)


def sparse_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares of the text's subwords)."""
    total = np.zeros(1 << bits, np.int64)
    for buckets in subword_buckets(text, bits):
        total += np.bincount(buckets, minlength=1 << bits)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


# Fitting ----------------------------------------------------------------------------

class Model:
    """Bucket embeddings times softmax, languages, temperature and threshold."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, languages: list[str], temperature: float, threshold: float):
        self.table, self.bias, self.languages = table, bias, languages
        self.temperature, self.threshold = temperature, threshold

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        bits = self.table.shape[0].bit_length() - 1
        for buckets in subword_buckets(text, bits):
            counts = np.bincount(buckets, minlength=len(self.table)) if len(buckets) > 4096 else None
            total += self.table[buckets].sum(0) if counts is None else counts @ self.table
            n += len(buckets)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, bits: int = BITS,
            seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias by stochastic gradient descent on sparse rows."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1 / DIMENSIONS, (1 << bits, DIMENSIONS))
    w, b = np.zeros((DIMENSIONS, n_labels)), np.zeros(n_labels)
    one = np.eye(n_labels)
    batches = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, batches)))
    steps, done = epochs * batches, 0
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            x = np.stack([rows[i][1] @ e[rows[i][0]] for i in batch])
            slope = (softmax(x @ w + b) - one[labels[batch]]) / len(batch)
            back = slope @ w.T
            w -= rate * x.T @ slope
            b -= rate * slope.sum(0)
            # A bucket's share of a text is small, so embeddings take steps by the number of buckets.
            for i, g in zip(batch, back):
                buckets, shares = rows[i]
                e[buckets] -= rate * len(buckets) * shares[:, None] * g
    return e, w, b


def calibrate(logits: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """Temperature of the least log loss, and the smallest threshold that keeps ``precision`` right.

    Labels are smoothed by one row in all, so that rows without an error don't call for certainty;
    a threshold lies halfway to the next lower probability, or to chance below the lowest."""
    if not len(labels):
        return 1.0, 0.0
    n, k = logits.shape
    want = np.full((n, k), 1 / (n + 2) / k)
    want[np.arange(n), labels] += 1 - 1 / (n + 2)
    grid = np.geomspace(0.02, 50, 161)
    loss = [-(want * np.log(np.maximum(softmax(logits / t), 1e-12))).sum() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    best, right = p.max(1), p.argmax(1) == labels
    order = np.argsort(-best, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, n + 1)
    # Rows of equal probability are accepted together.
    last = np.append(best[order][1:] != best[order][:-1], True)
    good = np.flatnonzero((share >= precision) & last)
    if not len(good):
        return temperature, 1.0
    below = np.append(best[order], 1 / k)
    return temperature, float((below[good[-1]] + below[good[-1] + 1]) / 2)


def _encoded(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    pairs = [sparse_counts(t, bits) for t in rows["text"]]
    return pd.DataFrame({"label": rows["label"], "k": rows["k"], "buckets": [p[0] for p in pairs],
                         "shares": [p[1] for p in pairs]})


def _fit_rows(rows: pd.DataFrame, bits: int, seed: int, precision: float) -> bytes:
    rows = rows.sort_values(["label", "k"], kind="stable")
    languages = sorted(set(rows["label"]))
    labels = np.array([languages.index(x) for x in rows["label"]])
    data = list(zip(rows["buckets"].map(np.asarray), rows["shares"].map(np.asarray)))
    tests = rows["k"].to_numpy() % 5 == 4
    fit = np.flatnonzero(~tests)
    e, w, b = descend([data[i] for i in fit], labels[fit], len(languages), bits, seed)
    table = e @ w
    held = np.flatnonzero(tests)
    logits = np.array([data[i][1] @ table[data[i][0]] + b for i in held]).reshape(len(held), len(languages))
    temperature, threshold = calibrate(logits, labels[held], precision)
    out = io.BytesIO()
    np.savez(out, table=table.astype(np.float32), bias=b, languages=np.array(languages, dtype=str),
             scale=np.array([temperature, threshold]))
    return out.getvalue()


def fit_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, rows: int, seed: int) -> DataFrame:
    """(label, k, text) of at most ``rows`` learnable documents a language; k counts them from 0."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    keys = known.select(F.col(lang_col).alias("label"), draw.alias("draw"))
    # Copies of one row are one; only the first rows of a language leave a task.
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw")) - 1
    keys = checkpointed(keys.distinct().withColumn("k", place).where(F.col("k") < rows))
    found = known.select(F.col(lang_col).alias("label"), draw.alias("draw"), F.col(text_col).alias("text"))
    return found.join(F.broadcast(keys), ["label", "draw"]).dropDuplicates(["label", "draw"]).select("label", "k", "text")


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = FIT_ROWS, bits: int = BITS, seed: int = SEED, precision: float = PRECISION) -> Model:
    """The model of the rows that ``learn`` allows."""
    sample = fit_sample(docs, learn, id_col, text_col, lang_col, rows, seed)

    def encode(batches):
        for rows in batches:
            yield _encoded(rows, bits)

    sparse = sample.mapInPandas(encode, "label string, k int, buckets array<int>, shares array<float>")
    found = sparse.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        lambda rows: pd.DataFrame({"model": [_fit_rows(rows, bits, seed, precision)]}), "model binary").first()
    if found is None:
        return Model(np.zeros((1 << bits, 0), np.float32), np.zeros(0), [], 1.0, 1.0)
    z = np.load(io.BytesIO(bytes(found["model"])))
    return Model(z["table"], z["bias"], [str(x) for x in z["languages"]], *map(float, z["scale"]))


# Scoring ----------------------------------------------------------------------------

RESULT = "lang_pred string, score double, accepted boolean"


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language`` of lang_pred, score and accepted (its name is
    preceded by underscores where ``docs`` has such a column)."""
    @F.pandas_udf(RESULT)
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return docs.withColumn(fresh(docs, "language"), language(F.col(text_col)))


def held_out(id_: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % 4 == 2

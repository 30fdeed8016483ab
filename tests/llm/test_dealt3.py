"""Importance resampling, filter audit and language identification."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from cases import SCHEMA, rows, words
from pyspark.sql import functions as F

from terrapulse.llm import filter_audit, language_id, resampling
from terrapulse.llm.common import read

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def grams(text, run=1):
    w = PLAIN.findall((text or "").translate(ASCII_LOWER))
    return w, [" ".join(w[i:i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


# importance resampling

def brute_resample(docs, target, percent=10, min_words=20, run=1, buckets=10_000, seed=2024):
    s = Counter(bucket(f, buckets) for _, t in docs for f in grams(t, run)[1])
    t = Counter(bucket(f, buckets) for x in target for f in grams(x, run)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
            for b in range(buckets)]
    out = []
    for i, text in docs:
        w, f = grams(text, run)
        weight = sum(gain[bucket(x, buckets)] for x in f)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(w), len(f), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = n
    return out


def plain(df):
    return sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank] for r in df.collect()), key=repr)


@pytest.mark.parametrize("run, percent", [(1, 10), (2, 50), (3, 0)])
def test_resample_is_brute_force(spark, odd, run, percent):
    target = ["words follow here in plain text", "The window of the HOUSE", None, ""]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(odd, t, percent=percent, run=run, buckets=500)
    docs = [(r[0], r[1]) for r in rows()]
    assert plain(got) == sorted(brute_resample(docs, target, percent, run=run, buckets=500), key=repr)


def test_resample_whole_table(spark, small_dir):
    docs = read(spark, small_dir, "documents")
    bench = read(spark, small_dir, "benchmark")
    got = plain(resampling.resample(docs, bench))
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert got == sorted(want, key=repr) and sum(r[5] is not None for r in got) >= 10


def test_resample_without_target_and_rows(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert plain(resampling.resample(odd, none)) == sorted(brute_resample([(r[0], r[1]) for r in rows()], []), key=repr)
    empty = resampling.resample(odd.where("false"), none)
    assert empty.count() == 0 and [t for _, t in empty.dtypes] == ["bigint"] * 7


@pytest.mark.parametrize("parts", [1, 7])
def test_cutoff_by_weighted_medians(spark, parts):
    """Every rank of uneven partitions, with ties and rows equal in every key, down to the last row."""
    values = [(i * 7919) % 23 if i % 3 else i for i in range(400)] + [5] * 90
    df = spark.createDataFrame([(v, 0, v % 4, 1) for v in values], "s long, null_id long, id long, tie long")
    df = (df.repartition(parts, "s") if parts > 1 else df.coalesce(1)).sortWithinPartitions("s", "null_id", "id", "tie").checkpoint()
    keys = sorted((v, 0, v % 4, 1) for v in values)
    for n in (1, 245, 490):
        assert resampling.cutoff(df, n, last=0) == resampling.cutoff(df, n, last=50) == keys[n - 1]
    assert resampling.cutoff(df, 0) is None


def test_resample_ranks_hot_ties(spark):
    """A third of the rows are one document: as many of them are drawn as there is room for."""
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(7, text)] * 40 + [(i, text + f" x{i}") for i in range(100, 180)], "doc_id long, text string")
    t = spark.createDataFrame([("w1 w2",)], "text string")
    got = plain(resampling.resample(df.repartition(9), t, percent=35))
    ranks = sorted(r[5] for r in got if r[5] is not None)
    assert ranks == list(range(1, 43))
    assert got == sorted(brute_resample([(r.doc_id, r.text) for r in df.collect()], ["w1 w2"], 35), key=repr)


# filter audit

LABELS = [(0, 1, 0), (1, 0, 1), (3, 1, 1), (5, 1, 0), (6, 1, 0), (7, 1, 0), (7, 0, 1), (13, None, 1), (None, 1, 1), (999, 1, 1)]


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, s in docs:
        t, w = t or "", words(t)
        fails = {x for x, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i)) if bad}
        parts.setdefault(s or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, found in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [d for d in found if f in d[0] and not d[0] & before]
                out[part, order, k + 1] = [
                    sum(not d[0] & (before | {f}) for d in found), len(here),
                    sum(f in d[0] and bool(d[0] & before) for d in found), sum(d[0] == {f} for d in found),
                    sum(d[1] for d in here), sum(d[2] for d in here)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == f)
            for (p, o, k), v in out.items():
                if p == part and o[k - 1] == f:
                    v.append(total)
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in df.collect()}


def test_audit_is_brute_force(spark, odd):
    extra = [(30, "", "a", 0), (31, "Same TEXT $ here", "b", 0), (32, "Same TEXT $ here", None, 0), (31, "Same TEXT $ here", "c", 0),
             (None, "Same TEXT $ here", "b", 0), (33, " ".join(f"w{i}" for i in range(60)), "b", 0)]
    df = odd.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("id", F.lit("x")).withColumn("mask", F.lit(9))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute_audit([(r.doc_id, r.text, r.source) for r in df.collect()], LABELS)
    assert audited(filter_audit.audit(df, labels)) == want
    assert audited(filter_audit.audit(df.withColumnRenamed("text", "body").withColumnRenamed("source", "mask0"), labels,
                                      text_col="body", part_col="mask0")) == want


def test_audit_of_nothing(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(odd.where("false"), labels).count() == 0
    assert audited(filter_audit.audit(odd, labels.where("false"))) == brute_audit([r[:3] for r in rows()], [])


def test_audit_hot_copies_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.part: r.kept for r in filter_audit.audit(df.repartition(8), labels).where("filter_order = 'ABCDE' AND step = 5").collect()}
    assert kept == {"s0": 1, "s1": 0, "s2": 0}


def test_least_squares_gives_shapley_values():
    """The constrained normal equations against the mean over all orders, for any game."""
    rng = np.random.default_rng(1)
    v = [0, *map(int, rng.integers(0, 1000, 31))]
    by_order = [Fraction(0)] * 5
    for order in permutations(range(5)):
        s = 0
        for f in order:
            by_order[f] += Fraction(v[s | 1 << f] - v[s], 120)
            s |= 1 << f
    assert [sum(c * x for c, x in zip(row, v)) for row in filter_audit.shapley_coefficients()] == by_order


# language identification

def learn():
    return ~language_id.held_out(F.col("doc_id"))


def test_language_of_held_out_documents(spark, small_dir):
    docs = read(spark, small_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, learn()))
    held = found.where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "language.*").collect()
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.8 * len(held) and sum(r.lang == r.lang_pred for r in sure) >= 0.97 * len(sure)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_learns_from_text_and_allowed_rows_only(spark, small_dir):
    docs = read(spark, small_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    twisted = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    a, b = language_id.fit(docs, learn()), language_id.fit(twisted.repartition(5), learn())
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.temperature == b.temperature


def test_language_odd_texts(spark):
    texts = [None, "", " \n", "123 $$", "x", "the house and the garden " * 30, "das Haus und der Garten " * 30, "Ünï 😀 cödé",
             "the " * 200_000, "t" * 600_000]
    data = [(i, t, ("en", "de")[i % 2]) for i, t in enumerate(["the house and the garden", "das haus und der garten"] * 60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    odd = spark.createDataFrame([(t, "en", 1) for t in texts] * 2, "text string, language string, lang_pred int")
    got = language_id.identify(odd, model).select("text", "_language.*").collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in got[:4]] == [("und", 0.0, False)] * 4
    assert [r.lang_pred for r in got[5:7]] == ["en", "de"] and {r.lang_pred for r in got[4:10]} <= {"en", "de"}
    assert [tuple(r) for r in got[:10]] == [tuple(r) for r in got[10:]]
    nothing = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {tuple(r) for r in language_id.identify(odd, nothing).select("_language.*").collect()} == {("und", 0.0, False)}
    assert language_id.identify(odd.where("false"), model).count() == 0
    assert language_id.fit(docs.where("lang = 'en'"), F.lit(True)).predict("garden")[:2] == ("en", 1.0)


def test_subwords_of_long_texts_come_part_by_part(monkeypatch):
    """Parts give the subwords of the whole text, whatever their size."""
    text = "Über den Häusern, 12 der ältere Mann; l'été d'où ça " * 40

    def brute():
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = "\0" + w + "\0"
            out.update(w[i:i + n] for n in language_id.SIZES for i in range(len(w) - n + 1))
        return sum(out.values()), len(out)

    whole = Counter(np.concatenate(list(language_id.subword_buckets(text, 20))).tolist())
    assert sum(whole.values()) == brute()[0] and abs(len(whole) - brute()[1]) <= 1
    for part in (64, 100, 333):
        monkeypatch.setattr(language_id, "PART", part)
        assert Counter(np.concatenate(list(language_id.subword_buckets(text, 20))).tolist()) == whole


def test_calibration():
    logits = np.array([[4.0, 0], [3, 0], [2.5, 0], [1, 0], [0.5, 0]])
    t, threshold = language_id.calibrate(logits, np.array([0, 0, 0, 1, 0]), 0.99)
    p = language_id.softmax(logits / t).max(1)
    assert p[3] < threshold < p[2] and language_id.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == (1.0, 0.0)
    t, threshold = language_id.calibrate(logits, np.zeros(5, int))
    assert 0.5 < threshold < language_id.softmax(logits / t).max(1).min()
    assert language_id.calibrate(logits, np.ones(5, int))[1] == 1.0

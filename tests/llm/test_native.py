"""Quality rules, span dedup, licence scan, PII, mixing and line templates on odd cases and small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import (PASSAGE, SCHEMA, base_measures, base_spans, cut, phrase_places, removed_pieces, rows,
                   whole_removed, words)
from pyspark.sql import functions as F

from terrapulse.llm import license_scan, line_templates, mixing, pii, quality_llr, span_dedup
from terrapulse.llm.common import read

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (10, 1, 0), (11, 1, None), (17, 0, 0), (None, 1, 0), (4, 1, 1)],
                                 "doc_id long, quality int, toxic int")


def by_row(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# quality rules

def test_base_measures(odd, labels):
    got = quality_llr.measure(odd, quality_llr.trusted_ids(labels))
    want = Counter()
    for doc_id, text, _, _ in rows():
        m = base_measures(text)
        want[(doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def buckets_of(text, buckets):
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words(text)]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42))
             for a, b in zip(h, h[1:])]
    return [x & (buckets - 1) for x in h + pairs]


def test_ratio_equals_brute_force(spark, small_dir):
    docs, labels = read(spark, small_dir, "documents"), read(spark, small_dir, "labels")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    n = 1 << 10
    raw, good, own = Counter(), Counter(), {}
    for r in docs.collect():
        own[r.doc_id] = buckets_of(r.text, n)
        raw.update(own[r.doc_id])
        if r.doc_id in trusted:
            good.update(own[r.doc_id])
    total_raw, total_good = sum(raw.values()), sum(good.values())
    weight = {b: round(1e6 * (math.log((good[b] + 1) / (total_good + n))
                              - math.log((raw[b] + 1) / (total_raw + n)))) for b in raw}
    got = quality_llr.measure(docs, quality_llr.trusted_ids(labels), buckets=n, min_llr=-0.05).collect()
    assert len(got) == len(own)
    for r in got:
        b = own[r.doc_id]
        if b:
            llr = sum(weight[x] for x in b) / len(b) / 1e6
            assert r.llr == pytest.approx(llr, abs=2e-6)
            if abs(llr + 0.05) > 1e-5:
                assert r.kept == (not r.base_failed and llr >= -0.05)
        else:
            assert r.base_failed and not r.kept


def test_quality_keeps_clean_and_drops_junk(spark, small_dir):
    docs, labels = read(spark, small_dir.replace("0.001", "0.01"), "documents"), read(spark, small_dir.replace("0.001", "0.01"), "labels")
    kept = {r.doc_id for r in quality_llr.keep_good(docs, quality_llr.trusted_ids(labels)).collect()}
    mark = {r.doc_id: r.quality for r in labels.collect()}
    long_enough = {r.doc_id for r in docs.collect() if len(words(r.text)) >= 10}
    clean = [d for d, q in mark.items() if q == 1 and d in long_enough]
    junk = [d for d, q in mark.items() if q == 0]
    assert sum(d in kept for d in clean) >= 0.99 * len(clean)
    assert sum(d not in kept for d in junk) >= 0.9 * len(junk)


def test_quality_rows_and_columns(spark, odd, labels):
    trusted = quality_llr.trusted_ids(labels)
    kept = quality_llr.keep_good(odd.withColumn("text_key", F.lit("x")), trusted, min_llr=-100.0)
    assert kept.columns == [*odd.columns, "text_key"]
    want = Counter()
    for row in rows():
        m = base_measures(row[1])
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0]:
            want[(row[0], row[1])] += 1
    assert by_row(kept, "doc_id", "text") == want
    none = labels.where("false")
    assert {r.llr for r in quality_llr.measure(odd, quality_llr.trusted_ids(none)).collect()} <= {0.0, None}
    assert quality_llr.measure(odd.where("false"), trusted).count() == 0


# span dedup

def check_spans(docs, got, span, min_words):
    want = removed_pieces([(r[0], r[1]) for r in docs], span, min_words)
    for r in got:
        gone = sorted(want.get((r["doc_id"], r["source_text"]), ()))
        pieces = cut(r["source_text"])
        assert r["span_dedup"]["removed"] == gone
        if r["source_text"] is None:
            assert r["text"] is None
        else:
            assert "".join(pieces) == r["source_text"]
            assert r["text"] == "".join(p for i, p in enumerate(pieces) if i not in gone)


@pytest.mark.parametrize("span,min_words", [(2, 10), (3, 1), (1, 4)])
def test_spans_odd(odd, span, min_words):
    got = span_dedup.dedup_spans(odd.withColumn("source_text", F.col("text")), span=span, min_words=min_words).collect()
    assert len(got) == len(rows())
    check_spans([(r[0], r[1]) for r in rows()], got, span, min_words)
    by_id = {r["doc_id"]: r for r in got}
    assert "quick brown" in by_id[10]["text"] and "quick brown" not in by_id[11]["text"]


def test_spans_small_table(spark, small_dir):
    docs = read(spark, small_dir, "documents").select("doc_id", "text", F.col("text").alias("source_text"))
    got = span_dedup.dedup_spans(docs).collect()
    check_spans([(r["doc_id"], r["source_text"]) for r in got], got, span_dedup.SPAN, span_dedup.MIN_WORDS)
    assert any(r["span_dedup"]["n_removed"] for r in got)


def test_spans_catch_long_repeats(spark):
    """A passage of over 50 words is removed from all documents but the first, and nothing else is."""
    hosts = [[" ".join(f"h{d}s{n}w{i}" for i in range(4 + (d * n) % 7)) + "." for n in range(6)] for d in range(12)]
    sentences = PASSAGE.replace(". ", ".|").split("|")
    docs = [(d, " ".join([*h[:3], PASSAGE, *h[3:]] if d % 3 else h)) for d, h in enumerate(hosts)]
    got = {r.doc_id: r.text for r in span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, h in enumerate(hosts):
        assert all(x in got[d] for x in h) and [x in got[d] for x in sentences] == [d == 1] * len(sentences)


def test_spans_empty(odd):
    assert span_dedup.dedup_spans(odd.where("false")).count() == 0


def hard_texts():
    """Copies, passages inside long sentences, short sentences, line ends, blanks, scripts without blanks, null and empty."""
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "of", "the"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    gap = lambda: rng.choices(["  ", ".  ", ". ", " \n", "! ", "\t", " "], [1, 1, 4, 2, 1, 1, 40])[0]
    passage = [word() + gap() for _ in range(150)]
    dense = "".join(chr(0x4E00 + rng.randrange(900)) + ("\u3002" if rng.random() < 0.03 else "") for _ in range(300))
    out = []
    for d in range(60):
        at, n = rng.randrange(100), rng.randrange(20, 90)
        text = "".join([*(word() + gap() for _ in range(60)), *passage[at:at + n], *(word() + gap() for _ in range(60))])
        if d % 10 == 3:
            text = dense[rng.randrange(100):] + text[:200]
        out.append((d, text))
    return out + [(70 + i, t) for i, (_, t) in enumerate(out[:8])] + [out[5], (None, out[6][1]), (81, None), (82, ""), (83, " \n \n")]


def check_whole(docs, got):
    want = whole_removed(docs)
    for r in got:
        pieces, gone = want[r["doc_id"], r["source_text"]]
        assert "".join(pieces) == (r["source_text"] or "")
        assert r["span_dedup"]["removed"] == sorted(gone) and r["span_dedup"]["n_pieces"] == len(pieces)
        assert r["text"] == (None if r["source_text"] is None else "".join(p for i, p in enumerate(pieces) if i not in gone))


@pytest.mark.parametrize("block", [1, 4000, span_dedup.BLOCK_BYTES])
def test_spans_whole_as_brute_force(block):
    """All runs of a block and the first of equal ones, whatever the blocks."""
    docs = sorted({(-1 if d is None else d, t) for d, t in hard_texts()}, key=lambda x: (x[0], x[1] or ""))
    want = whole_removed(docs)
    seen, gone = {}, {d: set() for d in docs}
    for part in span_dedup._blocks(np.array([len(t or "") for _, t in docs]) * (span_dedup.BLOCK_BYTES // block)):
        found = span_dedup.block_runs([t for _, t in docs[part]], span_dedup.SPAN, span_dedup.MIN_WORDS, True)
        firsts, later = span_dedup._first_and_later(*found)
        for doc, a, b in zip(*later):
            gone[docs[part][doc]].update(range(a, b + 1))
        for i in firsts:
            doc, a, b, h, g = (int(c[i]) for c in found)
            if seen.setdefault((h, g), (docs[part][doc], a)) != (docs[part][doc], a):
                gone[docs[part][doc]].update(range(a, b + 1))
    assert {d: want[d][1] for d in docs} == gone and sum(map(bool, gone.values())) > 20


def test_spans_whole_as_registered(spark):
    docs = hard_texts()
    df = spark.createDataFrame([(d, t, t) for d, t in docs], "doc_id long, text string, source_text string").repartition(5)
    got = span_dedup.dedup_spans(df, whole=True).collect()
    assert len(got) == len(docs)
    check_whole(docs, got)


def test_spans_whole_small_table(spark, small_dir):
    got = span_dedup.dedup_spans(read(spark, small_dir, "documents").select("doc_id", "text", F.col("text").alias("source_text")), whole=True).collect()
    check_whole([(r["doc_id"], r["source_text"]) for r in got], got)


def test_spans_whole(spark, odd):
    """One long sentence, unpunctuated text, text without blanks and last short sentences lose their later copies."""
    own = lambda d, n: " ".join(f"h{d}w{i}" for i in range(n))
    passage = " ".join(f"p{i % 37}q{i}" for i in range(80))
    dense = "".join(chr(0x4E00 + (i * i * 7 + i) % 900) for i in range(200))
    a, b, c = " ".join(f"a{i}" for i in range(11)) + " end.", "b one two.", "c one two."
    docs = [(0, f"{own(0, 30)}. {passage}. {own(100, 25)}."), (1, f"{own(1, 30)}. {passage}. {own(101, 25)}."),
            (2, f"{own(2, 40)} {passage} {own(102, 33)}"), (3, passage + "."), (4, own(4, 20)), (5, own(4, 20)),
            (6, f"{dense}"), (7, f"x{chr(0x5F00)}{dense}"), (8, f"{own(8, 12)}. {a} {b} {c} {own(108, 12)}."),
            (9, f"{own(9, 12)}. {a} {b} {c} {own(109, 12)}."), (10, None), (11, "")]
    got = {r.doc_id: r for r in span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string"), whole=True).collect()}
    text = {d: r.text for d, r in got.items()}
    assert all(text[d] == t for d, t in docs if d in (0, 4, 6, 8, 10, 11))
    assert text[1] == f"{own(1, 30)}. {own(101, 25)}." and text[3] == "" and text[5] == ""
    assert own(2, 40) in text[2] and own(102, 33) in text[2] and sum(w in text[2].split() for w in passage.split()) <= 2 * span_dedup.WINDOW
    assert len(text[7]) <= 2 * span_dedup.WINDOW and text[9] == f"{own(9, 12)}. {own(109, 12)}."
    old = {(r.doc_id, r.n): r.text for r in span_dedup.dedup_spans(odd.withColumnRenamed("n_words", "n")).collect()}
    for r in span_dedup.dedup_spans(odd.withColumnRenamed("n_words", "n"), whole=True).collect():
        assert r.text is None and old[r.doc_id, r.n] is None or len(r.text) <= len(old[r.doc_id, r.n])
    assert span_dedup.dedup_spans(odd.where("false"), whole=True).count() == 0


def test_spans_whole_leave_no_common_window(spark):
    """No later document keeps 51 words in a row that an earlier one has, wherever they begin."""
    rng = random.Random(7)
    hosts = [[f"h{d}w{i}" + rng.choice(["", "", "", "", "", "", "", "", ".", ""]) for i in range(150)] for d in range(40)]
    shared = [f"s{i}" + ("." if rng.random() < 0.07 else "") for i in range(400)]
    docs = []
    for d, h in enumerate(hosts):
        at, size, cut = rng.randrange(300), rng.randrange(51, 100), rng.randrange(150)
        docs.append((d, " ".join([*h[:cut], *shared[at:at + size], *h[cut:]])))
    got = {r.doc_id: r.text for r in span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string"), whole=True).collect()}
    seen = set()
    for d, text in docs:
        w, kept = words(text), words(got[d])
        assert not seen & {tuple(kept[i:i + 51]) for i in range(len(kept) - 50)}
        assert [x for x in w if x in hosts[d]] == [x for x in kept if x in hosts[d]]
        seen |= {tuple(w[i:i + 51]) for i in range(len(w) - 50)}


# licence scan

def test_license_base(odd):
    got = by_row(license_scan.scan(odd), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == Counter((r[0], *phrase_places(r[1])) for r in rows())


def test_license_templates(odd):
    got = {r.doc_id: r for r in license_scan.scan(odd).collect()}
    assert got[16].labels == "apache" and got[16].score == 1.0 and got[16].n_base == 0
    assert got[15].labels == "cc-by,cc-by-nc,gpl,reserved" and got[0].labels == "" and got[0].score == 0.0
    assert license_scan.scan(odd.where("false")).count() == 0


def test_license_join_is_exact(spark):
    """Filters prune nothing that the threshold keeps."""
    vocabulary = [f"t{i}" for i in range(12)]
    templates = [(f"l{k}", " ".join(vocabulary[k:k + 3 + k])) for k in range(5)]
    docs = [(n, "\n".join(" ".join(vocabulary[(n * i * i + j + i) % 12] for i in range(j % 9)) for j in range(12))) for n in range(40)]
    got = {(r.l_id, r.label) for r in license_scan.find_templates(
        spark.createDataFrame(docs, "doc_id long, text string"), templates=templates, threshold=0.7).collect()}
    def held(line, t):
        w, n = line.split(), len(t.split())
        return max(len(set(w[c * n:(c + 2) * n]) & set(t.split())) for c in range(len(w) // n + 1))

    want = {(n, label) for n, text in docs for label, t in templates for line in text.split("\n")
            if held(line, t) >= math.ceil(round(0.7 * len(set(t.split())), 9))}
    assert got == want and want


def test_license_long_lines(spark):
    """Words of a notice anywhere in a line of thousands of words are no notice; the notice among them is one."""
    notices = dict(license_scan.TEMPLATES[2:0:-1] + license_scan.TEMPLATES[4:5])
    filler = [f"x{i}" for i in range(3000)]

    def scattered(*labels):
        out, found = list(filler), [w for x in labels for w in notices[x].split()]
        for i, w in enumerate(found):
            out.insert(1 + i * 70, w)
        return " ".join(out)

    docs = [(0, scattered("mit")), (1, scattered("mit", "cc-by-sa")), (2, " ".join(filler[:1234]) + " " + notices["mit"] + " tail"),
            (3, " ".join(filler) + " " + notices["cc-by-sa"].replace(" ", ", "))]
    got = [(r.doc_id, r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"))
           .orderBy("doc_id").collect()]
    assert got == [(0, "", 0.0), (1, "", 0.0), (2, "mit", 1.0), (3, "cc-by,cc-by-sa", 1.0)]


def test_license_wrapped_notices(spark):
    """Notices wrapped at any width, with comment marks, are found as on one line; other words around aren't."""
    import textwrap
    heads = [("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"),
             ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
             ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU GPL "
                     "General Public License as published")]
    docs, want = [], {}
    for label, head in heads:
        for width in (1, 12, 25, 40, 80, 400):
            for mark in ("", " * ", "# "):
                lines = ["plain words before", *textwrap.wrap(head, width, break_long_words=False), "and after them"]
                want[len(docs)] = label
                docs.append((len(docs), ("\r\n" if mark else "\n").join(mark + x for x in lines)))
    scattered = "\n".join(f"{w} " + " ".join(f"x{i}" for i in range(40)) for w in heads[0][1].split())
    docs += [(1000, scattered), (1001, "redistribution and use in source\nand binary forms"), (1002, "\n\n\n"), (1003, None)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: label in got[d].labels.split(",") for d, label in want.items()} == dict.fromkeys(want, True)
    assert all(got[d].score >= 0.9 for d in want) and all(got[d].labels == "" and got[d].score == 0 for d in range(1000, 1004))


# personal data

def check_private(pairs, got):
    want = Counter()
    for doc_id, text in pairs:
        s = base_spans(text)
        kinds = Counter(x.split(":")[0] for x in s)
        want[(doc_id, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"],
              hashlib.sha256(",".join(s).encode()).hexdigest())] += 1
    assert by_row(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


def test_private_odd(odd):
    got = pii.digest(pii.detect(odd))
    check_private([(r[0], r[1]) for r in rows()], got)
    by_id = {r.doc_id: r for r in got.collect()}
    assert "iban:5:32" in by_id[14].spans and by_id[14].n_iban == 1 and by_id[13].max_score > by_id[13].min_score
    assert pii.detect(odd.where("false")).count() == 0


def test_private_small_table(spark, small_dir):
    docs = read(spark, small_dir, "documents")
    check_private([(r.doc_id, r.text) for r in docs.collect()], pii.digest(pii.detect(docs)))


def test_private_adversarial(spark):
    texts = ["a" * 60_000 + "@", "a@b..c x@y.z_w@v.u", "1" * 60_000, "1-" * 30_000 + "1", "+" * 5000 + "1" * 9, "+1" + "(" * 40_000,
             "1.2.3.4 " * 3000, "a@b" + ".c" * 20_000, "5 4242424242424242 5--4242 4242 4242 4242", "4242424242424242-", "x@-.-",
             "١٢٣ 4242424242424242é", "a+b@c.d+e@f.g", "0000255.0.0.1 00000000256.1.1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    safe = [(i, t) for i, t in enumerate(texts) if i not in (0, 2)]
    check_private(safe, pii.digest(pii.detect(docs.where("doc_id not in (0, 2)"))))
    assert [r.spans for r in pii.digest(pii.detect(docs.where("doc_id in (0, 2)"))).collect()] == ["", ""]


def test_running_sums(spark):
    values = [[], [5], list(range(2000)), [1] * 512, [3] * 513]
    got = spark.createDataFrame([(v,) for v in values], "v array<int>").select(pii.running(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [[sum(v[:i]) for i in range(len(v))] for v in values]


# mixing

def check_mix(got):
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r["mix"])
        assert r["mix"]["taken"] <= 3 * r["mix"]["size"] and r["mix"]["taken"] == r["mix"]["copies"] * r["mix"]["size"]
    sizes = {s: sum(m["size"] for m in ms) for s, ms in by_source.items()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target, open_ = {}, dict(zip(order, [5, 2, 1] * len(order)))
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > 3 * sizes[s]]
        for s in full or open_:
            target[s] = 3 * sizes[s] if full else open_[s] * level
        if not full:
            break
        for s in full:
            left -= target[s]
            del open_[s]
    for s, ms in by_source.items():
        assert ms[0]["target"] == pytest.approx(target[s]) and ms[0]["source_size"] == sizes[s]
        assert abs(sum(m["taken"] for m in ms) - target[s]) <= max(m["size"] for m in ms) / 2 + 1e-6
        copies = {m["copies"] for m in ms if m["size"]}
        assert not copies or max(copies) - min(copies) <= 1


def test_mix(spark, odd, small_dir):
    got = mixing.mix(odd.withColumn("mix_size", F.lit(1))).collect()
    assert len(got) == len(rows())
    check_mix(got)
    docs = read(spark, small_dir, "documents")
    first = mixing.mix(docs).collect()
    check_mix(first)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r.doc_id, r.mix.copies) for r in first} == {(r.doc_id, r.mix.copies) for r in again}
    assert mixing.mix(odd.where("false")).count() == 0
    # Rows of one id and length draw by their texts.
    alike = docs.sparkSession.createDataFrame([(None, f"word{i} and two", "s") for i in range(8)], "doc_id long, text string, source string")
    assert alike.select(mixing.uniform(F.col("doc_id"), F.col("text"))).distinct().count() == 8


def test_mix_prefers_quality(spark):
    docs = spark.createDataFrame([(i, ("word " * 9 + ("### " if i % 2 else "more ")) * 3, "s" if i < 400 else "t" * (1 + i % 2))
                                  for i in range(440)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)).where("source = 's'").collect()
    drawn = Counter(r.doc_id % 2 for r in got if r.mix.copies > min(x.mix.copies for x in got))
    assert drawn[0] > 1.5 * drawn[1]


def test_mixed_rows(odd):
    drawn = mixing.mix(odd).collect()
    want = Counter()
    for r in drawn:
        if r["mix"]["copies"]:
            want[(r["doc_id"], r["text"])] += r["mix"]["copies"]
    out = mixing.mixed(odd)
    assert by_row(out, "doc_id", "text") == want and out.columns == odd.columns


# line templates

def brute_lines(docs, min_tokens=3, min_docs=4, similarity=0.7, depth=3):
    constant = lambda w: w != "<*>" and any(map(str.isalpha, w))
    enough = lambda found, n: len(found) >= 2 and 2 * len(found) >= n

    def tokens(line):
        w = tuple(words(line))
        masked = tuple("<*>" if any(c in "0123456789" for c in x) else x for x in w)
        return masked if enough(list(filter(constant, masked)), len(w)) else w

    def by_majority(lines):
        """The lines that belong to the template of all of them."""
        n, out = len(lines), set()
        for t in lines:
            same = [p for p in range(len(t)) if p < depth or 2 * sum(x[p] == t[p] for x in lines) > n >= 2]
            if len(same) - depth >= round(similarity * (len(t) - depth), 9) and enough([p for p in same if constant(t[p])], len(t)):
                out.add(t)
        return out

    def by_prefix(lines):
        """Groups of lines by the longest prefix of their pairs, most frequent first, that recurs."""
        seen = Counter((p, t[p]) for t in lines for p in range(depth, len(t)))
        pairs = {t: sorted(((p, t[p]) for p in range(depth, len(t)) if seen[p, t[p]] > 1), key=lambda x: (-seen[x], x[0])) for t in lines}
        held = defaultdict(set)
        for t, ps in pairs.items():
            for k in range(1, len(ps) + 1):
                held[frozenset(ps[:k])].add(t)
        out = defaultdict(set)
        for t, ps in pairs.items():
            for k in range(len(ps), 0, -1):
                group = held[frozenset(ps[:k])]
                if len(group) > 1 and sum(times[x] for x in group) >= min_docs:
                    out[frozenset(ps[:k])].add(t)
                    break
        return out

    keys = {(d, t): [tokens(x) for x in (t or "").split("\n")] for d, t in docs}
    times = Counter(x for (d, t), n in Counter(docs).items() for x in keys[(d, t)] * n if len(x) >= min_tokens)
    leaves = defaultdict(set)
    for t in times:
        leaves[len(t), t[:depth]].add(t)
    template = {t: t for t in times}
    for k, lines in leaves.items():
        if len(lines) < 2 or sum(times[t] for t in lines) < min_docs or k[0] <= depth:
            continue
        first = by_majority(lines)
        template.update((t, (k, 1)) for t in first)
        for pairs, group in by_prefix(lines - first).items():
            template.update((t, (k, pairs)) for t in by_majority(group))
    where = defaultdict(set)
    for doc, ls in keys.items():
        for t in ls:
            if len(t) >= min_tokens:
                where[template[t]].add(doc)
    first = {k: min(v, key=lambda x: (x[0] is not None, x[0] or 0)) for k, v in where.items() if len(v) >= min_docs}
    return {doc: [i for i, t in enumerate(ls) if len(t) >= min_tokens and template[t] in first and first[template[t]] != doc]
            for doc, ls in keys.items()}


def check_lines(docs, got):
    want = brute_lines(docs)
    for r in got:
        assert r["line_dedup"]["dropped"] == want[(r["doc_id"], r["source_text"])]
        if r["source_text"] is not None:
            kept = [x for i, x in enumerate(r["source_text"].split("\n")) if i not in want[(r["doc_id"], r["source_text"])]]
            assert r["text"] == "\n".join(kept)


def test_lines_odd(odd):
    got = line_templates.drop_lines(odd.withColumn("source_text", F.col("text"))).collect()
    assert len(got) == len(rows())
    check_lines([(r[0], r[1]) for r in rows()], got)
    logs = {r["doc_id"]: r for r in got if r["source"] == "log"}
    assert "logged in" in logs[100]["text"] and all("logged in" not in logs[d]["text"] and "cookies" not in logs[d]["text"]
                                                    for d in logs if d > 100)
    assert all("unique line" in r["text"] or r["line_dedup"]["n_dropped"] for r in logs.values())
    assert line_templates.drop_lines(odd.where("false")).count() == 0


def test_lines_small_table(spark, small_dir):
    docs = read(spark, small_dir, "documents").select("doc_id", "text", F.col("text").alias("source_text"))
    got = line_templates.drop_lines(docs).collect()
    check_lines([(r["doc_id"], r["source_text"]) for r in got], got)
    assert any(r["line_dedup"]["n_dropped"] for r in got)


def dropped_lines(spark, docs):
    got = line_templates.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {(r.doc_id, i) for r in got for i in r.line_dedup.dropped}


def test_lines_several_templates_in_a_leaf(spark):
    """Two templates with the same token count and leading tokens, amid lines of no template."""
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    docs = [(n, f"Click here to read more about {name(n)} today\nClick here to subscribe now for {name(n + 500)} free\n"
                f"Click here to x{name(n)} y{name(n)} z{name(n)} u{name(n)} v{name(n)}") for n in range(50)]
    docs += [(100 + n, f"Click here to p{name(n)} q{name(n)} about r{name(n)} s{name(n)}") for n in range(120)]
    assert dropped_lines(spark, docs) == {(n, i) for n in range(1, 50) for i in (0, 1)}
    want = brute_lines(docs)
    assert dropped_lines(spark, docs) == {(d, i) for (d, _), lines in want.items() for i in lines}


def test_lines_of_few_valued_fields(spark):
    """One leaf of many three-valued fields: as the rule says, in as many passes as any other leaf."""
    rng = random.Random(5)
    docs = [(n, " ".join(["Log entry written by"] + [rng.choice(["up", "down", "off"]) + f"x{'ab'[i % 2]}" for i in range(8)]
                         + ["on this very day"])) for n in range(150)]
    want = brute_lines(docs)
    assert dropped_lines(spark, docs) == {(d, i) for (d, _), lines in want.items() for i in lines}


def test_lines_short_and_numeric_ones_stay(spark):
    """Differing short lines and rows of numbers stay; equal ones and long notices with numbers go."""
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    docs = [(n, f"It was a {name(n)}\n{n} {7 * n} {n + 93}\n| {n} | {n * n} |\n12 7 93\nPage {n} of the report") for n in range(20)]
    assert dropped_lines(spark, docs) == {(n, i) for n in range(1, 20) for i in (3, 4)}

"""Curve search, token counts, near-duplicates, packing and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, pieces_of, probability_jaccard, roots, rows, shingle_counts, words
from pyspark.sql import functions as F

import corpus_pipeline
from terrapulse.llm import components, hilbert_ann, packing, probminhash, trie_tokens
from terrapulse.llm.common import read


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


# curve search

def exact(ids, vectors, every, k):
    out = {}
    for q, v in zip(ids, vectors):
        if q % every == 0:
            s = vectors @ v
            order = sorted((-x, i) for x, i in zip(s, ids) if i != q)[:k]
            out[q] = [(i, -x) for x, i in order]
    return out


def test_search_recall(spark, small_dir):
    table = read(spark, small_dir, "embeddings")
    data = table.collect()
    vectors = np.array([r.embedding for r in data], np.float64)
    want = exact([r.vec_id for r in data], vectors, 20, 20)
    at = {r.vec_id: v for r, v in zip(data, vectors)}
    got = defaultdict(list)
    for r in hilbert_ann.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id]) and r.score == pytest.approx(at[r.query_id] @ at[r.vec_id], abs=1e-12)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_odd_vectors(spark):
    """Copies, ties, unequal norms and vectors that take no part, against brute force."""
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in np.round(rng.standard_normal(3), 1) * (1 + i % 3)]) for i in range(60)]
    good += [(60 + i, [1.0, 2.0, 0.5]) for i in range(50)]
    bad = [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [float("nan"), 1.0, 1.0]),
           (300, [float("inf"), 1.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(good + bad + [good[5]], "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    good = [(i, v) for i, v in good if any(v)]
    ids, vectors = [i for i, _ in good], np.array([v for _, v in good], np.float32).astype(np.float64)
    want = exact(ids, vectors, 20, 20)
    got = defaultdict(list)
    for r in hilbert_ann.search(table, recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, pytest.approx(r.score, abs=1e-9)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(got[q] == want[q] for q in want)


def test_search_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hilbert_ann.search(few).collect()] == [(0, 1, 1, 0.5)]
    assert hilbert_ann.search(few.where("false")).count() == 0
    assert hilbert_ann.search(few.where("vec_id = 0")).count() == 0


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# token counts

def test_counts_equal_single_tokens(spark, odd, small_dir):
    model = trie_tokens.unigram(trie_tokens.vocabulary_path())
    docs = read(spark, small_dir, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).collect()
    memo = {}
    want = Counter()
    for r in docs:
        w = words(r.text)
        for t in w:
            if t not in memo:
                memo[t] = pieces_of(t, *model)
        want[(r.doc_id, len(w), sum(memo[t][1] for t in w), round(sum(memo[t][0] for t in w), 6))] += 1
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_pretokens, r.n_tokens, round(r.score, 6)) for r in trie_tokens.count_tokens(table).collect())
    assert got == want


def test_counts_by_parts(spark, monkeypatch):
    model = ({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -1.2}, -9.0, 3)
    assert [x[:2] for x in trie_tokens.terminal_counts(["ab", "abab", "b", "z"], model)] == [("ab", 1), ("abab", 2), ("b", 2), ("z", 2)]
    text = "some words " * 500_000
    table = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in trie_tokens.count_tokens(table).collect()}
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert got[1].n_tokens == 500_000 * trie_tokens.count_tokens(one).first().n_tokens and got[1].n_pretokens == 1_000_000
    assert got[2].n_tokens == 0 and trie_tokens.count_tokens(table.where("false")).count() == 0


# near-duplicates

def brute_classes(docs, similarity=0.8):
    texts = {}
    for d, t in docs:
        if d is not None:
            texts[d] = shingle_counts(t)
    links, ids = [], sorted(texts)
    by_shingle = defaultdict(set)
    for d in ids:
        for s in texts[d]:
            by_shingle[s].add(d)
    for a in ids:
        near = {b for s in texts[a] for b in by_shingle[s] if b > a}
        links += [(a, b) for b in near if probability_jaccard_fast(texts[a], texts[b]) >= similarity]
    return roots(ids, links)


def probability_jaccard_fast(x, y):
    if set(x.values()) | set(y.values()) == {1}:
        both = len(x.keys() & y.keys())
        return both / (len(x) + len(y) - both)
    return probability_jaccard(x, y)


def test_probability_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = ({int(k): int(c) for k, c in zip(rng.choice(40, n, replace=False), rng.integers(1, 5, n))} for n in rng.integers(1, 30, 2))
        a, b = np.array(sorted(x), np.int64), np.array(sorted(y), np.int64)
        got = probminhash.probability_jaccard(a, np.array([x[k] for k in a]), b, np.array([y[k] for k in b]))
        assert got == pytest.approx(probability_jaccard(x, y))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    weight = rng.integers(1, 6, 300).astype(np.float64)
    doc = np.r_[np.zeros(200, int), np.ones(200, int)]
    pick = np.r_[np.arange(200), np.arange(100, 300)]
    sig = probminhash.signatures(doc, code[pick], weight[pick], 2, 2000)
    x, y = dict(zip(code[:200].tolist(), weight[:200])), dict(zip(code[100:].tolist(), weight[100:]))
    assert (sig[0] == sig[1]).mean() == pytest.approx(probability_jaccard(x, y), abs=0.04)


def test_classes_small_table(spark, small_dir):
    docs = read(spark, small_dir, "documents")
    got = {r.doc_id: r.class_id for r in probminhash.classes(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(got.values())) < len(got)


def test_classes_odd(odd):
    got = Counter((r.doc_id, r.class_id) for r in probminhash.classes(odd).collect())
    want = brute_classes([(r[0], r[1]) for r in rows()])
    assert got == Counter((r[0], want.get(r[0])) for r in rows())
    assert want[6] == 5 and want[8] == 7 and want[9] == 7
    kept = Counter(r.doc_id for r in probminhash.keep_one(odd.withColumn("text_key", F.lit(1))).collect())
    assert kept[7] == 1 and not kept[6] and not kept[8] and kept[0] == kept[1] == kept[2] == kept[None] == 1
    assert probminhash.classes(odd.where("false")).count() == 0


def test_classes_cross_component_links(spark):
    """A chain through a bucket whose smallest member links to nothing directly."""
    base = [f"w{i}" for i in range(120)]
    docs = []
    for n in range(12):
        w = list(base)
        for j in range(n):
            w[(j * 9 + 4) % 120] = f"x{j}"
        docs.append((n, " ".join(w)))
    got = {r.doc_id: r.class_id for r in probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) and len(set(got.values())) == 1


def test_classes_of_a_document_with_several_texts(spark):
    """Rows of one doc_id are one document: it is linked by each of its texts, in any order of rows."""
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    docs = [(7, text["a"]), (7, text["b"]), (3, text["a"]), (5, text["b"] + " more"), (9, text["c"]), (9, text["c"]), (9, None), (11, text["d"])]
    for order in (docs, docs[::-1]):
        got = Counter((r.doc_id, r.class_id) for r in probminhash.classes(spark.createDataFrame(order, "doc_id long, text string")).collect())
        assert got == Counter({(7, 3): 2, (3, 3): 1, (5, 3): 1, (9, 9): 3, (11, 11): 1})
    kept = Counter(r.doc_id for r in probminhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == Counter({3: 1, 9: 2, 11: 1})


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (9, 4), (7, 8), (10, 10), (20, 21), (22, 21), (22, 20)] + [(50, 51 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for x in links for n in x}
    want = {n: r for n, r in roots(nodes, [x for x in links if x[0] != x[1]]).items() if n != r}
    assert got == want


# packing

def whole_ids(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check_pieces(docs, got, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for doc_id, text in docs:
        ids = np.array(whole_ids(tok, text), "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[(doc_id, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= 1.02 * sum(r.length for r in got) / capacity + sum(r.length > capacity / 2 for r in got) * 0.5 + 2


def test_pack(spark, odd, small_dir):
    docs = read(spark, small_dir, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect(), packing.CAPACITY)
    check_pieces([(r[0], r[1]) for r in rows()], packing.pack(odd.withColumn("length", F.lit("x")), capacity=64).collect(), 64)
    assert packing.pack(odd.where("false")).count() == 0


def test_pack_full_pieces(spark):
    """Full pieces have sequences of their own, whichever partition holds them."""
    docs = [(n, "word " * (64 * k - 1)) for n, k in enumerate((1, 1, 3, 2, 1, 5, 1))] + [(20 + n, "word " * 20) for n in range(9)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), capacity=64).collect()
    check_pieces(docs, got, 64)
    full = [r.sequence_id for r in got if r.length == 64]
    assert len(full) >= 14 and len(set(full)) == len(full) and not set(full) & {r.sequence_id for r in got if r.length < 64}


def test_pack_odd_words(spark):
    texts = ["It's we'll I'd <|endoftext|>x <|startoftext|> ΣΑΣ İstanbul ﬁne é Å Ångström naïve. «hola» ...!?a 12ab's",
             "tab\tnl\nnbsp em zw​x\x1cy\x85z ß STRASSE ÿŸ ½² ①", "a" * 5000, "é" * 300 + ",,," + "'s'" * 3]
    docs = list(enumerate(texts))
    check_pieces(docs, packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect(), packing.CAPACITY)


def test_plan_places_everything():
    rng = np.random.default_rng(5)
    for capacity, n in ((100, 500), (4096, 3000), (10, 50), (7, 200)):
        lengths = Counter(int(x) for x in np.minimum(capacity, rng.geometric(3 / capacity, n)))
        runs = packing.plan(dict(lengths), capacity)
        fill, numbers, large = defaultdict(list), defaultdict(list), Counter()
        for length, number, count, first, offset in runs:
            for i in range(count):
                numbers[length].append(number + i)
                fill[first + i].append((offset, length))
                large[first + i] += length > capacity / 3
        assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(c)) for k, c in lengths.items()}
        assert max(large.values(), default=0) <= 2
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        bound = -(-sum(k * c for k, c in lengths.items()) // capacity)
        assert len(fill) <= max(bound * 1.1 + 1, sum(c for k, c in lengths.items() if 2 * k > capacity) + 1)


# pipeline

def test_pipeline(spark, small_dir):
    docs, kept, sizes = read(spark, small_dir, "documents"), {}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            kept[name], docs = out.collect(), out
        sizes[name] = out.count()
    assert sizes["quality_rules"] > sizes["near_dedup"] > 0
    near = {r.doc_id for r in kept["near_dedup"]}
    want = brute_classes([(r.doc_id, r.text) for r in kept["line_dedup"]])
    assert near == set(want.values()) and len(kept["near_dedup"]) == len(near)
    assert {r.doc_id for r in kept["mix_sources"]} <= near
    got = corpus_pipeline.run(spark, small_dir).collect()
    check_pieces([(r.doc_id, r.text) for r in kept["mix_sources"]], got, packing.CAPACITY)


def test_pipeline_stages_take_odd_tables(spark, odd, small_dir):
    docs = odd.withColumns({"lang": F.lit("en"), "n_chars": F.length("text")})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_dir).count() >= 0
        assert stage(spark, docs.where("false"), small_dir).count() == 0


def test_oracles_match(spark, small_dir):
    import duckdb

    from terrapulse.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small_dir}/documents.parquet')")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, small_dir)
        want = con.sql(sql)
        assert sorted(want.columns) == sorted(got.columns)
        shown = lambda r, cols: tuple(f"{r[c]:.9g}" if isinstance(r[c], float) else r[c] for c in cols)
        cols = sorted(got.columns)
        left = Counter(shown(r, cols) for r in got.collect())
        right = Counter(shown(dict(zip(want.columns, r)), cols) for r in want.fetchall())
        assert left == right, name


def test_no_cluster_local_names():
    """Operators use the shared checkpoint folder alone."""
    import pathlib

    folder = pathlib.Path(hilbert_ann.__file__).parent
    for path in [*folder.glob("*.py"), pathlib.Path(corpus_pipeline.__file__)]:
        assert not re.search(r"localCheckpoint|tempfile|/tmp", path.read_text()), path


def test_classes_by_blocks(spark, odd, small_dir, monkeypatch):
    """Near misses compared block by block give the same classes."""
    monkeypatch.setattr(probminhash, "REGION_PAIRS", 0)
    monkeypatch.setattr(probminhash, "BLOCK", 2)
    got = Counter((r.doc_id, r.class_id) for r in probminhash.classes(odd).collect())
    want = brute_classes([(r[0], r[1]) for r in rows()])
    assert got == Counter((r[0], want.get(r[0])) for r in rows())
    docs = read(spark, small_dir, "documents")
    assert {r.doc_id: r.class_id for r in probminhash.classes(docs).collect()} == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("region_pairs", [0, probminhash.REGION_PAIRS])
def test_classes_at_the_threshold(spark, monkeypatch, region_pairs):
    """12 common shingles of 15 are 0.8 and a pair, whichever path compares them; 11 of 15 aren't."""
    monkeypatch.setattr(probminhash, "REGION_PAIRS", region_pairs)
    docs = [(10 * k + n, " ".join(f"k{k}w{i}" for i in range(words))) for k in range(6) for n, words in enumerate((16, 19))]
    docs += [(100 + n, " ".join(f"z{i}" for i in range(words))) for n, words in enumerate((15, 19))]
    got = {r.doc_id: r.class_id for r in probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) and all(got[10 * k + 1] == 10 * k for k in range(6)) and got[101] == 101


@pytest.mark.parametrize("count", [1, 2, 3])
def test_threshold_is_the_same_in_both_paths(count):
    for common, union, want in ((12, 15, True), (48, 60, True), (1200, 1500, True), (11, 15, False), (1199, 1500, False)):
        sets = [list(range(common)), list(range(union))]
        lists = lambda v: pa.array(v, pa.list_(pa.int64()))
        counts = [[count] * len(s) for s in sets]
        pair = pa.record_batch([pa.array([0], pa.int64()), pa.array([1], pa.int64()), *map(lists, ([sets[0]], [counts[0]], [sets[1]], [counts[1]]))],
                               ["a", "b", "codes", "counts", "codes_b", "counts_b"])
        region = pa.table({"node": [0, 1], "root": [0, 1], "left": [True, False], "codes": lists(sets), "counts": lists(counts)})
        assert sum(x.num_rows for x in probminhash._verified(0.8)(iter([pair]))) == want
        assert probminhash._blocks_linked(0.8)(region).num_rows == want


def test_block_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 5, 20, 60, 200)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for columns in (1, 7, 4096):
        assert probminhash._overlaps(sets, sets, columns).tolist() == want


def test_words_of_any_white_space():
    from terrapulse.llm import texts
    odd = "a b\tc\nd\x0be\x0cf\rg\x1ch\x85i\xa0j k　l  m "
    assert texts.words_of(odd) == words(odd) and texts.words_of("plain  words\n here ") == ["plain", "words", "here"]
    long = odd * 200_000
    assert [w for p in texts.word_parts(long) for w in p] == words(long)


def test_remembered_words_are_bounded():
    from terrapulse.llm.texts import Remembered
    made = []
    r = Remembered(10, lambda w: made.append(w) or w.upper())
    for _ in range(3):
        for i in range(100):
            assert r["common"] == "COMMON" and r[f"w{i}"] == f"W{i}"
            assert len(r) + len(r.old) <= 20
    assert made.count("common") == 1
    assert r.missing({"common", "new"}) == {"new"} and "common" in r

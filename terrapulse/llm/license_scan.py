"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are pieces of lines, as sets of words: a line is cut at every multiple of the template's
number of words, and two neighbouring pieces are a block, so a block has at most twice as many
words as the template and words scattered over a long line don't meet. For notices wrapped over lines
the words around every line end are blocks too, as many on either side as the template has: a notice
wrapped at any width lies in the block of each line end inside it. A template is found in
every block that holds at least ``threshold`` of its words (containment). Words are ordered by
their frequency over all blocks, rarest first; a template is indexed only under its
prefix of ``size - need + 1`` words, because a block that holds ``need`` of its words
must hold one of those. The join is an equi-join on that word; the length filter drops
blocks with fewer than ``need`` template words, and the positional filter drops pairs
whose remaining words can't reach ``need`` any more. Both filters see whole lines; survivors are
verified exactly, block by block.

The templates are a fixed, short list, so their words (counted in one aggregate, at
most one row a word) and the prefix index are bounded; the index is broadcast. Line ends
are looked at only in texts that hold a prefix word. Texts are never shuffled: only
matches and narrow rows are.

Phrases (the base labels) are searched as runs of consecutive words in whole texts.

Defined results: null text is empty and has no words, places or labels; first_word and
last_word are null without a place; rows that repeat get the same result each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import bind, matches, text_key

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and notice text of each template.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
]
THRESHOLD = 0.9

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words in a text that is not lower-cased yet.
SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same without the line end.
_NO_LINE_SEP = SEP.replace(r"\x00-\x2F", r"\x00-\x09\x0B-\x2F")
_EDGE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def _phrase_pattern(phrases: list[str]) -> str:
    runs = "|".join(SEP.join(p.split()) for p in phrases)
    return rf"(?i)(?<!{_EDGE})(?:{runs})(?!{_EDGE})"


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SEP), "")).cast("long")


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and the array of base labels of a text."""
    text = F.coalesce(text, F.lit(""))
    pattern = _phrase_pattern(list(phrases))
    has = text.rlike(pattern)
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    last = bind(hits, lambda h: _n_words(F.element_at(h, -1)))
    after = bind(gaps, lambda g: _n_words(F.element_at(g, -1)))
    labels = [F.when(text.rlike(_phrase_pattern([p])), F.lit(x)) for p, x in phrases.items()]
    return {
        "n_words": _n_words(text),
        "n_base": F.when(has, F.size(hits)).otherwise(0).cast("long"),
        "first_word": F.when(has, _n_words(gaps[0])),
        "last_word": F.when(has, _n_words(text) - after - last),
        "base": F.when(has, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>")),
    }


def _blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str], need: int) -> DataFrame:
    """(doc_id, text_key, block, found): every line that has ``need`` template words, and these."""
    lines = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
                        F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1)).alias("block"))
    known = F.filter(F.split("block", SEP), lambda w: w.isin(vocabulary))
    return lines.select("*", F.array_distinct(known).alias("found")).where(F.size("found") >= need)


def _in_pieces(line: Column, words: Column, length: Column) -> Column:
    """The most of ``words`` that two neighbouring pieces of ``length`` words of a line hold."""
    every = F.array_remove(F.split(line, SEP), "")
    spots = F.filter(F.transform(every, lambda w, i: F.struct(F.floor(i / length).alias("piece"), w.alias("w"))),
                     lambda x: F.array_contains(words, x["w"]))

    def most(s: Column) -> Column:
        held = lambda p: F.size(F.array_distinct(F.transform(
            F.filter(s, lambda x: (x["piece"] == p) | (x["piece"] == p + 1)), lambda x: x["w"])))
        return F.array_max(F.transform(F.array_distinct(F.transform(s, lambda x: x["piece"])), held))

    return F.coalesce(bind(spots, most), F.lit(0))


def _line_ends(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str], prefix: list[str], need: int,
               side: int) -> DataFrame:
    """(doc_id, text_key, before, after, found): the words around every line end that hold a ``prefix`` word."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    some = rf"(?<!{_EDGE})(?:{'|'.join(prefix)})(?!{_EDGE})"
    # A line end (with the blank lines that follow it) is an item of its own between the words.
    items = F.array_remove(F.split(F.regexp_replace(text, rf"(?:{SEP})?\n(?:{SEP})?", " \n "), _NO_LINE_SEP), "")
    is_word = lambda w: w != "\n"

    def around(w: Column) -> Column:
        ends = F.filter(F.transform(w, lambda x, i: F.when(x == "\n", i)), lambda i: i.isNotNull())
        # Words and line ends alternate at worst, so twice as many items hold ``side`` words.
        before = lambda i: F.filter(F.slice(w, F.greatest(i + 1 - 2 * side, F.lit(1)), F.least(i, F.lit(2 * side))), is_word)
        after = lambda i: F.filter(F.slice(w, i + 2, 2 * side), is_word)
        return F.transform(ends, lambda i: F.struct(F.reverse(before(i)).alias("before"), after(i).alias("after")))

    texts = docs.where(text.contains("\n") & text.rlike(some)).select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.inline(bind(items, around)))
    near = F.concat(F.slice("before", 1, side), F.slice("after", 1, side))
    found = F.array_distinct(F.filter(near, lambda w: w.isin(vocabulary)))
    return texts.select("*", found.alias("found")).where(F.size("found") >= need)


def find_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                   wrapped: bool = False) -> DataFrame:
    """(l_id, l_key, template, label, overlap, size): every block and template that meet the threshold.

    Blocks are pieces of lines, and with ``wrapped`` the words around line ends too.
    """
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    lengths = [len(text.split()) for _, text in templates]
    need = {n: ceil(round(threshold * len(s), 9)) for n, (_, s) in enumerate(sets)}
    vocabulary = sorted({w for _, s in sets for w in s})
    spark = docs.sparkSession
    blocks = _blocks(docs, id_col, text_col, vocabulary, min(need.values()))
    # The global order: one row for each word of the fixed templates at most.
    seen = {r["w"]: r["n"] for r in blocks.select(F.explode("found").alias("w")).groupBy("w")
            .agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index = []
    for n, (label, s) in enumerate(sets):
        by_rank = sorted(s, key=place.__getitem__)
        index += [(w, n, label, by_rank, i, need[n], lengths[n]) for i, w in enumerate(by_rank[: len(s) - need[n] + 1])]
    prefixes = spark.createDataFrame(index, "word string, template int, label string, words array<string>, "
                                            "t_pos int, need int, length int")

    starts = sorted({x[0] for x in index})

    def joined(held: DataFrame) -> DataFrame:
        ranked = held.withColumn("found", F.array_intersect(F.array(*map(F.lit, order)), F.col("found")))
        spots = F.filter(F.transform("found", lambda w, i: F.struct(i.alias("b_pos"), w.alias("word"))),
                         lambda x: x["word"].isin(starts))
        pairs = (ranked.select("*", F.inline(spots)).join(F.broadcast(prefixes), "word")
                 .where(F.size("found") >= F.col("need")))
        earlier = F.size(F.array_intersect(F.slice("found", F.lit(1), F.col("b_pos")), F.col("words")))
        left = F.least(F.size("words") - F.col("t_pos"), F.size("found") - F.col("b_pos"))
        return pairs.where((earlier == 0) & (left >= F.col("need")))  # from the first shared word on

    def matched(pairs: DataFrame, overlap: Column) -> DataFrame:
        return (pairs.select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), "template", "label", "need",
                             overlap.alias("overlap"), F.size("words").alias("size"))
                .where(F.col("overlap") >= F.col("need")).drop("need"))

    out = matched(joined(blocks), _in_pieces(F.col("block"), F.col("words"), F.col("length")))
    if wrapped:
        ends = _line_ends(docs, id_col, text_col, vocabulary, starts, min(need.values()), max(lengths))
        # As many words on either side as this template has, not the longest.
        near = F.concat(F.slice(F.col("before"), F.lit(1), F.col("length")), F.slice(F.col("after"), F.lit(1), F.col("length")))
        out = out.unionByName(matched(joined(ends), F.size(F.array_intersect(near, F.col("words")))))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: phrase places, base labels, all labels and the best containment as score."""
    found = (find_templates(docs, id_col, text_col, templates, threshold, wrapped=True)
             .groupBy("l_id", "l_key").agg(F.collect_set("label").alias("more"),
                                           F.max(F.col("overlap") / F.col("size")).alias("best")))
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
                       *[c.alias(k) for k, c in phrase_places(F.col(text_col)).items()])
    out = base.join(found, matches(base, found, {"doc_id": "l_id", "text_key": "l_key"}), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    more = F.coalesce(F.col("more"), F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("best"), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
                      joined(F.concat("base", more)).alias("labels"), score.alias("score"))

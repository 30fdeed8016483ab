"""Small documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"word{i % 977} tail{i % 31}." for i in range(6000))
PASSAGE = ("The quick brown fox jumps over the lazy dog near the river bank. It was a bright cold day in April and the "
           "clocks were striking. Nobody saw the small boat leave the harbour before dawn. All of the letters were "
           "returned unopened by the clerk. Every window in the old house had been painted shut.")
BODY = " ".join(f"alpha{i} beta{i % 13} gamma{i % 7}" for i in range(60))


def rows() -> list[tuple]:
    """(doc_id, text, source, n_words): n_words clashes with a column of the operators."""
    out = [
        (0, None, "a", 1), (1, "", "a", None), (2, "   \n\t ", None, 3), (None, "no id here at all " * 4, "b", 4),
        (3, "one", "b", 5), (4, "Ünï cödé 😀 text with émojis 😀😀 and more words here ok", "b", 6),
        (5, LONG, "hot", 7), (6, LONG, "hot", 8), (7, BODY, "hot", 9), (7, BODY, "hot", 9),
        (8, BODY.replace("alpha7 ", "delta "), "hot", 10), (9, BODY.replace("beta3", "x", 1) + " end", "hot", 11),
        (10, "Intro words first. " + PASSAGE + " Closing words last.", "c", 12),
        (11, "Another start here. " + PASSAGE + " And a different end.", "c", 13),
        (12, PASSAGE + "\n" + PASSAGE, "c", 14),
        (13, "mail me at a.b@x.org_c@d.co.uk, card 4242 4242 4242 4242 ip 10.0.0.256 1.2.3.4.5.6.7.8 tel +1 (555) 123-4567", "d", 15),
        (14, "IBAN GB82 WEST 1234 5698 7654 32 and 4242-4242-4242-4241 then +12345 and 999.1.1.1", "d", 16),
        (15, "CC BY\nall rights reserved. ALL-RIGHTS reserved general   public license licensed under cc by nc 4 0", "e", 17),
        (16, "Licensed under the Apache License, Version 2.0.\nplain words follow here", "e", 18),
        (17, "same same same same same same same same same same same same", "e", 19),
        (18, "a\nb\na\n\n \nb", "e", 20), (19, "\x00\x01 odd \x7f bytes  here", "é", 21),
    ]
    out += [(100 + i, f"User {i} logged in from host{i} at noon\nThis page uses cookies to help you\nunique line number x{chr(97 + i)} goes here now",
             "log", 0) for i in range(8)]
    return out


SCHEMA = "doc_id long, text string, source string, n_words int"


def words(text):
    return WORD.findall(text or "")


def repeat_words(text, k=5):
    w = words(text)
    seen = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    inside = set()
    for i in range(len(w) - k + 1):
        if seen[tuple(w[i:i + k])] > 1:
            inside.update(range(i, i + k))
    return len(inside)


def base_measures(text):
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words(text)), sum(map(len, words(text))), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), repeat_words(text))


def cut(text):
    """Pieces after a sentence end and its blank, or after a line end."""
    return [p for p in re.split(r"(?<=[.!?][\x20\x09\r])|(?<=\n)", text or "") if p]


def removed_pieces(docs, span, min_words):
    """{(doc_id, text): removed piece numbers}, by dictionary over the runs themselves."""
    places, runs = defaultdict(set), []
    for doc_id, text in docs:
        s = [(i, tuple(words(p))) for i, p in enumerate(cut(text)) if words(p)]
        for j in range(len(s)):
            k = next((k for k in range(span, len(s) - j + 1) if sum(len(x[1]) for x in s[j:j + k]) >= min_words), None)
            if k:
                run, place = tuple(x[1] for x in s[j:j + k]), ((doc_id is not None, doc_id or 0), text, s[j][0])
                runs.append((run, place, s[j][0], s[j + k - 1][0], (doc_id, text)))
                places[run].add(place)
    first = {r: min(p, key=lambda x: (x[0], x[2])) for r, p in places.items()}
    out = defaultdict(set)
    for run, place, a, b, doc in runs:
        if place != first[run]:
            out[doc].update(range(a, b + 1))
    return out


DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


def whole_parts(text, long=16, window=16):
    """[(number of the sentence, words, cut)] of the pieces that ``whole`` removes, by the rule itself."""
    text, out = text or "", []
    dense = bool(re.search(f"[{DENSE}]", text))
    token = f"[{DENSE}]|[^\\x20\\x09-\\x0D{DENSE}]+" if dense else r"[^\x20\x09-\x0D]+"
    places = r"(?<=[.!?][\x20\x09\r])|(?<=\n)" + ("|(?<=[\u3002\uff01\uff1f])" if dense else "")
    for n, s in enumerate(p for p in re.split(places, text) if p):
        w = re.findall(token, s)
        if len(w) <= long:
            out.append((n, s, w, False))
            continue
        # Words with their blanks; a blank before the first one is an item too.
        at = [m.start() for m in re.finditer(token, s)]
        at = at if at[0] == 0 else [0, *at]
        items = [s[a:b] for a, b in zip(at, [*at[1:], len(s)])]
        h = [xxhash.xxh64_intdigest(x.strip(" \t\n\x0b\x0c\r"), 42) & 0xFFFFFFFF for x in items]
        h = [x - (1 << 32) if x >> 31 else x for x in h]
        ends = {max(range(j, j + window), key=lambda i: (h[i], i)) for j in range(len(items) - window + 1)} | {len(items) - 1}
        begin = 0
        for e in sorted(ends):
            part = "".join(items[begin:e + 1])
            out.append((n, part, re.findall(token, part), len(ends) > 1))
            begin = e + 1
    return out


def whole_removed(docs, span=2, min_words=10, long_run=20):
    """{(doc_id, text): (pieces, removed piece numbers)}: runs forth and back over sentences and over their parts, in dictionaries."""
    places, found, out = defaultdict(set), [], {}
    for doc_id, text in docs:
        parts = whole_parts(text)
        out[doc_id, text] = ([p[1] for p in parts], set())
        sentences = [(list(g), n) for n, g in itertools.groupby(range(len(parts)), key=lambda i: parts[i][0])]
        plain = [(g[0], g[-1], tuple(x for i in g for x in parts[i][2]), False) for g, _ in sentences]
        small = [(i, i, tuple(p[2]), p[3]) for i, p in enumerate(parts)]
        for units, least, need in ((plain, min_words, False), (small, max(long_run, min_words), True)):
            u = [x for x in units if x[2]]
            size = lambda a, b: sum(len(x[2]) for x in u[a:b])  # noqa: E731, B023
            forth = [next(((a, b) for b in range(a + span, len(u) + 1) if size(a, b) >= least), None) for a in range(len(u))]
            back = [next(((a, b) for a in range(b - span, -1, -1) if size(a, b) >= least), None) for b in range(1, len(u) + 1)]
            for a, b in {r for r in forth + back if r}:
                if not need or any(x[3] for x in u[a:b]):
                    run, place = tuple(x[2] for x in u[a:b]), ((doc_id is not None, doc_id or 0), text, u[a][0])
                    places[run].add(place)
                    found.append((run, place, u[a][0], u[b - 1][1], (doc_id, text)))
    first = {r: min(p, key=lambda x: (x[0], x[2])) for r, p in places.items()}
    for run, place, a, b, doc in found:
        if place != first[run]:
            out[doc][1].update(range(a, b + 1))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def phrase_places(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def shingle_counts(text, k=5):
    w = words((text or "").lower())
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def probability_jaccard(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in set(x) & set(y))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def pieces_of(token, scores, byte, longest):
    """Unigram segmentation of one pre-token on its own: (score, pieces)."""
    word = "▁" + token
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, -best[end - 1][1] - n)]
        for begin in range(max(0, end - longest), end):
            p = scores.get(word[begin:end])
            if p is not None:
                options.append((best[begin][0] + p, -best[begin][1] - 1))
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[-1]

"""DuckDB SQL for the queries that SQL can express, written from the rules and not from the plans."""

from __future__ import annotations

from terrapulse.llm import license_scan, pii

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _places(phrase: str) -> str:
    parts = phrase.split()
    same = " AND ".join(f"w[i+{n + 1}] = '{p}'" for n, p in enumerate(parts))
    return f"list_filter(range(len(w) - {len(parts) - 1}), lambda i: {same})"


def _license() -> str:
    phrases = list(license_scan.PHRASES.items())
    every = " || ".join(f"p{n}" for n in range(len(phrases)))
    base = " || ".join(f"CASE WHEN len(p{n}) > 0 THEN ['{label}'] ELSE [] END" for n, (_, label) in enumerate(phrases))
    templates = ", ".join(f"({n}, '{label}', {sorted(set(text.split()))}, {len(text.split())})"
                          for n, (label, text) in enumerate(license_scan.TEMPLATES))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SQL_WORD}') AS w FROM documents),
places AS (
  SELECT doc_id, len(w) AS n, {", ".join(f"{_places(p)} AS p{n}" for n, (p, _) in enumerate(phrases))} FROM d),
templates(k, label, words, size) AS (VALUES {templates}),
lines AS (SELECT doc_id, unnest(string_split(lower(t), chr(10))) AS line FROM d),
sets AS (SELECT doc_id, regexp_extract_all(line, '{_SQL_WORD}') AS s FROM lines),
near AS (
  SELECT doc_id, label, words, list_max(list_transform(range(len(s) // size + 1),
           lambda c: len(list_intersect(list_distinct(s[c * size + 1:(c + 2) * size]), words)))) AS held
  FROM sets, templates WHERE len(list_intersect(list_distinct(s), words)) >= ceil(round({license_scan.THRESHOLD} * len(words), 9))),
found AS (
  SELECT doc_id, label, held / len(words) AS part FROM near WHERE held >= ceil(round({license_scan.THRESHOLD} * len(words), 9))),
best AS (SELECT doc_id, list(DISTINCT label) AS more, max(part) AS part FROM found GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word,
       list_max({every})::BIGINT AS last_word,
       coalesce(array_to_string(list_sort({base}), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct({base} || coalesce(more, []))), ','), '') AS labels,
       CASE WHEN len({every}) > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0)::DOUBLE END AS score
FROM places LEFT JOIN best USING (doc_id)
"""


#: The kinds as the task states them; the account pattern stands between word boundaries.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
_DIGITS = "regexp_replace({h}, '[^0-9]', '', 'g')"
_LUHN = ("list_sum(list_transform(range(length({d})), lambda j: CASE WHEN j % 2 = 0 THEN {c} "
         "WHEN 2 * {c} > 9 THEN 2 * {c} - 9 ELSE 2 * {c} END)) % 10 = 0")


def _valid(kind: str, h: str) -> str:
    digits = _DIGITS.format(h=h)
    if kind == "ip":
        return f"list_max(list_transform(string_split({h}, '.'), lambda x: x::HUGEINT)) <= 255"
    if kind == "card":
        digit = f"substr({digits}, length({digits}) - j::BIGINT, 1)::INT"
        return f"length({digits}) BETWEEN 14 AND 19 AND " + _LUHN.format(d=digits, c=digit)
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    if kind == "iban":
        plain = f"replace({h}, ' ', '')"
        turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
        codes = (f"list_transform(string_split({turned}, ''), lambda x: CASE WHEN ascii(x) < 65 THEN ascii(x) - 48 "
                 "ELSE 1000 + ascii(x) - 55 END)")
        rest = f"list_reduce({codes}, lambda a, b: CASE WHEN b < 1000 THEN (a * 10 + b) % 97 ELSE (a * 100 + b - 1000) % 97 END, 0)"
        return f"length({plain}) BETWEEN 15 AND 34 AND {rest} = 1"
    return "true"


def _pii() -> str:
    lists, spans = [], []
    for n, kind in enumerate(pii.KINDS):
        pattern = _SQL_PATTERNS[kind]
        lists.append(f"string_split_regex(t, '{pattern}') AS g{n}, regexp_extract_all(t, '{pattern}') AS h{n}")
        start = (f"list_sum(list_transform(g{n}[1:i], lambda x: length(x)))"
                 f" + coalesce(list_sum(list_transform(h{n}[1:i-1], lambda x: length(x))), 0)")
        near = f"regexp_matches(right(g{n}[i], {pii.CONTEXT}), '(?i)(?:^|[^a-z])(?:{'|'.join(pii.CONTEXT_WORDS[kind])})')"
        spans.append(f"""list_transform(list_filter(range(1, len(h{n}) + 1), lambda i: {_valid(kind, f"h{n}[i]")}),
      lambda i: {{'start': ({start})::BIGINT, 'rank': {n}, 'kind': '{kind}', 'stop': ({start} + length(h{n}[i]))::BIGINT,
                  'score': {pii.SCORES[kind]} + CASE WHEN {near} THEN {pii.CONTEXT_BONUS} ELSE 0 END}})""")
    text = "coalesce(array_to_string(list_transform({s}, lambda x: x.kind || ':' || x.start || ':' || x.stop), ','), '')"
    base = f"list_filter(s, lambda x: x.rank < {len(pii.BASE_KINDS)})"
    counts = ", ".join(f"len(list_filter(s, lambda x: x.rank = {n}))::BIGINT AS n_{k}" for n, k in enumerate(pii.KINDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {", ".join(lists)} FROM d),
f AS (SELECT doc_id, list_sort({" || ".join(spans)}) AS s FROM m)
SELECT doc_id, {counts}, sha256({text.format(s=base)}) AS base_sha256, {text.format(s="s")} AS spans,
       list_min(list_transform(s, lambda x: x.score))::INT AS min_score,
       list_max(list_transform(s, lambda x: x.score))::INT AS max_score
FROM f
"""


#: Targets by repeated sharing of the excess (as many rounds as there are sources at most),
#: then one running sum a source.
MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || t), 1, 12))::BIGINT::DOUBLE + 0.5)
                / 281474976710656.0)
         / greatest(0.05, 1 - length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::DOUBLE
                          / greatest(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 1)) AS draw FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
shares AS (
  SELECT 0 AS round, source, source_size, weight, NULL::DOUBLE AS level, false AS full_ FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, l,
         full_ OR weight * l >= 3 * source_size
  FROM (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (full_) OVER (), 0))
                  / sum(weight) FILTER (NOT full_) OVER () AS l
        FROM shares WHERE round <= (SELECT count(*) FROM s)) x),
t AS (
  SELECT source, source_size, CASE WHEN full_ THEN 3.0 * source_size ELSE weight * level END::DOUBLE AS target
  FROM shares WHERE round = (SELECT max(round) FROM shares)),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND rest > 0 AND upto - size < rest
                                   AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


#: Checksums by the polynomial's 256-entry table, which the query itself derives; the draw by one sort.
RESAMPLE = rf"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SQL_WORD}') AS w,
         row_number() OVER () AS r FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SQL_WORD}') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
hashed AS (
  SELECT word, xor(list_reduce(
           list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::BIGINT + 1, 2))::BIGINT),
           lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
g AS (
  SELECT bucket, floor(ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))) * 1000)::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), n),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (
  SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place
  FROM scored)
SELECT doc_id, n::BIGINT AS n_features, weight, score,
       CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n >= 20) // 100 THEN place END::BIGINT AS rank
FROM ranked
"""

#: Every document through every order, step by step.
AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT row_number() OVER () AS r, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM w LEFT JOIN l USING (doc_id)),
fails AS (
  SELECT r, part, good, toxic, letter, CASE letter WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D
         ELSE f.E END AS fails, f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS n_fails
  FROM d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (  -- the step at which an order removes a document, 6 if it stays
  SELECT r, filter_order, min(CASE WHEN fails THEN instr(filter_order, letter) ELSE 6 END) AS place
  FROM fails, orders GROUP BY ALL),
rows_ AS (
  SELECT part, filter_order, instr(filter_order, letter) AS step, letter,
         count(*) FILTER (place > instr(filter_order, letter)) AS kept,
         count(*) FILTER (place = instr(filter_order, letter)) AS removed,
         count(*) FILTER (fails AND place < instr(filter_order, letter)) AS redundant,
         count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
         count(*) FILTER (good AND place = instr(filter_order, letter)) AS good_lost,
         count(*) FILTER (toxic AND place = instr(filter_order, letter)) AS toxic_lost
  FROM fails JOIN gone USING (r) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM rows_
"""

LICENSE = _license()
PII = _pii()

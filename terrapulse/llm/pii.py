"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

Each kind is matched over the whole text, leftmost and without overlaps. The patterns
are written so that the engine reads a text once (possessive runs that may begin only
where a run begins), whatever the text holds. Card numbers must pass Luhn and account
numbers (IBAN) mod 97; addresses and phone numbers are checked by their parts. Positions
are code points: text between the matches (``split``) and the matches are the same text,
so starts are running sums of their lengths.

A span's score (0 to 100) is its kind's base score plus ``CONTEXT_BONUS`` if one of the
kind's context words stands in the ``CONTEXT`` characters before it. Scores weigh spans;
they remove none.

The operator is one projection: no shuffle, no join, nothing gathered beyond a row.

Defined results: null text is empty and has no spans; an empty table gives an empty
result; rows that repeat get the same result each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import bind

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban"]

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run of digits with single blanks or hyphens between them, 14 to 19 digits in all.
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A literal that every match holds; texts without it aren't searched.
MARKS = {"email": "@", "ip": ".", "phone": "+"}
SCORES = {"email": 80, "ip": 60, "card": 80, "phone": 60, "iban": 90}
CONTEXT = 40
CONTEXT_BONUS = 10
CONTEXT_WORDS = {
    "email": ["mail", "contact", "write"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
}
BLOCK = 512


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + bind(F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
                                  lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda acc, i: bind(F.ascii(F.substring(turned, i, F.lit(1))), lambda c: F.when(
            c < 65, acc * 10 + c - 48).otherwise(acc * 100 + c - 55)) % 97)
    return rest == 1


def confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.replace(hit, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def running(values: Column) -> Column:
    """For each element the sum of those before it, in blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    part = lambda v, b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))

    def inside(v: Column, base: Column) -> Column:
        return F.transform(v, lambda _, i: base + total(F.slice(v, F.lit(1), i)))

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        sums = F.transform(numbers, lambda b: total(part(v, b)))
        return bind(sums, lambda s: F.flatten(F.transform(numbers, lambda b: bind(
            part(v, b), lambda p: bind(total(F.slice(s, F.lit(1), b)), lambda base: inside(p, base))))))

    return bind(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<int>")))


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<rank, kind, start, end, score>> of one kind, by start."""
    pattern = PATTERNS[kind]
    words = "|".join(CONTEXT_WORDS[kind])

    def place(gaps: Column, hits: Column) -> Column:
        before = F.slice(gaps, F.lit(1), F.size(hits))
        ends = F.zip_with(before, hits, lambda g, h: F.length(g) + F.length(h))
        rows = F.transform(F.arrays_zip(before.alias("g"), hits.alias("h"), running(ends).alias("s")), lambda r: F.struct(
            r["h"].alias("hit"), F.right(r["g"], F.lit(CONTEXT)).alias("near"), (r["s"] + F.length(r["g"])).alias("start")))
        score = lambda r: F.lit(SCORES[kind]) + F.when(r["near"].rlike(rf"(?i)(?<![a-z])(?:{words})"), CONTEXT_BONUS).otherwise(0)
        return F.transform(F.filter(rows, lambda r: confirmed(kind, r["hit"])), lambda r: F.struct(
            r["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
            (r["start"] + F.length(r["hit"])).alias("end"), score(r).alias("score")))

    found = bind(F.split(text, pattern, -1), lambda g: bind(F.regexp_extract_all(text, F.lit(pattern), 0), lambda h: place(g, h)))
    mark = text.contains(MARKS[kind]) if kind in MARKS else F.lit(True)
    return F.when(mark & text.rlike(pattern), found).otherwise(
        F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:int>>"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all confirmed spans of every document by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.concat(*[spans_of(k, text) for k in KINDS])
    return docs.select(F.col(id_col).alias("doc_id"), F.sort_array(every).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, all spans as text, and the lowest and highest score."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda n: F.size(F.filter("spans", lambda s: s["rank"] == n)).cast("long")
    scores = F.transform("spans", lambda s: s["score"])
    return found.select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.array_min(scores).alias("min_score"), F.array_max(scores).alias("max_score"))

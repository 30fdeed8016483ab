"""Line dedup: a template tree over the lines of all documents.

Level 1 of the tree is a line's token count, the next levels are its ``DEPTH`` leading
tokens; tokens with a digit count as the wildcard. Within a leaf, variable
fields are generalised by majority: a position keeps the token that more than
half of the leaf's distinct lines have there, else it is a wildcard. A line belongs to
the leaf's template if at least ``similarity`` of its tokens after the leading ones equal
the kept ones and enough constant tokens are among them (with the leading ones).

The other lines of a leaf form one more, fixed level. Their (position, token) pairs are ordered by how
many of them have each, most frequent first; lines with the same first pairs share a
prefix, and a line goes with the longest prefix that several lines share and that occurs
``min_docs`` times. Each such group is generalised by majority once more, so a leaf has as many
templates as its lines show, in two passes whatever the corpus. A line of no template is one
of its own. Templates found in ``min_docs`` documents or more are recurring: their lines are
dropped from every document but the first (smallest doc_id).

Constant tokens hold a letter and no digit. Enough of them are ``MIN_CONSTANT`` and half of
the line; a line with fewer, such as a row of numbers, isn't masked and counts by its own
words, so that it recurs only verbatim.

Lines of fewer than ``min_tokens`` tokens are never dropped. All lines are reduced to
hashes first (one narrow row a line, cut by a checkpoint); tokens are read again only
for leaves that hold several distinct lines and occur ``min_docs`` times. Supports are
counts of counts, so a line in a third of the documents costs a row a task. All prefixes
of a line come from one running combination of the hashes of its pairs and are counted in one
aggregate. Small key sets are broadcast after they are counted; larger ones are joined by
a shuffle.

Defined results: null text stays null; rows that repeat a doc_id and text are one
document; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import bind, checkpointed, fresh, matches, sized, text_key, words

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 4
SIMILARITY = 0.7
WILDCARD = "<*>"
#: Constant tokens that a template has at least, besides half of its tokens.
MIN_CONSTANT = 2
#: A token with a digit in it.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"


def _constant(token: Column) -> Column:
    return (token != WILDCARD) & token.rlike(r"\p{L}")


def _enough(constants: Column, size: Column) -> Column:
    return (constants >= MIN_CONSTANT) & (2 * constants >= size)


def tokens(line: Column) -> Column:
    masked = lambda: words(F.regexp_replace(line, VARIABLE, WILDCARD))
    return F.when(line.rlike("[0-9]"), bind(masked(), lambda t: F.when(
        _enough(F.size(F.filter(t, _constant)), F.size(t)), t).otherwise(words(line)))).otherwise(words(line))


def _leaf(t: Column) -> Column:
    return F.xxhash64(F.size(t), *[F.get(t, F.lit(i)) for i in range(DEPTH)])


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_tokens: int) -> DataFrame:
    """(doc_id, text_key, line_no, leaf, line): hashes of every line long enough."""
    keys = F.transform(_lines(F.col(text_col)), lambda x, i: bind(tokens(x), lambda t: F.struct(
        i.alias("line_no"), F.size(t).alias("n"), _leaf(t).alias("leaf"), F.xxhash64(t).alias("line"))))
    every = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.inline(keys))
    return every.where(F.col("n") >= min_tokens).drop("n")


def generalised(docs: DataFrame, keys: DataFrame, text_col: str, min_docs: int, similarity: float) -> DataFrame:
    """(m_line, m_template): the distinct lines that belong to a template of several lines."""
    varied = checkpointed(keys.groupBy("leaf").agg(F.count("*").alias("n"), F.min("line").alias("a"), F.max("line").alias("b"))
                          .where((F.col("a") != F.col("b")) & (F.col("n") >= min_docs)).select("leaf"))
    read = docs.select(F.explode(_lines(F.col(text_col))).alias("text")).select(tokens(F.col("text")).alias("tokens"))
    lines = (read.withColumn("leaf", _leaf(F.col("tokens"))).join(sized(varied), "leaf", "left_semi")
             .withColumn("line", F.xxhash64("tokens")).groupBy("leaf", "line")
             .agg(F.count("*").alias("times"), F.any_value("tokens").alias("tokens")))
    # Leaves of as many tokens as the leading ones hold one line.
    lines = checkpointed(lines.where(F.size("tokens") > DEPTH).withColumnRenamed("leaf", "group"))
    first = checkpointed(_judged(lines, similarity))
    others = first.where("not member").drop("member")
    second = _judged(checkpointed(_regrouped(others, min_docs)), similarity)
    members = lambda judged, level: judged.where("member").select(
        F.col("line").alias("m_line"), F.xxhash64("group", F.lit(level)).alias("m_template"))
    return members(first, 1).unionByName(members(second, 2))


def _fields(lines: DataFrame) -> DataFrame:
    """The (position, token) pairs of lines after the leading tokens."""
    return lines.select("group", "line", "times", F.posexplode("tokens").alias("pos", "token")).where(F.col("pos") >= DEPTH)


def _judged(lines: DataFrame, similarity: float) -> DataFrame:
    """Lines (group, line, times, tokens), and whether each belongs to the template of its group's majority."""
    groups = lines.groupBy("group").agg(F.count("*").alias("n"))
    seen = _fields(lines).groupBy("group", "pos", "token").agg(F.count("*").alias("seen")).where(F.col("seen") > 1)
    kept = (seen.join(groups, "group").where(2 * F.col("seen") > F.col("n")).groupBy("group")
            # One entry a position at most, so the map is as long as a line.
            .agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("kept")))
    size = F.size("tokens")
    same = F.filter("tokens", lambda t, i: (i < DEPTH) | F.col("kept")[i].eqNullSafe(t))
    alike = (F.size("same") - DEPTH >= F.round(similarity * (size - DEPTH), 9)) & _enough(F.size(F.filter("same", _constant)), size)
    return lines.join(kept, "group", "left").withColumn("same", same).select(
        "group", "line", "times", "tokens", alike.alias("member"))


def _regrouped(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines by their longest shared prefix of pairs; those without one are left out."""
    fields = _fields(lines)
    seen = fields.groupBy("group", "pos", "token").agg(F.count("*").alias("seen")).where(F.col("seen") > 1)
    of_line = Window.partitionBy("line").orderBy(F.desc("seen"), "pos")  # the pairs of one line
    prefixes = fields.join(seen, ["group", "pos", "token"]).select(
        "group", "line", "times", F.row_number().over(of_line).alias("k"),
        F.bit_xor(F.xxhash64("pos", "token")).over(of_line.rowsBetween(Window.unboundedPreceding, 0)).alias("pairs"))
    prefixes = checkpointed(prefixes)
    held = prefixes.groupBy("group", "k", "pairs").agg(F.count("*").alias("n"), F.sum("times").alias("all"))
    held = held.where((F.col("n") > 1) & (F.col("all") >= min_docs)).select("group", "k", "pairs")
    longest = prefixes.join(held, ["group", "k", "pairs"]).groupBy("line").agg(F.max(F.struct("k", "pairs")).alias("top"))
    return lines.join(longest, "line").select(F.xxhash64("group", "top").alias("group"), "line", "times", "tokens")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS,
                    min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """(r_id, r_key, dropped): the numbers of the lines to drop, by document."""
    keys = checkpointed(line_keys(docs, id_col, text_col, min_tokens))
    members = checkpointed(generalised(docs, keys, text_col, min_docs, similarity))
    joined = keys.join(sized(members), F.col("line") == F.col("m_line"), "left")
    template = F.coalesce("m_template", F.xxhash64("line", F.lit(0)))
    lines = joined.select("doc_id", "text_key", "line_no", template.alias("template"))
    doc = F.struct("doc_id", "text_key")
    recurring = checkpointed(
        lines.groupBy("template", "doc_id", "text_key").agg(F.lit(1).alias("one"))
        .groupBy("template").agg(F.count("*").alias("docs"), F.min(doc).alias("first"))
        .where(F.col("docs") >= min_docs).select("template", "first"))
    later = lines.join(sized(recurring), "template").where(~doc.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")).select(
        F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), "dropped")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS,
               min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the text cleaned, and a struct column ``line_dedup`` (n_lines, n_dropped, dropped)."""
    key, info = fresh(docs, "text_key"), fresh(docs, "line_dedup")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    gone = recurring_lines(docs, id_col, text_col, min_tokens, min_docs, similarity)
    joined = keyed.join(gone, matches(keyed, gone, {id_col: "r_id", key: "r_key"}), "left")

    def rest(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped"))
        return F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")

    text = F.when(F.col("dropped").isNull(), F.col(text_col)).otherwise(bind(_lines(F.col(text_col)), rest))
    dropped = F.coalesce(F.col("dropped"), F.array().cast("array<int>"))
    stats = F.struct(F.size(_lines(F.col(text_col))).alias("n_lines"), F.size(dropped).alias("n_dropped"),
                     dropped.alias("dropped"))
    return joined.select(*[text.alias(c) if c == text_col else keyed[c] for c in docs.columns], stats.alias(info))

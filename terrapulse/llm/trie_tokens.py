"""Token counts: unigram forward scores, shared along a trie of pre-tokens.

A pre-token's count is the number of pieces in its best segmentation under a unigram
model. The forward score of a prefix is the best sum of log-probabilities over ways to
cut it; it depends on the prefix alone, so pre-tokens with a common prefix share it. The
distinct pre-tokens of a part are walked in sorted order, which is the depth-first walk
of their trie: the current path holds one forward score a node, each node is computed
once, and only terminal nodes store their count and score.

The model is the vocabulary of a public tokenizer; a piece's log-probability follows
Zipf's law on its rank in the vocabulary. A character outside the vocabulary counts as
its UTF-8 bytes, each with ``BYTE_PENALTY`` below the rarest piece. Equal scores go to
fewer pieces.

Tasks work on whole texts without any shuffle. A worker remembers terminals between parts
and tasks up to a bound (``REMEMBERED``); what is forgotten is computed again.

Defined results: null and blank texts have no pre-tokens and count 0; rows that repeat
count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.texts import Remembered, grouped, words_of

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
BYTE_PENALTY = 5.0
REMEMBERED = 75_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def unigram(path: str) -> tuple[dict[str, float], float, int]:
    """(log-probability by piece, log-probability of a byte, longest piece)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = log(sum(1 / (r + 1) for r in range(len(normal))))
    scores = {p: -log(r + 1) - total for r, p in enumerate(normal)}
    return scores, min(scores.values()) - BYTE_PENALTY, max(map(len, normal))


def terminal_counts(tokens: list[str], model: tuple[dict[str, float], float, int]) -> Iterator[tuple[str, int, float]]:
    """(pre-token, pieces, score) for sorted distinct pre-tokens, one computation a trie node."""
    scores, byte, longest = model
    find = scores.get
    path, best, count = "", [0.0], [0]
    for token in tokens:
        word = START + token
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            char = word[end - 1]
            p = find(char)
            if p is None:  # no piece of its own: its bytes, which score below any piece
                own = len(char.encode("utf-8", "surrogatepass"))
                top, pieces = best[end - 1] + own * byte, count[end - 1] + own
            else:
                top, pieces = best[end - 1] + p, count[end - 1] + 1
            for begin in range(end - longest if end > longest else 0, end - 1):
                p = find(word[begin:end])
                if p is not None:
                    s, n = best[begin] + p, count[begin] + 1
                    if s > top or s == top and n < pieces:
                        top, pieces = s, n
            best.append(top)
            count.append(pieces)
        path = word
        yield token, count[-1], best[-1]


class Terminals:
    """What the tries of a worker's parts have found: pieces and score of pre-tokens, kept as
    one complex number (pieces + score i) so that a text's sums take one pass."""

    def __init__(self, path: str):
        self.model, self.known = unigram(path), Remembered(REMEMBERED)

    def learn(self, tokens: set[str]) -> None:
        for token, n, score in terminal_counts(sorted(self.known.missing(tokens)), self.model):
            self.known[token] = complex(n, score)

    def sums(self, part: list[str]) -> complex:
        return sum(map(self.known.__getitem__, part), 0j)


@lru_cache(maxsize=1)
def _terminals(path: str) -> Terminals:
    """A worker's memory of terminals, which outlives its tasks."""
    return Terminals(path)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals = _terminals(path)
        for batch in batches:
            words, found = [0] * batch.num_rows, [0j] * batch.num_rows
            for parts in grouped(batch.column("text")):
                group = [(row, words_of(text)) for row, text in parts]
                terminals.learn({t for _, part in group for t in part})
                for row, part in group:
                    words[row] += len(part)
                    found[row] += terminals.sums(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array([int(x.real) for x in found], pa.int64()),
                 pa.array([x.imag for x in found], pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])
    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_pretokens, n_tokens and the score of its best segmentation."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_counter(path or vocabulary_path()),
                           "doc_id long, n_pretokens long, n_tokens long, score double")

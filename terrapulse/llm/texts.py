"""Text pieces for code inside tasks: bounded memory whatever a text's length."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

WORD = re.compile(r"[^\x20\x09-\x0d]+")
_SPACE = re.compile(r"[\x20\x09-\x0d]")
#: What ``str.split`` takes for white space beyond that.
_WIDER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PART = 1 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if _WIDER.search(text) else text.split()


def text_parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PART`` characters, cut at white space."""
    at = 0
    while len(text) - at > 2 * PART:
        stop = _SPACE.search(text, at + PART)
        if stop is None:
            break
        yield text[at:stop.start()]
        at = stop.start()
    yield text[at:] if at else text


def word_parts(text: str) -> Iterator[list[str]]:
    """The words of a text, part by part."""
    return map(words_of, text_parts(text))


def grouped(texts: Iterable) -> Iterator[list[tuple[int, str]]]:
    """(row, part of its text) of an Arrow column, in groups of about two parts' size."""
    group, size = [], 0
    for row, value in enumerate(texts):
        for part in text_parts(value.as_py()):
            group.append((row, part))
            size += len(part)
            if size >= 2 * PART:
                yield group
                group, size = [], 0
    if group:
        yield group


class Remembered(dict):
    """What is known of words, for at most about twice ``limit`` of them: a full young
    generation becomes the old one, and words met again are taken over from there.
    ``make`` finds out about a word that is looked up and not known."""

    def __init__(self, limit: int, make: Callable[[str], object] | None = None):
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def _age(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self._age()
        self[word] = value
        return value

    def missing(self, words: set[str]) -> set[str]:
        """The words to be learnt; all others can be looked up until the next call."""
        self._age()
        new = words.difference(self)
        known = [w for w in new if w in self.old]
        self.update((w, self.old[w]) for w in known)
        new.difference_update(known)
        return new

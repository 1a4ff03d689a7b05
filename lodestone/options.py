"""Search options and the two readings of a query string: what is searched and what is highlighted."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

DEFAULT_TOP_K = 32
#: Compared with squared distances; unit vectors are within it at a cosine above 0.2929.
DEFAULT_RADIUS = math.sqrt(2)
MIN_PHRASE = 3


@dataclass(frozen=True)
class SearchOptions:
    """Hashable, so that it keys the result cache.

    `refresh` brings the index up to date before the search, `rebuild_vectors` embeds all texts anew then, `stats` prints
    the run's counters and times after it. None of the three changes what is found at one state of the index."""

    query: str
    top_k: int = DEFAULT_TOP_K
    radius: float = DEFAULT_RADIUS
    semantic: bool = True
    full_text: bool = True
    rerank: bool = False
    refresh: bool = field(default=False, compare=False)
    rebuild_vectors: bool = field(default=False, compare=False)
    stats: bool = field(default=False, compare=False)


def _closing(text: str, at: int, escapes: bool, one_line: bool) -> int:
    """The place of the quote that closes a phrase begun before `at`, or -1."""
    while at < len(text):
        c = text[at]
        if c == '"':
            return at
        if one_line and c == "\n":
            return -1
        at += 2 if escapes and c == "\\" else 1
    return -1


def _runs(text: str, escapes: bool, one_line: bool, glued: bool) -> Iterator[tuple[bool, str]]:
    """The parts of a query in turn: (True, what stands between two quotes) or (False, letters up to the next space).

    A quote that nothing closes is a letter. With `escapes` a backslash keeps the quote behind it from closing; with
    `one_line` a phrase ends before a line feed or not at all; with `glued` quotes inside a word are its letters."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] == '"':
            end = _closing(text, at + 1, escapes, one_line)
            if end >= 0:
                yield True, text[at + 1 : end]
                at = end + 1
                continue
        begin, at = at, at + 1
        while at < len(text) and not text[at].isspace() and (glued or text[at] != '"' or _closing(text, at + 1, escapes, one_line) < 0):
            at += 1
        yield False, text[begin:at]


@dataclass(frozen=True)
class Query:
    """Quoted phrases (with \\" for a quote inside) and bare keywords, for highlighting."""

    phrases: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    original: str = field(default="", compare=False)

    @classmethod
    def parse(cls, text: str) -> Query:
        found: dict[bool, list[str]] = {True: [], False: []}
        for quoted, part in _runs(text, escapes=True, one_line=False, glued=True):
            found[quoted].append(part.replace('\\"', '"') if quoted else part)
        return cls(tuple(p for p in found[True] if p), tuple(found[False]), text)

    @property
    def terms(self) -> tuple[str, ...]:
        return self.keywords + self.phrases


def searchable(text: str) -> bool:
    """Whether a query being typed is long enough to search for."""
    return len(text.strip()) >= MIN_PHRASE


def match_phrases(text: str) -> list[str]:
    """The phrases a full-text match needs, all of them, case-folded: quoted ones whole, others word by word. An odd quote is closed
    at the end, escapes mean nothing here.

    Those shorter than a trigram say nothing beside longer ones and are dropped; alone they match nothing."""
    closed = text + '"' * (text.count('"') % 2)
    parts = (part.replace('"', "") for _, part in _runs(closed, escapes=False, one_line=True, glued=False))
    return [p.lower() for p in parts if len(p) >= MIN_PHRASE]

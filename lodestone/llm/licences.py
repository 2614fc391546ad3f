"""Scans for licence notices: exact names, and short notices with a bounded number of edits.

Texts are held as words (A-Z in lower case) with one space between. A notice of m characters may be there with up to
m / 10 edits, four at most (inserted, deleted, exchanged characters). Cut into one piece more than that, at least one piece of it stands
in the text unchanged, so one automaton over the pieces of all notices finds every place where a notice can be. Each
is then verified by the regex library's bounded-error matching in a window about the place, which tells span and edits.

Defined results: null and blank texts have no words, no labels and the score 0; every place counts, repeats and
overlaps too; of several matches of a notice over the same words the one with fewest edits is reported, ties to the first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import quoted
from .common import slices, thrifty

#: Names whose words are looked for as they are.
NAMES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices and their labels. Those under SHORT characters must stand as whole words without an edit.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "cc0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("epl", "eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mozilla public license"),
    ("rights-reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: A notice may differ in one of so many characters, in MOST_EDITS at most, and not at all if it is shorter than SHORT.
#: The time of bounded-error matching grows fast with the errors: a place takes under a millisecond with four.
CHARACTERS_AN_EDIT = 10
MOST_EDITS = 4
SHORT = 20

_NOT_WORDS = bytes(c if chr(c).isalnum() or c >= 0x80 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal(text: str) -> str:
    """The words of a text with one space between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().translate(_NOT_WORDS).split()).decode("utf-8", "surrogatepass")


def edits(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARACTERS_AN_EDIT) if len(notice) >= SHORT else 0


def pieces(notice: str) -> list[tuple[int, str]]:
    """(place, piece): one more than the edits, so that one of them stands in every match. Whole if no edit is allowed."""
    n = edits(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in pairwise(cuts)]


class Scanner:
    """The automaton and patterns of a list of (label, notice)."""

    def __init__(self, notices: Sequence[tuple[str, str]] = NOTICES, names: dict[str, str] | None = None) -> None:
        self.notices, self.names = tuple(notices), dict(NAMES if names is None else names)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (_, notice) in enumerate(self.notices):
            for at, piece in pieces(notice):
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={edits(n)}}}") for _, n in self.notices]
        self.verified = lru_cache(100_000)(self._verified)

    def _verified(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best match of a notice in a window."""
        found = self.patterns[k].search(window)
        return None if found is None else (*found.span(), sum(found.fuzzy_counts))

    def matches(self, words: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a text of words: candidates from seeds, verified, one for overlapping ones."""
        if not self.notices:
            return []
        windows: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(words):
            for k, at in where:
                windows.add((k, last + 1 - size - at))
        found = []
        for k, start in sorted(windows):
            notice = self.notices[k][1]
            most, n = edits(notice), len(notice)
            if not most:
                if (start and words[start - 1] != " ") or words[start + n : start + n + 1] not in ("", " "):
                    continue
                found.append((k, start, start + n, 0))
                continue
            low = max(0, start - most)
            match = self.verified(k, words[low : start + n + most])
            if match:
                found.append((k, low + match[0], low + match[1], match[2]))
        out: list[tuple[int, int, int, int]] = []
        for k, start, end, wrong in found:  # by notice, then by place
            if out and out[-1][0] == k and start < out[-1][2]:
                if wrong < out[-1][3]:
                    out[-1] = (k, start, end, wrong)
            else:
                out.append((k, start, end, wrong))
        return out

    def exact(self, words: str) -> list[tuple[int, str]]:
        """(first word, label) of every name."""
        padded, out = f" {words} ", []
        for name, label in self.names.items():
            wanted, at, counted, word = f" {name} ", -1, 0, 0
            while (at := padded.find(wanted, at + 1)) >= 0:
                word += padded.count(" ", counted, at)
                counted = at
                out.append((word, label))
        return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
_FOUND = (
    ("n_words", pa.int64(), "long"),
    ("n_base", pa.int64(), "long"),
    ("first_word", pa.int64(), "long"),
    ("last_word", pa.int64(), "long"),
    ("base_labels", pa.string(), "string"),
    ("labels", pa.string(), "string"),
    ("score", pa.float64(), "double"),
    ("spans", _SPANS, "array<struct<label: string, start: bigint, end: bigint, edits: int>>"),
)


def found(scanner: Scanner, text: str | None) -> dict:
    """What scan() tells of a text."""
    words = normal(text or "")
    base, fuzzy = scanner.exact(words), scanner.matches(words)
    labels = {label for _, label in base}
    spans: list[dict] = []
    score = 1.0 if base else 0.0
    if fuzzy:
        places = [m.span() for m in _WORD.finditer(text or "")]
        spaces = [at for at, c in enumerate(words) if c == " "]
        for k, start, end, wrong in sorted(fuzzy, key=lambda m: (m[1], m[0])):
            label, notice = scanner.notices[k]
            first = bisect_left(spaces, start) + (words[start] == " ")
            last = bisect_left(spaces, end) - (words[end - 1] == " ")
            spans.append({"label": label, "start": places[first][0], "end": places[last][1], "edits": wrong})
            score = max(score, 1 - wrong / len(notice))
    return {
        "n_words": words.count(" ") + 1 if words else 0,
        "n_base": len(base),
        "first_word": min((w for w, _ in base), default=None),
        "last_word": max((w for w, _ in base), default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
        "score": score,
        "spans": spans,
    }


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row: the places of NAMES,
    their labels and those of all notices, one less the share of edits in the best match, and the notices' spans in code
    points of the text. Rows stay where they are."""
    own = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own)
        for whole in batches:
            for batch in slices(whole, 1):  # few texts at a time
                rows = [found(scanner, t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], kind) for n, kind, _ in _FOUND)], names=["key", *(n for n, _, _ in _FOUND)])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(quoted(key).alias("key"), quoted(text).alias("text")).mapInArrow(thrifty(run), f"key {kind}, " + ", ".join(f"{n} {k}" for n, _, k in _FOUND))
    return out.select(F.col("key").alias(key), *[n for n, _, _ in _FOUND])

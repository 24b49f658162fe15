"""License scan: fuzzy search for short notices.

Each notice may differ from a text by a bounded number of edits k. Split into k + 1 pieces, at least
one piece of it must then occur exactly (pigeonhole), so one Aho-Corasick pass over the pieces of all
notices finds every place worth a look; the regex library's bounded-error matching verifies the edits
there and gives the span. Exact phrases are notices with k = 0: their only piece is the phrase.
A text is seen as its lower-cased words joined by single spaces. No shuffle: one pass over the rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quarry.llm.common import map_rows

# Phrases and labels of the exact base search.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Short notices and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("eclipse public license", "epl"),
    ("distributed under the boost software license version 1 0", "boost"),
    ("in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd"),
    ("distributed under the terms of the artistic license", "artistic"),
    ("under the terms of the gnu free documentation license", "gfdl"),
    ("dedicated to the public domain under the creative commons zero", "cc0"),
    ("common development and distribution license", "cddl"),
    ("licensed under the microsoft public license", "ms-pl"),
    ("python software foundation license version 2", "psf"),
    ("licensed under the european union public licence", "eupl"),
    ("this font software is licensed under the sil open font license", "ofl"),
    ("as a special exception the copyright holders of this library give you permission to link this library", "classpath-exception"),
    ("licensed under the apache license v2 0 with llvm exceptions", "llvm-exception"),
    ("spdx license identifier", "spdx"),
)

#: One edit is allowed for so many characters of a notice, up to MOST_EDITS.
CHARS_PER_EDIT = 15
MOST_EDITS = 5

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"

_SEPARATORS = bytes((c if c >= 0x80 or chr(c).isalnum() else 0x20) for c in bytes(range(256)).lower())


def normalised(text: str | None) -> tuple[str, int]:
    """The words between single spaces, with a space at both ends, and their number."""
    words = (text or "").encode("utf-8", "replace").translate(_SEPARATORS).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} ", len(words)


def edits_allowed(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about the same length, with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Hit:
    label: str
    start: int  # first word
    end: int  # after the last word
    edits: int
    score: float
    base: bool


class Scanner:
    """The compiled notices. It is built in the worker, once for each task."""

    def __init__(self, base=BASE, notices=NOTICES):
        import ahocorasick
        import regex

        self.notices = [(f" {n} ", label, 0, None, True) for n, label in base]
        for n, label in notices:
            k = edits_allowed(n)
            self.notices.append((n, label, k, regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}"), False))
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k, _, _) in enumerate(self.notices):
            for at, piece in pieces(n, k):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def scan(self, words: str) -> list[Hit]:
        """All hits in normalised words, by notice and place."""
        windows: dict[int, list[list[int]]] = {}
        hits, spaces = [], None
        for last, (length, where) in self.seeds.iter(words):
            if spaces is None:  # places of the spaces, to number words: a text without a seed needs none
                spaces = [i for i, c in enumerate(words) if c == " "]
            for i, at in where:
                n, label, k, _, exact = self.notices[i]
                start = last + 1 - length - at
                if exact:
                    first = bisect_right(spaces, start) - 1
                    hits.append(Hit(label, first, first + n.count(" ") - 1, 0, 1.0, True))
                    continue
                lo, hi = max(0, start - k), min(len(words), start + len(n) + k)
                own = windows.setdefault(i, [])
                if own and lo <= own[-1][1] and lo >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        for i, spans in windows.items():
            n, label, k, pattern, _ = self.notices[i]
            seen = set()
            for lo, hi in spans:
                for start, stop, edits in every_match(n, pattern, words, lo, hi, len(n) - k):
                    first = bisect_right(spaces, start + (words[start] == " ") - 1) - 1
                    end = bisect_right(spaces, stop - (words[stop - 1] == " ") - 1)
                    if (first, end) not in seen:
                        seen.add((first, end))
                        hits.append(Hit(label, max(first, 0), end, edits, 1 - edits / len(n), False))
        return hits


def every_match(notice: str, pattern, words: str, lo: int, hi: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of the best match of words[lo:hi], and likewise of those before and after it; none is shorter than ``least``.

    No match is better than the notice itself, so its literal places come first and cost no search with errors.
    """
    left, at = [], lo
    while (found := words.find(notice, at, hi)) >= 0:
        left.append((at, found))
        at = found + len(notice)
        yield found, at, 0
    left.append((at, hi))
    while left:
        lo, hi = left.pop()
        m = pattern.search(words, lo, hi) if hi - lo >= least else None
        if m:
            yield m.start(), m.end(), sum(m.fuzzy_counts)
            left += [(lo, m.start()), (m.end(), hi)]


def scan_row(scanner: Scanner, text: str | None) -> tuple:
    words, n = normalised(text)
    hits = scanner.scan(words)
    base = [h for h in hits if h.base]
    fuzzy = sorted((h for h in hits if not h.base), key=lambda h: (h.start, h.end, h.label, h.edits))
    return (
        n,
        len(base),
        min((h.start for h in base), default=None),
        max((h.start for h in base), default=None),
        ",".join(sorted({h.label for h in base})),
        ",".join(sorted({h.label for h in hits})),
        max((h.score for h in hits), default=0.0),
        ",".join(f"{h.label}:{h.start}:{h.end}:{h.edits}" for h in fuzzy),
    )


def license_scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), base=BASE, notices=NOTICES) -> DataFrame:
    """The columns ``keep`` of docs, and what the scan finds in each whole text.

    notices has label:start:end:edits of every verified fuzzy match, in words, end exclusive. score is the
    best 1 - edits / length of any match, 0 without one. Null and empty texts: no words, no labels, score 0,
    null first_word and last_word. Rows that repeat are scanned each; an empty table gives an empty result.
    Other columns of docs are not read; a kept one whose name is a result's gets underscores at its end.
    """

    def rows():
        scanner = Scanner(base, notices)
        return lambda texts: list(zip(*(scan_row(scanner, t) for t in texts))) or [[]] * len(SCHEMA.split(", "))

    return map_rows(docs, [docs[text]], list(keep), SCHEMA, rows)

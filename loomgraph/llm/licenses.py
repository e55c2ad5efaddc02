"""Fuzzy search for short license notices (op 1).

A notice of which k characters may be wrong is cut into k + 1 pieces; a match with k errors or fewer
holds one of them unchanged. All pieces of all notices are sought at once by an Aho-Corasick
automaton; around each hit the regex library's bounded-error matching verifies the notice and says
where it is and how many errors it has.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import dealt, mapped_pandas

# The phrases that are counted exactly, in lower case words, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices that are sought with errors, and their labels. Digits at the end must agree.
NOTICES = (
    ("under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution license", "cc-by"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("released into the public domain", "public-domain"),
    ("eclipse public license version 2", "epl-2"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license version 1", "bsl-1"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons zero", "cc0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("gnu free documentation license", "gfdl"),
)
#: One error for so many characters, one at least and three at most.
CHARS_AN_ERROR, MOST_ERRORS = 10, 3

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; runs of characters other than ASCII separators, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Notice:
    """A notice's pattern with errors, and the pieces of which any match holds one."""

    def __init__(self, phrase: str, label: str):
        self.phrase, self.label = phrase, label
        body, tail = re.fullmatch(r"(.*?)((?: \d+)?)", phrase).groups()
        self.errors = min(MOST_ERRORS, max(1, len(body) // CHARS_AN_ERROR))
        self.pattern = regex.compile(rf"(?<= )(?:{regex.escape(body)}){{e<={self.errors}}}{regex.escape(tail)}(?= )", regex.BESTMATCH)
        cuts = [len(body) * i // (self.errors + 1) for i in range(self.errors + 2)]
        self.pieces = [(i, body[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def around(self, line: str, at: int, offset: int) -> tuple[int, int, int] | None:
        """(start, end, errors) of the best match that a piece found at ``at`` can belong to."""
        low = max(0, at - offset - self.errors - 1)
        m = self.pattern.search(line, low, min(len(line), at - offset + len(self.phrase) + self.errors + 1))
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None


class LicenseScanner:
    def __init__(self, notices=NOTICES, base=BASE):
        self.notices = [Notice(p, label) for p, label in notices]
        self.base = base
        pieces: dict[str, list[tuple[Notice, int]]] = {}
        for n in self.notices:
            for offset, piece in n.pieces:
                pieces.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def spans(self, line: str) -> list[tuple[int, int, int, Notice]]:
        """Matches in a line of words (a space before and after each), none overlapping; of those that do, the one with most right characters stays."""
        found: dict[tuple[int, int, Notice], int] = {}
        for end, (size, of) in self.automaton.iter(line):
            for notice, offset in of:
                if m := notice.around(line, end - size + 1, offset):
                    found[m[0], m[1], notice] = min(m[2], found.get((m[0], m[1], notice), 99))
        ranked = sorted(((a, b, e, n) for (a, b, n), e in found.items()), key=lambda x: (x[2] - len(x[3].phrase), x[2], x[0], x[3].label))
        kept: list[tuple[int, int, int, Notice]] = []
        taken: list[tuple[int, int]] = []
        for a, b, e, n in ranked:
            at = bisect_left(taken, (a, b))  # those taken are disjoint, so only the two neighbours can overlap
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                kept.append((a, b, e, n))
                taken.insert(at, (a, b))
        return sorted(kept, key=lambda x: x[0])

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
        places, base_labels = [], set()
        for phrase, label in self.base:
            sought, at = f" {phrase} ", line.find(f" {phrase} ")
            while at >= 0:
                places.append(at)
                base_labels.add(label)
                at = line.find(sought, at + 1)
        spans = self.spans(line)
        starts = sorted({*places, *(a - 1 for a, _, _, _ in spans)} | {b for _, b, _, _ in spans})
        word_at, seen, before = {}, 0, 0
        for p in starts:  # a word's number is the number of spaces before it
            seen += line.count(" ", before, p)
            word_at[p], before = seen, p
        first = [word_at[p] for p in places]
        bounds = _bounds(text) if spans else []
        rows = [
            {"label": n.label, "start_word": (i := word_at[a - 1]), "end_word": (j := word_at[b]), "start_char": bounds[i][0], "end_char": bounds[j - 1][1], "errors": e}
            for a, b, e, n in spans
        ]
        labels = base_labels | {n.label for _, _, _, n in spans}
        score = max([1.0] * bool(places) + [1 - e / len(n.phrase) for _, _, e, n in spans], default=0.0)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(first, default=None), "last_word": max(first, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": score, "spans": rows,
        }


def _bounds(text: str) -> list[tuple[int, int]]:
    """Where each word starts and ends in the text, in characters."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at, chars = [], 0, 0
    for m in _WORD.finditer(raw):
        i = chars + len(raw[at : m.start()].decode("utf-8", "surrogatepass"))
        j = i + len(m.group().decode("utf-8", "surrogatepass"))
        out.append((i, j))
        at, chars = m.end(), j
    return out


SPAN = "struct<label: string, start_word: long, end_word: long, start_char: long, end_char: long, errors: int>"


def scan_licenses(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base places are exact; spans are the verified matches with errors, in words and in characters
    of the text. score is that of the best match, 1 less its errors over its length; 0 without one.
    Null, empty and blank texts have no words and no labels (empty strings, first and last null).
    Repeated rows get a row each; a null doc_id stays null; other columns are ignored; an empty
    table gives an empty result.
    Texts of any length are taken whole.
    """
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = LicenseScanner(notices)
        for b in batches:
            out = pd.DataFrame([scanner.scan(t) for t in b["text"]], columns=columns)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"
    return mapped_pandas(dealt(docs.select("doc_id", "text")), run, out, "licenses")

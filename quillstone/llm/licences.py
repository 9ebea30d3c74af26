"""Licence scans: Aho-Corasick over words, and evaluated licence expressions.

Notice phrases and tags are found by one automaton over the lower-cased words,
one space between them.  After an identifier tag the rest of the line is read as
an expression of licence names with and / or / with and brackets; a
shunting-yard parser evaluates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrowtext import LOWER, joined, slices, word_spans

#: Words are digits, a-z and every character from U+0080.
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[97:123] = NON_WORD[128:] = False

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The scan's own notices.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc0 1 0 universal": "cc0-1.0",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}

TAGS = ("spdx license identifier", "license expression")

#: How freely a text under the licence may be used, 0 to 1, by the start of its name; the longest that fits holds.
FREEDOM = {
    "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 0.95, "bsd": 0.95, "isc": 0.95, "apache": 0.9, "cc-by": 0.85, "zlib": 0.95,
    "mpl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.2, "cc-by-nd": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.25

_TOKEN = re.compile(r"[()/]|[A-Za-z0-9.+\-]+")
_POWER = {"or": 1, "/": 1, "and": 2, "with": 3}

#: Identifiers of the public list of licence names without a version that FREEDOM doesn't hold.
UNVERSIONED = frozenset("beerware curl ftl hpnd icu ijg intel libpng libtiff naist-2003 ncsa openssl postgresql ruby sleepycat vim wtfpl x11".split())

#: Other identifiers have a version; names of exceptions have two parts.
_VERSIONED = re.compile(r"[a-z][a-z0-9]*(?:-[a-z]+)*-\d+(?:\.\d+)*(?:-[a-z0-9]+)*\+?|licenseref-[a-z0-9.\-]+")
_EXCEPTION = re.compile(r"[a-z0-9]+(?:-[a-z0-9.]+)+")


def freedom(name: str) -> float:
    fits = [k for k in FREEDOM if name == k or name.startswith((k + "-", k + "+"))]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def is_name(word: str) -> bool:
    """Whether a lower-case word is the identifier of a licence and not a word of prose."""
    return word in UNVERSIONED or bool(_VERSIONED.fullmatch(word)) or any(word == k or word.startswith((k + "-", k + "+")) for k in FREEDOM)


def evaluated(expression: str) -> tuple[float, list[str]] | None:
    """Freedom and names of a licence expression; None if it isn't one.

    ``or`` and a slash offer a choice (the larger), ``and`` demands both (the
    smaller), ``with`` grants an exception (a tenth of what is missing).  Names and
    operators are read in lower case, the longest valid beginning counts; a word
    that is no identifier ends it, so prose after a tag names no licence.
    """
    values: list[float] = []
    marks: list[str] = []
    names: list[str] = []
    wants = True  # an operand comes next

    def apply() -> None:
        mark, b = marks.pop(), values.pop()
        a = values.pop()
        values.append(max(a, b) if mark in ("or", "/") else min(a, b) if mark == "and" else a + (1 - a) * 0.1)

    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word == "(":
            if not wants:
                break
            marks.append(word)
        elif word == ")":
            if wants or "(" not in marks:
                break
            while marks[-1] != "(":
                apply()
            marks.pop()
        elif word in _POWER:
            if wants:
                break
            while marks and marks[-1] != "(" and _POWER[marks[-1]] >= _POWER[word]:
                apply()
            marks.append(word)
            wants = True
        else:
            exception = bool(marks) and marks[-1] == "with"
            if not wants or not (_EXCEPTION.fullmatch(word) if exception else is_name(word)):
                break
            values.append(0.0 if exception else freedom(word))
            if not exception:
                names.append(word)
            wants = False
    if wants:  # an operator without its right side, or nothing at all
        while marks and marks[-1] == "(":
            marks.pop()
        if marks:
            marks.pop()
    while marks and values:
        if marks[-1] == "(":
            marks.pop()
        elif len(values) >= 2:
            apply()
        else:
            break
    return (values[0], names) if values else None


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **dict.fromkeys(TAGS)}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch, raw, off in slices(batches):
        low = LOWER[raw]
        starts, ends, first = word_spans(low, off, NON_WORD)
        text, at, _ = joined(low, starts, ends)
        text = " " + text.tobytes().decode("latin-1")  # a character for each byte
        bounds = np.append(at, len(text) - 1)[first].tolist()
        n = batch.num_rows
        n_base, head, tail = [0] * n, [None] * n, [None] * n
        base, own, score = [set() for _ in range(n)], [set() for _ in range(n)], [0.0] * n
        for row in range(n):
            a, b = bounds[row], bounds[row + 1]
            if b - a < 6:
                continue
            stated: list[float] = []
            for end, phrase in automaton.iter(text, a, b + 1):
                word = int(np.searchsorted(at, end - len(phrase) - 1, "right")) - 1
                if word < first[row]:
                    continue
                if phrase in BASE:
                    base[row].add(BASE[phrase])
                    n_base[row] += 1
                    place = word - int(first[row])
                    head[row] = place if head[row] is None else min(head[row], place)
                    tail[row] = place if tail[row] is None else max(tail[row], place)
                elif phrase in NOTICES:
                    own[row].add(NOTICES[phrase])
                else:
                    since = int(ends[word + phrase.count(" ")])
                    line = raw[since : int(off[row + 1])].tobytes().split(b"\n", 1)[0].decode("utf-8", "replace")
                    if got := evaluated(line.lstrip(" :\t*#\"'")):
                        stated.append(got[0])
                        own[row].update(got[1])
            if stated or base[row] or own[row]:
                # All that is stated holds together; a general name yields to a precise one.
                precise = [x for x in own[row]]
                general = [x for x in base[row] if not any(p.startswith(x) for p in precise)]
                score[row] = min(stated) if stated else min(map(freedom, precise + general))
        labels = [",".join(sorted(b | o)) for b, o in zip(base, own, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(n_base, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scanned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence phrases, labels and freedom score of every document.

    score is the freedom of the licences found (0 if there is none): that of
    the stated expressions, or else of the notices, the least free if several.
    Null and empty texts have no words and no labels; a very long text is
    scanned whole, as a slice of its own.  Repeated rows stay, a null doc_id
    passes through, other columns are ignored, an empty table gives an empty
    result.
    """
    narrow = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return narrow.mapInArrow(_scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

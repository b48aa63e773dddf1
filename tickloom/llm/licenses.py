"""License scans with a generalised suffix automaton over the words of license templates.

The automaton is built once from the templates (a fixed, small list) and shipped with the task. Every document is
streamed through it word by word, which gives the matching statistics: the length of the longest template passage that
ends at each word. Maximal matches of a minimum length are chained, in template order, into covered spans: for each template
the chains that cover most of it, by dynamic programming, so a match that fits no chain (words repeated or moved) is left out
of it instead of ending it. Of spans over the same words the one with the better covered template stands: names of licenses
often hold those of others. Spans of one template don't overlap.

Defined cases: a null text is the empty text (no words, no labels, score 0); repeated rows, null ids and extra columns
pass through; any length of text takes memory for its words only.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, small_batches

#: Base phrases and the labels that stand for them.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Template passages of common licenses, lower-cased words, and their labels.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2 1",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ],
    "boost": [
        "distributed under the boost software license version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "ofl": ["this font software is licensed under the sil open font license version 1 1"],
    "wtfpl": ["do what the fuck you want to public license"],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd": ["licensed under cc by nd 4 0", "licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc-by-nc-sa": ["licensed under cc by nc sa 4 0", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "cc-by-nc-nd": ["licensed under cc by nc nd 4 0", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related rights"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
    ],
    "proprietary": ["all rights reserved"],
}

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: ASCII upper to lower case, and every byte that is no part of a word to a space.
_TO_WORDS = bytes(b if (b := ASCII_LOWER[i]) in _WORD_BYTES else 0x20 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8").translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers.

    States are flat lists: ``step`` (word -> state), ``link``, ``length`` and ``ends``, all places (template, end) where the
    state's passages end. Templates are added one after another, each from the root.
    """

    def __init__(self, templates: list[tuple[str, list[bytes]]]) -> None:
        self.templates = templates
        self.words = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in t}))}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefixes = []
        for number, (_, template) in enumerate(templates):
            last = 0
            for end, w in enumerate(template):
                last = self._extend(last, self.words[w])
                prefixes.append((last, (number, end)))
        own: list[set[tuple[int, int]]] = [set() for _ in self.step]
        for state, place in prefixes:
            own[state].add(place)
        for state in sorted(range(1, len(own)), key=lambda k: -self.length[k]):
            own[self.link[state]] |= own[state]
        self.ends = [sorted(places) for places in own]

    def _new(self, step: dict[int, int], link: int, length: int) -> int:
        for column, value in ((self.step, step), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.step) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """A copy of state ``to`` for the passages up to one word longer than those of ``at``."""
        copy = self._new(dict(self.step[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (to := self.step[last].get(word)) is not None:  # another template holds this passage
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new, at = self._new({}, 0, self.length[last] + 1), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.step[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def maximal_matches(self, words: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) where a longest match of ``least`` words or more can't go on to the next word."""
        step, link, lengths = self.step, self.link, self.length
        out, state, n = [], 0, 0
        numbers = map(self.words.get, words)
        for i, w in enumerate(numbers):
            if w is None:
                if n >= least:
                    out.append((i - 1, n, state))
                state = n = 0
                continue
            to = step[state].get(w)
            if to is None:
                if n >= least:
                    out.append((i - 1, n, state))
                while to is None and state:
                    state = link[state]
                    to = step[state].get(w)
                n = lengths[state] if to is not None else 0
            if to is None:
                state = n = 0
            else:
                state, n = to, n + 1
        if n >= least:
            out.append((len(words) - 1, n, state))
        return out

    def places(self, state: int, n: int) -> list[tuple[int, int]]:
        """All (template, first word) of the state's passage of ``n`` words."""
        return [(t, end - n + 1) for t, end in self.ends[state]]


class Scanner:
    """Scores texts against the templates; ``least`` words make a match, a gap of up to ``gap`` words joins matches."""

    def __init__(self, least: int = 4, gap: int = 8, enough: float = 0.7) -> None:
        self.least, self.gap, self.enough = least, gap, enough
        self.base = [(tuple(p.encode().split()), label) for p, label in BASE_PHRASES.items()]
        own = [(label, t.encode().split()) for label, ts in TEMPLATES.items() for t in ts]
        self.automaton = SuffixAutomaton(own + [(label, list(p)) for p, label in self.base])
        self.own = len(own)
        self.shortest = min(least, *(len(t) for _, t in own))

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        starts, labels = [], set()
        matches = self.automaton.maximal_matches(words, 2)
        for end, n, _ in matches:
            passage = words[end - n + 1 : end + 1]
            for phrase, label in self.base:
                k = len(phrase)
                for i in range(n - k + 1):
                    if tuple(passage[i : i + k]) == phrase:
                        starts.append(end - n + 1 + i)
                        labels.add(label)
        starts = sorted(set(starts))  # overlapping matches may both hold a phrase
        spans = self._chains([m for m in matches if m[1] >= self.shortest])
        best = max((s[3] for s in spans), default=0.0)
        found = {s[0] for s in spans if s[3] >= self.enough}
        return (
            len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(labels)),
            ",".join(sorted(labels | found)), max(best, 1.0 if starts else 0.0), [s for s in spans if s[3] >= self.enough],
        )

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered) of the chains of each template."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in matches:
            for t, at in self.automaton.places(state, n):
                if t < self.own and (n >= self.least or n == len(self.automaton.templates[t][1])):
                    by_template.setdefault(t, []).append((end + 1, at + n, n))
        out = []
        for t, hits in by_template.items():
            label, template = self.automaton.templates[t]
            out += [(label, first, stop - 1, covered / len(template), covered) for first, stop, covered in chains(hits, self.gap)]
        return [s[:4] for s in strongest(sorted(out, key=lambda s: (s[1], s[2], s[0])))]


def best_chains(hits: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int]]:
    """For each hit (end in the text, end in the template, words), by ends: words covered and first word of the chain that
    ends with it and covers most; of equals the one that begins last.

    A hit follows one that ends before it both ways, at most ``gap`` words away in the text; words they share count once.
    Only hits that end within a template's length and a gap of each other are looked at, so long texts take time by length.
    """
    best: list[tuple[int, int]] = []
    for i, (end, at, n) in enumerate(hits):
        most = (n, end - n)
        for k in range(i - 1, -1, -1):
            before, at_before, _ = hits[k]
            if before < end - n - gap:
                break
            new = min(n, end - before, at - at_before)
            if new > 0:
                most = max(most, (best[k][0] + new, best[k][1]))
        best.append(most)
    return best


def chains(hits: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first word, end, words covered) of the chains that cover most, none over another's words, until no hit is left
    beside them. Of equals the shorter and then the earlier comes first."""
    out, runs = [], [sorted(hits)]
    while runs:
        run = runs.pop()
        spans = sorted((-covered, end - first, first, end) for (covered, first), (end, _, _) in zip(best_chains(run, gap), run, strict=True))
        firsts, taken = [], []  # sorted alike
        for less, _, first, end in spans:
            k = bisect.bisect_left(firsts, first)
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or end <= taken[k][0]):
                firsts.insert(k, first)
                taken.insert(k, (first, end, -less))
        out += taken
        rest: dict[int, list[tuple[int, int, int]]] = {}
        for end, at, n in run:
            k = bisect.bisect_right(firsts, end - 1)
            if k == 0 or taken[k - 1][1] <= end - n:
                rest.setdefault(k, []).append((end, at, n))
        runs += rest.values()
    return out


def strongest(spans: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float, int]]:
    """The spans (sorted by first word) that no other label's span on most of their words beats: one with no smaller share
    of its template and no fewer words of it, and more of either. So a license isn't taken for one that differs in a word."""

    def beats(a: tuple, b: tuple) -> bool:
        shared = min(a[2], b[2]) - max(a[1], b[1]) + 1
        return a[0] != b[0] and 2 * shared > b[2] - b[1] + 1 and a[3:] != b[3:] and a[3] >= b[3] and a[4] >= b[4]

    beaten: set[int] = set()
    open_: list[int] = []
    for i, own in enumerate(spans):
        open_ = [k for k in open_ if spans[k][2] >= own[1]]
        beaten.update(k for k in open_ if beats(own, spans[k]))
        if any(beats(spans[k], own) for k in open_):
            beaten.add(i)
        open_.append(i)
    return [s for i, s in enumerate(spans) if i not in beaten]


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("covered", T.DoubleType()),
    ]))),
])


def scan_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "license", least: int = 4, gap: int = 8, enough: float = 0.7) -> DataFrame:
    """``docs`` with a struct column: counts of words and base phrases, labels, score, and the covered template spans."""
    scanner = Scanner(least, gap, enough)
    names = [f.name for f in RESULT.fields]

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scanner.scan(t if isinstance(t, str) else None) for t in texts], columns=names)
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        out["score"] = out["score"].astype(np.float64)
        out["spans"] = [[dict(zip(("label", "first", "last", "covered"), s)) for s in spans] for spans in out["spans"]]
        return out

    return small_batches(docs).withColumn(out_col, scan(F.col(f"`{text_col}`")))

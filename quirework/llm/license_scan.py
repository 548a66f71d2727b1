"""License scans by patience alignment.

A text is scanned for each template: words of the template that few other templates have propose where it may begin,
and the words around such a place are aligned to the template. The alignment anchors on words that are unique in both,
keeps the longest increasing subsequence of them, and aligns the gaps between anchors in the same way; where a gap has
no unique word in common, its equal words at both ends are taken. Coverage is the share of the template's words aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

#: Fixed texts: public licence notices, in short and long forms.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}
COVERAGE = 0.8
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
RESULT = "doc_id long, license string, start long, end long, matched int, template_words int, coverage double"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = at[pile - 1] if pile else -1
        tops[pile : pile + 1], at[pile : pile + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (text index, template index) of aligned equal words, increasing in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        unique = [(j, where[w]) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in where]
        chain = [unique[i] for i in longest_increasing([i for _, i in unique])]
        if not chain:
            continue
        pairs += [(i, j) for j, i in chain]
        ends = [(c - 1, a - 1), *chain, (d, b)]
        gaps += [(i + 1, k, j + 1, m) for (j, i), (m, k) in zip(ends, ends[1:])]
    return sorted(pairs)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.words = {name: words_of(t) for name, t in sorted(templates.items())}
        shared = Counter(w for t in self.words.values() for w in set(t))
        self.keys: dict[str, list[tuple[str, int]]] = {}
        self.need: dict[str, int] = {}
        for name, t in self.words.items():
            # a text with fewer different words of the template than this can't reach the coverage
            counts = sorted(Counter(t).values(), reverse=True)
            most = int((1 - coverage) * len(t) + 1e-9)
            # any choice of words that leaves out at most ``most`` occurrences keeps one of these
            rare, left = sorted(set(t), key=lambda w: (shared[w], -len(w), w)), 0
            for w in rare:
                if left > most:
                    break
                left += t.count(w)
                for i, x in enumerate(t):
                    if x == w:
                        self.keys.setdefault(w, []).append((name, i))
            self.need[name] = len(t) - most
        self.vocabulary = frozenset(self.keys)
        self.own, self.counts = {name: frozenset(t) for name, t in self.words.items()}, {name: Counter(t) for name, t in self.words.items()}

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(template, first word, end word, words matched), without overlap within a template."""
        words = words_of(text)
        hits = self.vocabulary.intersection(words)
        if not hits:
            return []
        names = sorted({name for w in hits for name, _ in self.keys[w]})
        # places of each template's words
        places = {name: [i for i, w in enumerate(words) if w in self.own[name]] for name in names}
        begins: dict[str, Counter] = {}
        for i, w in enumerate(words):
            if w in hits:
                for name, j in self.keys[w]:
                    begins.setdefault(name, Counter())[i - j] += 1
        out = []
        for name in names:
            at = places[name]
            if len(at) < self.need[name]:
                continue
            found = self._around(words, name, begins[name], at)
            out += [(name, *x) for x in found]
            # what was interrupted by foreign words, closed up: the template's own words only
            for cut in self._free(at, [x[:2] for x in found]):
                if len(cut) >= self.need[name]:
                    some = [words[i] for i in cut]
                    votes = Counter(i - j for i, w in enumerate(some) if w in hits for other, j in self.keys[w] if other == name)
                    out += [(name, cut[first], cut[last - 1] + 1, n) for first, last, n in self._around(some, name, votes, None)]
        return sorted(out, key=lambda x: (x[1], x[0]))

    @staticmethod
    def _free(at: list[int], spans: list[tuple[int, int]]) -> list[list[int]]:
        """Positions outside spans, apart where a span lies between them."""
        out, last = [], 0
        for i, j in sorted(spans):
            out.append(at[last : bisect_left(at, i)])
            last = bisect_left(at, j)
        return [x for x in [*out, at[last:]] if x]

    def _around(self, words: list[str], name: str, votes: Counter, at: list[int] | None) -> list[tuple[int, int, int]]:
        """What aligns around the places that ``votes`` propose, best first; ``at``: the places of the template's words
        (None: all words are of the template). A place is aligned only if the words around it that no better place has
        taken hold enough words of the template, and a span that is tried again with the same ends is not."""
        t, need, out = self.words[name], self.need[name], []
        slack = max(2, len(t) // 4)
        starts, ends, tried = [], [], set()  # of the spans taken, in order
        for begin, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            a, b = max(0, begin - slack), min(len(words), begin + len(t) + slack)
            k = bisect_right(starts, max(begin, 0))
            if k:
                a = max(a, ends[k - 1])
            if k < len(starts):
                b = min(b, starts[k])
            if b - a < need or (at is not None and bisect_left(at, b) - bisect_left(at, a) < need) or (a, b) in tried:
                continue
            tried.add((a, b))
            if (Counter(words[a:b]) & self.counts[name]).total() < need:
                continue
            part = patience(words[a:b], t)
            if len(part) >= need:
                first, last = a + part[0][0], a + part[-1][0] + 1
                k = bisect_left(starts, first)
                starts.insert(k, first)
                ends.insert(k, last)
                out.append((first, last, len(part)))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each place where a document covers ``coverage`` of a template: doc_id, license (the template's name),
    start and end (words of the text, end excluded), matched, template_words, coverage.

    Words are runs of letters a-z and digits, lower-cased, with inner dots and hyphens. Texts are read whole; null and
    empty ones, and such without a template, have no row. A template that occurs several times has a row for each
    place. Words that a template doesn't have may stand between its words, however many; of words that it has, about a
    quarter of its length (two at least) may be inserted before a lower coverage is found. Repeated rows are scanned each. Other columns are not read, and an empty table gives no rows. Nothing is
    shuffled; memory is bounded by a text."""
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for name, a, e, n in scanner.scan(text.as_py() or ""):
                    whole = len(scanner.words[name])
                    for c, v in zip(cols, (doc, name, a, e, n, whole, n / whole)):
                        c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "start", "end", "matched", "template_words", "coverage"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

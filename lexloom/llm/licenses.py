"""License scans by patience alignment with templates.

Words that occur once in the text and once in the template are anchors; the longest increasing subsequence of their
places (by patience sorting) is kept, and the gaps between the kept anchors are aligned in the same way, where more
words are unique; a gap without such words, as between repeated notices, is aligned by all pairs of equal words. A
template's coverage is the share of its words that are aligned within a stretch of text of at most SPREAD times its
length. Each template word of the text may begin a stretch; of equal coverage the tightest place, then the first, counts.

Only stretches that can reach `min_coverage` are aligned: a text must hold enough of a template's words at all, and
every match that good holds one of the template's `allowed misses + 1` words that are rarest in the text, so the
surroundings of those words' occurrences are all there is to look at; and a stretch must itself hold enough of the
template's words. Nothing is left out by this.

Defined results: null and empty texts have no words and no license; of licenses of equal coverage the longer
template, then the first by name, is reported; repeated rows each get their row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import NOT_ALNUM, Words, as_bytes, batch, chunks, ship

MIN_COVERAGE, SPREAD = 0.8, 2

# Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting with back pointers."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(values)
    for i, x in enumerate(values):
        pile = bisect_left(tops, x)
        back[i] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(x)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = x, i
    out, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def common(a: list[int], b: list[int], i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a[i:j] and b[k:m]: patience sorting of all pairs of equal words."""
    at_b: dict[int, list[int]] = {}
    for q in range(m - 1, k - 1, -1):
        at_b.setdefault(b[q], []).append(q)
    pairs = [(p, q) for p in range(i, j) for q in at_b.get(a[p], ())]
    return [pairs[x] for x in longest_increasing([q for _, q in pairs])]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal words, increasing in both; gaps are worked off a stack, not by recursion."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        at_b = {x: p for p, x in enumerate(b[k:m], k) if in_b[x] == 1}
        anchors = [(p, at_b[x]) for p, x in enumerate(a[i:j], i) if in_a[x] == 1 and x in at_b]
        kept = [anchors[x] for x in longest_increasing([q for _, q in anchors])] or common(a, b, i, j, k, m)
        if not kept:
            continue
        out += kept
        edges = [(i - 1, k - 1), *kept, (j, m)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if r > p + 1 and s > q + 1]
    return sorted(out)


def best_stretch(t: list[int], need: list[int], p: list[int], w: list[int], reach: int, least: float) -> tuple[int, int, int]:
    """(aligned, first, last) of the best stretch of less than `reach` words, given the places and ids of template words."""
    have, bound, e, best = Counter(), 0, 0, (0, 0, 0)
    for s, place in enumerate(p):
        while e < len(p) and p[e] < place + reach:
            bound += have[w[e]] < need[w[e]]
            have[w[e]] += 1
            e += 1
        tight = best[2] - best[1] + 1 == best[0]
        if bound >= least and (bound > best[0] or bound == best[0] and not tight):
            pairs = align(t, w[s:e])
            if len(pairs) < bound:
                pairs = max(pairs, common(t, w[s:e], 0, len(t), 0, e - s), key=len)
            found = (len(pairs), p[s + pairs[0][1]], p[s + pairs[-1][1]]) if pairs else best
            best = max(best, found, key=lambda x: (x[0], x[1] - x[2]))
        have[w[s]] -= 1
        bound -= have[w[s]] < need[w[s]]
    return best


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        words = {name: Words([t.encode()], NOT_ALNUM, lower=True).hash for name, t in templates.items()}
        self.vocabulary = np.unique(np.concatenate(list(words.values())))
        self.templates = {name: np.searchsorted(self.vocabulary, w).tolist() for name, w in sorted(words.items()) if len(w)}
        self.need = {name: np.bincount(t, minlength=len(self.vocabulary)) for name, t in self.templates.items()}
        self.min_coverage = min_coverage

    def scan(self, places: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of one text, given where template words occur in it."""
        out = []
        for name, t in self.templates.items():
            if np.minimum(counts, self.need[name]).sum() < self.min_coverage * len(t):
                continue
            present = sorted((x for x in t if counts[x]), key=lambda x: (counts[x], x))
            misses = len(t) - int(np.ceil(self.min_coverage * len(t)))
            seeds = np.unique(present[: misses + 1])
            reach, own = SPREAD * len(t), np.isin(terms, t)
            p, w = places[own], terms[own]
            spots = p[np.isin(w, seeds)]
            cuts = np.flatnonzero(np.diff(spots) > 2 * reach) + 1
            best, need = (0, 0, 0), self.need[name].tolist()
            for group in np.split(spots, cuts):
                lo, hi = np.searchsorted(p, group[0] - reach), np.searchsorted(p, group[-1] + reach, side="right")
                found = best_stretch(t, need, p[lo:hi].tolist(), w[lo:hi].tolist(), reach, self.min_coverage * len(t))
                best = max(best, found, key=lambda x: (x[0], x[1] - x[2]))
            if best[0] >= self.min_coverage * len(t):
                out.append((name, best[0] / len(t), best[1], best[2]))
        return sorted(out, key=lambda x: (-x[1], -len(self.templates[x[0]]), x[0]))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("licenses", pa.list_(pa.string()))])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The best license of each document with its coverage and place, and all licenses that reach min_coverage."""
    ship(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, min_coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = scanner.vocabulary
        for ids, texts in chunks(batches):
            w = Words(texts, NOT_ALNUM, lower=True)
            at = np.searchsorted(v, w.hash)
            at[at == len(v)] = 0
            hit = np.flatnonzero(v[at] == w.hash)
            term = at[hit]
            cut = np.searchsorted(hit, w.first)
            out = []
            for i, doc in enumerate(ids):
                own = slice(cut[i], cut[i + 1])
                found = scanner.scan(hit[own] - w.first[i], term[own], np.bincount(term[own], minlength=len(v)))
                name, share, lo, hi = found[0] if found else (None, 0.0, None, None)
                out.append((doc, int(w.first[i + 1] - w.first[i]), name, round(share, 6), lo, hi, [f[0] for f in found]))
            yield batch(_SCHEMA, *(zip(*out, strict=True) if out else [[]] * len(_SCHEMA)))

    return as_bytes(docs).mapInArrow(run, "doc_id long, n_words long, license string, coverage double, first_word long, last_word long, licenses array<string>")

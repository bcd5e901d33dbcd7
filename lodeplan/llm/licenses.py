"""License scans by patience alignment (operator 6).

A text is compared with each template word by word.  Words that occur once in the text's region and
once in the template are anchors; the longest increasing subsequence of their places fixes which of
them are in order, and the gaps between anchors are aligned in the same way again.  The share of the
template's words that the alignment matches is its coverage; regions of at least ``coverage`` are
reported with their place.

A region is worth aligning only if its words can reach that coverage at all, so three exact bounds come
first: the set of words that the document shares with the template, the multiset of those within any
stretch as long as a match may be (STRETCH times the template and SLACK words), and the longest common
subsequence of such a stretch and the template, by bit vectors.  Every stretch that passes is aligned by
itself, on the shortest part of it that has the subsequence; when a region is taken, what stretches over
its edge is judged again by what lies before and after it.  Documents are neither shuffled nor cut.

Edge cases: null, empty and wordless texts have no licenses; texts of any length are scanned whole;
one template may occur several times and each region is reported; of regions that overlap, the one with
more matched words stays (ties: the template that comes first in the list); repeated rows and null ids
are rows like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

COVERAGE, STRETCH, SLACK = 0.8, 1.5, 8

# The wording of the licenses and notices looked for.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both; words below 0 match nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k] >= 0:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1] >= 0:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        once = {w for w, n in in_b.items() if n == 1 and in_a.get(w) == 1 and w >= 0}
        if once:
            at_b = {b[q]: q for q in range(k, m) if b[q] in once}
            anchors = _rising([(p, at_b[a[p]]) for p in range(i, j) if a[p] in once])
        else:
            both = [(in_a[w] * n, w) for w, n in in_b.items() if w >= 0 and in_a.get(w)]
            if not both:
                continue
            if (j - i) * (m - k) <= 20_000:
                out += _longest(a, b, i, j, k, m)
                continue
            # nothing is unique: the rarest shared word, where it first occurs in both
            word = min(both)[1]
            anchors = [(a.index(word, i, j), b.index(word, k, m))]
        out += anchors
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if p + 1 < q and r + 1 < s]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first) that rises in the second: patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            ends.append(n)
        else:
            tops[pile], ends[pile] = y, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _longest(a: list[int], b: list[int], i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a small gap by the plain table."""
    rows, cols = j - i, m - k
    best = [[0] * (cols + 1) for _ in range(rows + 1)]
    for p in range(rows - 1, -1, -1):
        for q in range(cols - 1, -1, -1):
            best[p][q] = best[p + 1][q + 1] + 1 if a[i + p] == b[k + q] >= 0 else max(best[p + 1][q], best[p][q + 1])
    out, p, q = [], 0, 0
    while p < rows and q < cols:
        if a[i + p] == b[k + q] >= 0 and best[p][q] == best[p + 1][q + 1] + 1:
            out.append((i + p, k + q))
            p, q = p + 1, q + 1
        elif best[p + 1][q] >= best[p][q + 1]:
            p += 1
        else:
            q += 1
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = list(templates)
        words = common.Words(*common.buffers(pa.array(list(templates.values()), pa.string())), common.ALNUM)
        self.vocabulary = np.unique(words.hashes)
        ids = np.searchsorted(self.vocabulary, words.hashes)
        self.templates = [ids[words.first[t] : words.first[t + 1]].tolist() for t in range(len(self.names))]
        self.need = [max(1, int(np.ceil(coverage * len(t) - 1e-9))) for t in self.templates]
        self.counts = np.zeros((len(self.vocabulary), len(self.names)), np.int32)
        for t, own in enumerate(self.templates):
            np.add.at(self.counts[:, t], own, 1)
        # where in the template each word is, as bits, from either end
        self.masks = [tuple({w: sum(1 << k for k, v in enumerate(way) if v == w) for w in set(way)} for way in (x, x[::-1])) for x in self.templates]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[str, float, int, int, int, int]]]]:
        """For each text the number of words and (name, coverage, start, end, first character, last character + 1)."""
        words = common.Words(data, offsets, common.ALNUM)
        at = np.flatnonzero(self.bits[(words.hashes >> np.uint64(48)).astype(np.int64)])
        where = np.searchsorted(self.vocabulary, words.hashes[at]).clip(max=len(self.vocabulary) - 1)
        sure = self.vocabulary[where] == words.hashes[at]
        at, ids = at[sure], where[sure]
        first = np.searchsorted(at, words.first)
        n = len(offsets) - 1
        present = np.zeros((n, len(self.vocabulary)), np.float32)
        present[np.repeat(np.arange(n), np.diff(first)), ids] = 1
        bound = present @ self.counts.astype(np.float32)  # no text can match more of a template than this
        for row in range(n):
            known = slice(first[row], first[row + 1])
            kept = self._regions(np.flatnonzero(bound[row] >= self.need), at[known] - words.first[row], ids[known])
            out = []
            for t, matched, a, b in sorted(kept, key=lambda h: (h[2], h[0])):
                x, y = words.starts[words.first[row] + a], words.ends[words.first[row] + b - 1]
                out.append((self.names[t], matched / len(self.templates[t]), a, b, *(int(np.count_nonzero(data[offsets[row] : z] & 0xC0 != 0x80)) for z in (x, y))))
            yield int(words.first[row + 1] - words.first[row]), out

    def _regions(self, templates: np.ndarray, places: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, matched words, start, end) of regions that don't overlap, given the places and ids of one text's known words."""
        own = {t: self._windows(t, places, ids) for t in templates.tolist()}
        seen: dict[tuple[int, int, int], tuple[int, int, int] | None] = {}
        todo: list[tuple[int, int, int, int, int, int]] = []

        def propose(t: int, k: int, stop: int) -> None:
            mine, which, _ = own[t]
            if (t, k, stop) not in seen:
                seen[t, k, stop] = self._best(t, which[k:stop])
            if hit := seen[t, k, stop]:
                matched, i, j = hit
                x, y = int(mine[k + i]), int(mine[k + j - 1]) + 1
                heappush(todo, (-matched, t, y - x, x, k, stop))

        for t, (_, _, dense) in own.items():
            for k, stop in dense:
                propose(t, k, stop)
        kept: list[tuple[int, int, int, int]] = []
        taken: list[tuple[int, int]] = []
        while todo:
            less, t, span, x, k, stop = heappop(todo)
            mine = own[t][0]
            n = bisect_left(taken, (x + span, 0))
            if n == 0 or taken[n - 1][1] <= x:
                kept.append((t, -less, x, x + span))
                taken.insert(n, (x, x + span))
                continue
            # what the window has before the first region taken within it, and after
            n = bisect_left(taken, (int(mine[k]) + 1, 0))
            begin = k if n == 0 or taken[n - 1][1] <= mine[k] else bisect_left(mine, taken[n - 1][1], k, stop)
            for start, end in [*taken[n:], (int(mine[stop - 1]) + 1, 0)]:
                edge = bisect_left(mine, start, begin, stop)
                if edge - begin >= self.need[t] and (begin, edge) != (k, stop):
                    propose(t, begin, edge)
                if start > mine[stop - 1]:
                    break
                begin = bisect_left(mine, end, begin, stop)
        return kept

    def _windows(self, t: int, places: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """Places and ids of the text's words that the template has, and the stretches of admissible width from each of
        them on that have enough of them, each word counted as often as the template has it."""
        mine = self.counts[ids, t] > 0
        places, ids = places[mine], ids[mine]
        ends = np.searchsorted(places, places + int(STRETCH * len(self.templates[t])) + SLACK)
        out: list[tuple[int, int]] = []
        which, limit, need = ids.tolist(), self.counts[:, t].tolist(), self.need[t]
        if (ends - np.arange(len(places)) >= need).any():
            inside: dict[int, int] = {}
            useful = stop = 0
            for k, end in enumerate(ends.tolist()):
                for w in which[stop:end]:
                    inside[w] = inside.get(w, 0) + 1
                    useful += inside[w] <= limit[w]
                stop = end
                if useful >= need:
                    out.append((k, end))
                w = which[k]
                useful -= inside[w] <= limit[w]
                inside[w] -= 1
        return places.tolist(), which, out

    def _best(self, t: int, window: list[int]) -> tuple[int, int, int] | None:
        """The words that an alignment matches and the shortest stretch of the window that has as many in order as any, if
        they are enough.  Where patience alone matches too few, the longest common subsequence counts."""
        matched, stop = _common(window, self.masks[t][0], len(self.templates[t]))
        if matched < self.need[t]:
            return None
        _, back = _common(window[:stop][::-1], self.masks[t][1], len(self.templates[t]))
        aligned = len(align(window[stop - back : stop], self.templates[t]))
        return aligned if aligned >= self.need[t] else matched, stop - back, stop


def _common(window: list[int], masks: dict[int, int], size: int) -> tuple[int, int]:
    """Length of the longest common subsequence with a template of size words, and the shortest prefix of the window
    that has it; by bit vectors (Hyyro)."""
    full = (1 << size) - 1
    rest, best, stop = full, 0, 0
    for n, w in enumerate(window):
        use = rest & masks[w]
        rest = (rest + use | rest - use) & full
        if size - rest.bit_count() > best:
            best, stop = size - rest.bit_count(), n + 1
    return best, stop


_scanners: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row: key, n_words, n_licenses, best_license, best_coverage, and every region with its words and characters."""
    common.small_batches(docs.sparkSession)
    templates = templates or TEMPLATES
    kind = docs.schema[key].dataType.simpleString()
    region = pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            rows = [r for i, j in common.chunks(offsets) for r in scanner.chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            best = [max(found, key=lambda f: (f[1], f[3] - f[2], -f[2]), default=None) for _, found in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()),
                pa.array([b and b[0] for b in best], pa.string()), pa.array([b[1] if b else 0.0 for b in best], pa.float64()),
                pa.array([[dict(zip(("name", "coverage", "start", "end", "char_start", "char_end"), x)) for x in f] for _, f in rows], pa.list_(region)),
            ], [key, "n_words", "n_licenses", "best_license", "best_coverage", "licenses"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_licenses bigint, best_license string, best_coverage double, licenses array<struct<name: string, coverage: double, start: bigint, end: bigint, char_start: bigint, char_end: bigint>>")

"""License scans by patience alignment of texts with license templates.

Words that occur once in a text and once in a template are anchors; the longest increasing
subsequence of them is kept, equal words next to anchors extend them, and the gaps between
anchors are aligned the same way.  A template's coverage is the share of its words aligned
within a stretch of text not much longer than the template.  Where a notice stands more than
once, or not whole, anchors may be missing or lie across copies; such stretches are searched
window by window for the longest common subsequence, which is exact; so are gaps that hold
no word unique on both sides.

Templates that have most words in common are variants of each other.  Where variants fit one
stretch of text, only the one that fits it best is reported, and none if two fit it alike.
The words that name a license, its version and its restrictions must stand in the stretch as
they are, so a notice of a license that is not in the set is not taken for a similar one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices, headers and grants of common licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Words in a row that name a template's license and must stand in the text aligned with it.
IDENTIFYING = {
    "MIT": ["mit"],
    "Apache-2.0": ["apache", "2.0"],
    "Apache-2.0-header": ["apache", "2.0"],
    "GPL-3.0": ["gnu general public license", "version 3"],
    "CC-BY-4.0": ["cc by 4.0"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0"],
    "GPL-3.0-header": ["gnu general public license", "version 3"],
    "GPL-2.0-header": ["gnu general public license", "version 2"],
    "LGPL-3.0-header": ["gnu lesser general public license", "version 3"],
    "AGPL-3.0-header": ["gnu affero general public license", "version 3"],
    "MPL-2.0": ["mozilla public license", "v 2.0"],
}

#: A word: letters and digits, also joined by dots or hyphens.
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
COVERAGE, STRETCH, SPARE = 0.8, 1.5, 4
#: Alignments nested in each other at most; a gap further in is aligned as one without anchors.
DEPTH = 64


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places in the text."""
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, given in order of the first, that also rises in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words in ``a`` and ``b``, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), DEPTH)]
    while todo:
        a0, a1, b0, b1, depth = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {b[j]: j for j in range(b0, b1) if times_b[b[j]] == 1 and times_a.get(b[j]) == 1}
        anchors = _increasing([(i, once[a[i]]) for i in range(a0, a1) if a[i] in once]) if depth else []
        i0, j0 = a0, b0
        for i, j in anchors:
            todo.append((i0, i, j0, j, depth - 1))
            found.append((i, j))
            i0, j0 = i + 1, j + 1
        if anchors:
            todo.append((i0, a1, j0, b1, depth - 1))
        elif times_a.keys() & times_b.keys():
            found += [(a0 + i, b0 + j) for i, j in subsequence(a[a0:a1], b[b0:b1])]
    return sorted(found)


def subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; a row of bits for each word of ``a``."""
    masks = _masks(b)
    row = full = (1 << len(b)) - 1
    rows = [row]
    for w in a:
        u = row & masks.get(w, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    # a bit is missing where the row's length grows; the last place that has it holds a pair
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
            continue
        low = (1 << j) - 1
        if (rows[i - 1] & low).bit_count() == (rows[i] & low).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def places(text: list[str], template: list[str], rare: set[str]) -> list[tuple[int, int]]:
    """Stretches of the text around each occurrence of one of the template's rare words."""
    reach = math.ceil(STRETCH * len(template)) + SPARE
    out: list[tuple[int, int]] = []
    for i, w in enumerate(text):
        if w in rare:
            begin, end = max(0, i - reach), min(len(text), i + reach)
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((begin, end))
    return out


def _densest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The most pairs within a stretch of text about as long as the template."""
    reach, best, i = math.ceil(STRETCH * n) + SPARE, (0, 0), 0
    for j in range(len(pairs)):
        while pairs[j][0] - pairs[i][0] > reach:
            i += 1
        if j + 1 - i > best[1] - best[0]:
            best = (i, j + 1)
    return pairs[best[0] : best[1]]


def _common(words: list[str], masks: dict[str, int]) -> list[int]:
    """The longest common subsequence with the template, in length, after each word."""
    row = full = (1 << (masks[""])) - 1
    out, n = [], 0
    for w in words:
        u = row & masks.get(w, 0)
        if u:
            new = ((row + u) | (row - u)) & full
            n += new.bit_count() < row.bit_count()
            row = new
        out.append(n)
    return out


def _masks(template: list[str]) -> dict[str, int]:
    """The places of each word as bits; the number of words under the empty word."""
    out = {"": len(template)}
    for j, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << j
    return out


def best_window(text: list[str], template: list[str], least: int) -> tuple[int, int, int] | None:
    """``(n, begin, end)``: the first shortest stretch with the most words in common, ``least`` at least."""
    n, reach = len(template), math.ceil(STRETCH * len(template)) + SPARE
    masks, back, most = _masks(template), _masks(template[::-1]), Counter(template)
    first: dict[str, int] = {}
    for j, w in enumerate(template):
        first.setdefault(w, j)
    have: Counter[str] = Counter()
    bound, end, best = 0, 0, None
    for i, w in enumerate(text):
        while end < min(len(text), i + reach + 1):
            x = text[end]
            have[x] += 1
            bound += have[x] <= most[x]
            end += 1
        # the window has words enough, and so has the template from its first word on
        if bound >= least and n - first.get(w, n) >= least:
            got = _common(text[i:end], masks)
            if got[-1] >= least:
                stop = i + bisect_left(got, got[-1]) + 1
                size = bisect_left(_common(text[i:stop][::-1], back), got[-1]) + 1
                best, least = (got[-1], stop - size, stop), got[-1] + 1
                if got[-1] == n:
                    break
        bound -= have[w] <= most[w]
        have[w] -= 1
    return best


def aligned(text: list[str], template: list[str], least: int) -> tuple[int, int, int] | None:
    """``(n, begin, end)``: the alignment's densest stretch, cut to the words that hold its pairs.

    Copies in a row share words, which leaves the alignment few anchors; so a window takes its
    place where it holds more pairs, or as many and ends earlier.  What windows can hold is
    bounded by the words that they have in common with the template, so where the alignment
    is as good as that, none is looked at.
    """
    pairs = _densest(align(text, template), len(template))
    n, hit = len(pairs), None
    if n >= least:
        masks, back = _masks(template), _masks(template[::-1])
        begin, end = pairs[0][0], pairs[-1][0] + 1
        end = begin + bisect_left(_common(text[begin:end], masks), n) + 1
        begin = end - bisect_left(_common(text[begin:end][::-1], back), n) - 1
        hit = best_window(text[: end - 1], template, n) or (n, begin, end)
    more = max(least, n + 1)
    return (best_window(text, template, more) if more <= len(template) else None) or hit


class Templates:
    """Templates with the rare words that any sufficient match must hold one of."""

    def __init__(self, templates: dict[str, str], coverage: float, identifying: dict[str, list[str]] | None = None):
        named = IDENTIFYING if identifying is None else identifying
        self.named = {k: [p.split() for p in named.get(k, [])] for k in templates}
        self.words = {k: [w for w, _, _ in words(t)] for k, t in templates.items()}
        self.words = {k: w for k, w in self.words.items() if w}
        self.coverage, self.rare = coverage, {}
        for k, w in self.words.items():
            # with these left out, too few words remain for the coverage
            spare = len(w) - math.ceil(coverage * len(w)) + 1
            self.rare[k] = set(sorted(w, key=lambda x: (-len(x), x))[:spare])
        self.variants: dict[str, list[str]] = {}
        for k, w in self.words.items():
            for other, v in self.words.items():
                if k != other and len(subsequence(w, v)) >= math.ceil(coverage * max(len(w), len(v))):
                    self.variants.setdefault(k, []).append(other)
        self.finder = ahocorasick.Automaton()
        by = defaultdict(list)
        for k, rare in self.rare.items():
            for w in rare:
                by[w].append(k)
        for w, ks in by.items():
            self.finder.add_word(w, ks)
        if by:
            self.finder.make_automaton()

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """``(template, coverage, aligned words, begin, end)`` of sufficient matches."""
        low = text.lower()
        maybe = {k for _, ks in self.finder.iter(low) for k in ks} if len(self.finder) else set()
        if not maybe:
            return []
        found = words(text)
        plain = [w for w, _, _ in found]
        fits = {k: self._fits(plain, k) for k in sorted(maybe)}
        out = []
        for k, hits in fits.items():
            own = len(self.words[k])
            for other in self.variants.get(k, ()):
                rivals, n = fits.get(other, []), len(self.words[other])
                hits = [h for h in hits if not any(r[1] < h[2] and h[1] < r[2] and (r[0] / n, r[0]) >= (h[0] / own, h[0]) for r in rivals)]
            if hits:
                best = max(hits, key=lambda h: (h[0], -h[1]))
                out.append((k, best[0] / own, best[0], found[best[1]][1], found[best[2] - 1][2]))
        return out

    def _names(self, stretch: list[str], k: str) -> bool:
        """Whether all words that name the template's license stand in the stretch, each phrase in a row."""
        return all(any(stretch[i : i + len(p)] == p for i in range(len(stretch) - len(p) + 1)) for p in self.named[k])

    def _fits(self, plain: list[str], k: str) -> list[tuple[int, int, int]]:
        """``(n, begin, end)`` of stretches aligned well enough: the best one, or all if there are variants."""
        template = self.words[k]
        least, times, out = max(1, math.ceil(self.coverage * len(template))), Counter(template), []
        todo = places(plain, template, self.rare[k])[::-1]
        while todo:
            begin, end = todo.pop()
            have = Counter(w for w in plain[begin:end] if w in times)
            if (have & times).total() < least:
                continue
            hit = aligned(plain[begin:end], template, least)
            if not hit or hit[0] < least:
                continue
            if not self._names(plain[begin + hit[1] : begin + hit[2]], k):
                todo += [(begin + hit[2], end), (begin, begin + hit[1])]  # another license's notice; one of this may stand beside it
                continue
            out.append((hit[0], begin + hit[1], begin + hit[2]))
            if k in self.variants:  # there may be others beside it that no variant fits better
                todo += [(begin + hit[2], end), (begin, begin + hit[1])]
            else:
                least = hit[0] + 1
        return out


SCHEMA = "license string, coverage double, n_words long, begin long, end long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, keep: list[str] | None = None, identifying: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each document and template aligned well enough: the best stretch of it.

    ``identifying`` has the phrases, in lower case, that each template's stretch must hold.
    ``begin`` and ``end`` are character places in the whole text.  Null and empty texts,
    and those without words, have no rows; repeated rows each get theirs; of equally good
    stretches the first counts; other columns are ignored; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    rest = [f for f in docs.schema if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [SCHEMA])
    given = dict(TEMPLATES if templates is None else templates)
    names = [f.name for f in rest] + [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        known = Templates(given, coverage, identifying)
        for b in batches:
            rows, of = [], []
            for k, value in enumerate(b.column(0)):
                hits = known.scan(value.as_py() or "")
                rows += hits
                of += [k] * len(hits)
            if rows:
                part = b.take(pa.array(of))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(1, b.num_columns)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("text").alias("__text"), *[F.col(f.name) for f in rest]).mapInArrow(run, schema)

"""License scan: winnowed fingerprints pick candidates, banded alignment reports what matches.

Templates and texts are reduced to lower-case letters and digits; hashes of all ``GRAM`` characters
in a row are winnowed (the smallest of every ``WINDOW`` neighbours is kept), so whatever text and
template share over ``GRAM + WINDOW - 1`` such characters has a fingerprint in common. An inverted
index of the templates' fingerprints turns a text's fingerprints into candidates: a template and
the place where it would start. Candidates that lie within a band of each other are one; each is
aligned word by word within the band, and reported with the share of the template's words that
match in order, and the span of the text from the first to the last of them.

The templates are a short list given by the caller (at most ``MOST_TEMPLATES`` words in all), so
their index goes to every task; texts are read in one pass and never shuffled.

Edge cases: null, empty and short texts have no match; every occurrence of a template is reported,
also in repeated rows; where matches of one template overlap, the better covered is kept, of
equal ones the first; a match inside a better covered one of another template is dropped; other
columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_of

GRAM, WINDOW, BAND, COVERAGE, MOST_TEMPLATES = 10, 6, 12, 0.8, 200_000
WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, license string, coverage double, start long, end long, matched_words long"

#: Short public notices and grants, by SPDX-like names.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def winnow(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the fingerprints of a row of characters."""
    n = len(chars) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x01000193) + chars[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    if n <= WINDOW:
        k = int(h.argmin())
        return h[k : k + 1], np.asarray([k])
    least = h[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        np.minimum(least, h[k : n - WINDOW + 1 + k], out=least)
    # a hash is kept where it is the least of some window that holds it
    kept = np.zeros(n, bool)
    for k in range(WINDOW):
        kept[k : k + len(least)] |= h[k : k + len(least)] == least
    at = np.flatnonzero(kept)
    return h[at], at


class Words:
    """A text's words, lower-cased, with their places in it and in the row of their characters."""

    def __init__(self, text: str):
        found = list(WORD.finditer(text))
        self.words = [m.group().lower() for m in found]
        self.spans = [m.span() for m in found]
        self.chars = np.frombuffer("".join(self.words).encode("utf-32-le", "replace"), "<u4")
        self.starts = np.cumsum([0, *map(len, self.words)])[:-1]  # in the row of characters


def align(template: list[str], words: list[str], first: int, band: int) -> tuple[int, int, int]:
    """Most words of the template that match in order, word k of it only at first + k +- band.

    Returns their number and the first and last place in ``words``. Of alignments with equally many
    matches the one that starts latest is taken, so its span is the tightest.
    """
    m, width = len(template), 2 * band + 1
    best = [(0, -1, -1)] * (width + 1)  # over places up to first + k - band + j, for the words so far
    for k in range(m):
        low = first + k - band
        row = []
        for j in range(width):
            # the band moves one place on with each word: the same place was j + 1 before
            place = low + j
            skip = best[j + 1] if j + 1 < len(best) else best[-1]  # template word left out
            value = max(skip, row[-1]) if row else skip  # text word left out
            if 0 <= place < len(words) and words[place] == template[k]:
                n, s, _ = best[j]
                hit = (n + 1, s if n else place, place)
                if (hit[0], hit[1], -hit[2]) > (value[0], value[1], -value[2]):
                    value = hit
            row.append(value)
        best = [*row, row[-1]]
    return best[-1]


def _holds(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, none of which holds another, holds [start, end)."""
    k = bisect.bisect_right(spans, (start, 1 << 62))
    return k > 0 and spans[k - 1][1] >= end


def _widen(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Adds a span to those of which none holds another."""
    if _holds(spans, start, end):
        return
    k = bisect.bisect_left(spans, (start, -1))
    while k < len(spans) and spans[k][1] <= end:
        del spans[k]
    spans.insert(k, (start, end))


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.templates = [Words(templates[n]) for n in self.names]
        if sum(len(t.words) for t in self.templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} words of templates")
        self.bands = [min(BAND, max(len(t.words) - 1, 0)) for t in self.templates]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for h, at in zip(*map(np.ndarray.tolist, winnow(t.chars))):
                self.index[h].append((k, at))
        self.known = np.asarray(sorted(self.index), np.uint32)

    def candidates(self, text: Words) -> set[tuple[int, int]]:
        """(template, word of the text at which it would start), near ones joined."""
        h, at = winnow(text.chars)
        hit = np.flatnonzero(np.isin(h, self.known))
        starts: dict[int, set[int]] = defaultdict(set)
        for x, place in zip(h[hit].tolist(), at[hit].tolist()):
            for k, own in self.index[x]:
                # the words that the fingerprint begins in, on either side
                w = int(np.searchsorted(text.starts, place, "right")) - 1
                v = int(np.searchsorted(self.templates[k].starts, own, "right")) - 1
                starts[k].add(w - v)
        out = set()
        for k, found in starts.items():
            last, near = None, self.bands[k] // 2
            for s in sorted(found):
                if last is None or s - last > near:
                    out.add((k, s))
                    last = s
        return out

    def scan(self, text: str, coverage: float) -> list[tuple[str, float, int, int, int]]:
        words = Words(text)
        matches = []
        for k, start in self.candidates(words):
            n, first, last = align(self.templates[k].words, words.words, start, self.bands[k])
            share = n / len(self.templates[k].words)
            if share >= coverage:
                matches.append((self.names[k], share, words.spans[first][0], words.spans[last][1], n))
        kept: list[tuple[str, float, int, int, int]] = []
        own: dict[str, list[tuple[int, int]]] = defaultdict(list)  # spans kept of each template: apart, in order
        inside: dict[float, list[tuple[int, int]]] = defaultdict(list)  # and by coverage
        for m in sorted(set(matches), key=lambda m: (-m[1], m[3] - m[2], m[2], m[0])):
            spans = own[m[0]]
            k = bisect.bisect_left(spans, (m[3],))  # those that begin before it ends; the last of them ends last
            if k and spans[k - 1][1] > m[2] or any(share > m[1] and _holds(s, m[2], m[3]) for share, s in inside.items()):
                continue
            kept.append(m)
            spans.insert(k, (m[2], m[3]))
            _widen(inside[m[1]], m[2], m[3])
        return sorted(kept, key=lambda m: (m[2], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start, end, matched_words) of every match in every whole text."""
    scanner = Scanner(templates)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # MOST_TEMPLATES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in own.scan(text.as_py(), coverage)]
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents_of(docs).mapInArrow(run, SCHEMA)

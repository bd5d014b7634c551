"""License scans: winnowed fingerprints of the templates pick candidates, banded alignment decides.

A match of `least` of a template's words in order lacks d of them at most. The template is cut into d + 1 windows, and each window's
fingerprint is one of its words, chosen by its content (winnowing with one-word grams; longer grams would miss short lines
with changed or inserted words). A match has the whole of one window, and so its fingerprint: none is missed. The
fingerprints are an inverted index (word -> templates and places), bounded by the list of templates and sent with the task; every word of
every whole document is looked up. A fingerprint's place tells where the template would lie around it, give or take twice the band;
counts of the template's words there, then an alignment in a band around each diagonal, all diagonals of a stretch at once, decide. A match is reported
with the covered share of the template and its span, which it uses up; what lies before and behind it is aligned again. Of alignments with as many
words the one with the latest begin, then the earliest end, counts. Words are lower-case ASCII letters, digits and everything beyond ASCII, so
punctuation and line breaks do not matter.

Null and empty texts match nothing. Rows are scanned one by one, so repeated rows, equal and
null ids and ties give rows of their own; where two templates fit, both are reported. Texts of any
length are scanned whole, each in one task. An empty table gives an empty result. Extra columns are not
read. A template without words is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tablewright.llm._arrow import Texts, distinct_spans, map_texts

BAND = 8
STRETCH = 32, 1024  # diagonals that are aligned at once: at first, and at most, as long as none matches
_CELL = (1 << 22) - 1

#: Notices as they are written in public licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-line": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
}

_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def template_index(templates: dict[str, str], least: float) -> tuple[list[str], list[np.ndarray], dict[bytes, int], np.ndarray, list[list[tuple[int, int]]]]:
    """Names, word numbers, the numbers (from 1) of all templates' words, for each template which of these it has, and for each word
    the templates and places of which it is a fingerprint."""
    names, units, known, rank = list(templates), [], {}, {}
    for t, text in enumerate(templates.values()):
        texts = Texts(pa.array([text]), lower=True)
        start, end, _ = texts.words(_GAPS)
        if not len(start):
            raise ValueError(f"template {names[t]} has no words")
        codes, found = distinct_spans(texts.data, start, end)
        units.append(np.array([known.setdefault(w, len(known) + 1) for w in found])[codes])
        rank |= {known[w]: (-len(w), xxhash.xxh3_64_intdigest(w)) for w in found}  # long words are rarer than short ones
    prints: list[list[tuple[int, int]]] = [[] for _ in range(len(known) + 1)]
    for t, unit in enumerate(units):
        for place in fingerprints(unit, least, rank):
            prints[unit[place]].append((t, place))
    return names, units, known, np.array([np.isin(np.arange(len(known) + 1), u) for u in units]), prints


def fingerprints(template: np.ndarray, least: float, rank: dict[int, tuple[int, int]]) -> list[int]:
    """Places of the template's fingerprints, one more than a match may lack: in each of so many windows the word of least rank."""
    windows = np.array_split(np.arange(len(template)), len(template) - max(needed(template, least), 1) + 1)
    return [min(w.tolist(), key=lambda i: (rank[int(template[i])], i)) for w in windows]


def needed(template: np.ndarray, least: float) -> int:
    """Words of a template that a match has at least."""
    return next(n for n in range(len(template) + 1) if n >= least * len(template))


def candidates(units: list[np.ndarray], prints: list[list[tuple[int, int]]], hits: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Templates, and where words (at `hits`, with numbers `code`) say by fingerprints that they may lie: begins and ends of stretches, each rising, that may overlap."""
    if not len(hits):
        return  # below, no words would be cut into one part for no number
    order = np.argsort(code, kind="stable")
    numbers, first = np.unique(code[order], return_index=True)
    found: dict[int, list[np.ndarray]] = {}
    for number, at in zip(numbers.tolist(), np.split(hits[order], first[1:]), strict=True):
        for t, place in prints[number]:
            found.setdefault(t, []).append(at - place)
    for t, starts in sorted(found.items()):
        at = np.unique(np.concatenate(starts))
        yield t, at - 2 * BAND, at + len(units[t]) + 2 * BAND


def places(template: np.ndarray, at: np.ndarray, stop: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Begin and end of the parts in which matches lie. at: places of words of the template; stop: the end of each one's text."""
    end = np.minimum(at + len(template) + 2 * BAND, stop)
    good = np.searchsorted(at, end) - np.arange(len(at)) >= max(needed(template, least), 1)
    begin, end = at[good], end[good]
    if len(begin):
        opens = np.concatenate([[True], begin[1:] >= end[:-1]])
        yield from zip(begin[opens].tolist(), end[np.append(np.flatnonzero(opens)[1:], len(end)) - 1].tolist(), strict=True)


def band_best(template: np.ndarray, words: np.ndarray, low: int, high: int, ds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each diagonal: how many words of the template an alignment within its band matches in order among words[low:high], and the first and last
    matched word. A cell is one number: words matched, then the later begin, then the earlier end."""
    base, width = int(ds[0]) - BAND, 2 * BAND + 1
    j = ds[:, None] - BAND + np.arange(width) - base
    row = np.zeros((len(ds), width + 1), np.int64)
    for i, word in enumerate(template.tolist()):
        at = j + i
        inside = (at + base >= low) & (at + base < high)
        hit = inside & (words[np.clip(at + base, 0, len(words) - 1)] == word)
        before = row[:, :width]
        begin = np.where(before > 0, before >> 22 & _CELL, at)
        grown = (((before >> 44) + 1) << 44) | (begin << 22) | (_CELL - at)
        row[:, :width] = np.maximum.accumulate(np.maximum(row[:, 1:], np.where(hit, grown, 0)), axis=1)
    best = row.max(axis=1)
    return best >> 44, (best >> 22 & _CELL) + base, _CELL - (best & _CELL) + base


def matches(template: np.ndarray, words: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Matched words, first and last word of all matches: the best at the first diagonals that match, then those before and behind it."""
    need, out, parts = max(needed(template, least), 1), [], [(0, len(words))]
    counts = [(np.concatenate([[0], np.cumsum(words == word)]), times) for word, times in zip(*np.unique(template, return_counts=True), strict=True)]

    def fitting(low: int, high: int, first: int, stop: int) -> np.ndarray:
        """Diagonals whose band holds enough of the template's words, each counted as often as the template has it."""
        ds = np.arange(first, stop)
        a, b = np.clip(ds - BAND, low, high), np.clip(ds + len(template) + BAND, low, high)
        total = np.zeros(len(ds), np.int64)
        for sums, times in counts:
            total += np.minimum(sums[b] - sums[a], times)
        return ds[total >= need]

    while parts:
        low, high = parts.pop()
        at, end, size = low + 1 - len(template) - BAND, high + BAND, STRETCH[0]
        while high - low >= need and at < end:
            ds = fitting(low, high, at, min(at + size, end))
            at, size = at + size, min(2 * size, STRETCH[1])
            if not len(ds):
                continue
            good = ds[band_best(template, words, low, high, ds)[0] >= need]
            if not len(good):
                continue
            d = int(good[0])
            n, a, b = band_best(template, words, low, high, fitting(low, high, d, min(d + 2 * BAND + 1, end)))
            k = int(np.argmax(n))
            out.append((int(n[k]), int(a[k]), int(b[k])))
            parts += [(max(low, d - BAND), int(a[k])), (int(b[k]) + 1, high)]
            break
    return sorted(out, key=lambda found: found[1])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, matched_words, begin, end (UTF-8 bytes of the matched span) of every match."""
    index = template_index(templates or TEMPLATES, least)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        names, units, known, has, prints = index
        texts = Texts(batch.column(1), lower=True)
        start, end, first = texts.words(_GAPS)
        codes, found = distinct_spans(texts.data, start, end)
        numbered = np.array([known.get(w, 0) for w in found], np.int64)[codes] if found else np.zeros(0, np.int64)
        hits = np.flatnonzero(numbered)  # 0: a word that no template has
        code, stop = numbered[hits], first[np.searchsorted(first, hits, "right")]
        rows, around = [], candidates(units, prints, hits, code)
        for t, begin, until in around:
            template = units[t]
            mine = has[t][code] & (np.searchsorted(begin, hits, "right") > np.searchsorted(until, hits, "right"))
            for low, high in places(template, hits[mine], stop[mine], least):
                r = int(np.searchsorted(first, low, "right")) - 1
                for n, a, b in matches(template, numbered[low:high], least):
                    rows.append((r, names[t], n / len(template), n, int(start[low + a] - texts.offsets[r]), int(end[low + b] - texts.offsets[r])))
        if not rows:
            return None
        r, name, share, n, a, b = zip(*sorted(rows, key=lambda x: x[0]), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(name), pa.array(share), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "license", "coverage", "matched_words", "begin", "end"])

    return map_texts(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, coverage double, matched_words long, begin long, end long")

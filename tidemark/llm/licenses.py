"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and documents are sequences of lower-case words of ASCII letters and digits.  Each run of ``GRAM`` words has a
hash, and of each ``WINDOW`` runs in a row the least hash is kept (winnowing), so that a document which shares
``GRAM + WINDOW - 1`` words in a row with a template keeps a fingerprint of it.  The templates' fingerprints form an
inverted index; it is as small as the list of templates, which is a parameter.  The hits of a template on diagonals
(place in the document less place in the template) near each other are a candidate if ``SEEDS`` of its fingerprints or
more are among them, and a local alignment within a band around them tells which of the template's words are there, and
where.  A chain of near diagonals that is longer than two templates is cut into pieces of a template's length, each half
over the next, so that a band's width doesn't grow with the text; each piece has its own best alignment.  All candidates
of a template and of like width in a slice of rows are aligned together, in numpy, ``CELLS`` at a time.

The templates are the license texts in the folder ``license_texts`` and short notices.

Defined results: a null text is an empty text, without matches; equal texts have equal matches; null ids are kept; a
match whose span lies within that of a match of more words is left out, of equal matches all but that of the shorter
template, then of the first in the list; without templates there are no matches; very long texts are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import frame_slices, text_or_empty

GRAM, WINDOW = 3, 3
#: Shares of a template's words that a match has at least, and of its fingerprints that a candidate has.
COVERAGE, SEEDS = 0.7, 0.1
#: Cells of bands that are aligned at once, and words that a template may have: where an alignment begins in a band of up to
#: two templates' length takes 20 bits.
CELLS, MOST_WORDS = 1 << 20, 300_000

# Notices by which works name their license.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}



@cache
def standard_templates() -> dict[str, str]:
    """The license texts by name, and the notices."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name)}
    return texts | NOTICES


#: Bytes that are words: ASCII letters (lowered) and digits, and what is beyond ASCII; all else is a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_NO = np.uint64(2**64 - 1)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def winnow(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their places; runs with a word of code -1 have none."""
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(GRAM):
        part = codes[i : i + n]
        known &= part >= 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = np.where(known, h, _NO)
    width = min(WINDOW, n)
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    kept = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    kept = kept[h[kept] != _NO]
    return h[kept], kept


#: A cell of an alignment: its score, the words matched, and where it began (less is more), packed in one number.
_POINT, _MATCH, _BEGIN = 1 << 40, 1 << 20, (1 << 20) - 1


def band_of(n_words: int) -> int:
    """How far from a diagonal an alignment of a template of so many words may go.

    Copies end to end are a template's length apart, so their bands don't meet.
    """
    return min(max(1, n_words // 4), max(8, n_words // 40))


def aligned(template: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words matched, and first and last place in ``codes``, of the best local alignment of each candidate.

    A candidate is a document (``codes`` from starts to ends) and the diagonals low to high.  Cell (i, j) of a row i of the
    template stands for the document's place i + low + j.  A match scores 2, a word that is other, missing or added -1.
    """
    n, width = len(starts), int((high - low).max()) + 1
    j = np.arange(width)
    inside = j <= (high - low)[:, None]
    up = np.zeros((n, width + 1), np.int64)
    best, best_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, word in enumerate(template.tolist()):
        at = starts[:, None] + low[:, None] + i + j
        real = inside & (at >= starts[:, None]) & (at < ends[:, None])
        same = real & (codes[np.where(real, at, 0)] == word)
        before = up[:, :width]
        begun = np.where(before > 0, before, _BEGIN - (i + j))
        cell = np.where(same, begun + 2 * _POINT + _MATCH, np.maximum(before, up[:, 1:]) - _POINT)
        cell = np.maximum(cell, np.where(up[:, 1:] > 0, up[:, 1:] - _POINT, 0))
        cell[~real | (cell < _POINT)] = 0
        # words added in the document: the best cell to the left, less a point for each step
        left = np.maximum.accumulate(np.where(cell > 0, cell + j * _POINT, -1), axis=1) - j * _POINT
        cell = np.where(real & (left >= _POINT), np.maximum(cell, left), cell)
        top = cell.argmax(axis=1)
        value = cell[np.arange(n), top]
        more = value // _POINT > best // _POINT
        best[more], best_at[more] = value[more], (i + top)[more]
        up[:, :width] = cell
    begin = _BEGIN - (best & _BEGIN)
    return (best // _MATCH) & _BEGIN, starts + low + begin, starts + low + best_at


class LicenseIndex:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.vocabulary: dict[bytes, int] = {}
        self.codes = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)], np.int64) for t in templates.values()]
        if any(len(c) > MOST_WORDS for c in self.codes):
            raise ValueError(f"a template has more than {MOST_WORDS} words")
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.kept = []
        for t, codes in enumerate(self.codes):
            found = [x.tolist() for x in winnow(codes)]
            self.kept.append(len(found[0]))
            for h, at in zip(*found, strict=True):
                self.places.setdefault(h, []).append((t, at))
        self.hashes = np.array(sorted(self.places), np.uint64)

    def _candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of the runs of near diagonals with hits enough."""
        hashes, at = winnow(codes)
        hit = np.isin(hashes, self.hashes)
        hits: dict[int, list[tuple[int, int]]] = {}
        for h, p in zip(hashes[hit].tolist(), at[hit].tolist(), strict=True):
            for t, q in self.places[h]:
                hits.setdefault(t, []).append((p - q, q))
        for t, found in hits.items():
            size, least = len(self.codes[t]), SEEDS * self.kept[t]
            band = band_of(size)
            shifts, places = np.array(sorted(found), np.int64).T
            ends = np.flatnonzero(np.diff(shifts) > band) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(shifts)], strict=True):
                if b - a < least:
                    continue
                low, high = int(shifts[a]) - band, int(shifts[b - 1]) + band
                pieces = [(low, high)]
                if high - low >= 2 * size:
                    width = max(size, 4 * band)
                    pieces = [(x, x + width) for x in range(low, high - width // 2, max(1, width // 2))]
                froms, tos = np.searchsorted(shifts[a:b], [x for x, _ in pieces]) + a, np.searchsorted(shifts[a:b], [y for _, y in pieces], "right") + a
                for (x, y), i, j in zip(pieces, froms.tolist(), tos.tolist(), strict=True):
                    if j - i >= least and len(set(places[i:j].tolist())) >= least:
                        yield t, x, min(y, high)

    def matches(self, texts: list[str], coverage: float = COVERAGE) -> list[list[tuple[str, int, int, float, int, int]]]:
        """(template, matched words, words of the template, coverage, start, end in code points) of each match of each text."""
        raws = [text.encode().translate(_PLAIN) for text in texts]
        parts = [np.array([self.vocabulary.get(w, -1) for w in raw.split()], np.int64) for raw in raws]
        ends = np.cumsum([len(p) for p in parts])
        codes = np.concatenate([*parts, np.full(1, -1, np.int64)])
        sought: dict[int, list[tuple[int, int, int]]] = {}
        for d, part in enumerate(parts):
            for t, low, high in self._candidates(part):
                sought.setdefault(t, []).append((d, low, high))
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for t, own in sought.items():
            d, low, high = (np.array(x) for x in zip(*own, strict=True))
            starts = ends[d] - np.array([len(parts[i]) for i in d])
            widths = high - low + 1
            likes = np.ceil(np.log2(widths)).astype(np.int64)
            for like in np.unique(likes):
                same = np.flatnonzero(likes == like)
                step = max(1, CELLS >> int(like))
                for o in (same[x : x + step] for x in range(0, len(same), step)):
                    made = aligned(self.codes[t], codes, starts[o], ends[d[o]], low[o], high[o])
                    for n, first, end, i, start in zip(*(x.tolist() for x in (*made, d[o], starts[o])), strict=True):
                        if n and n >= coverage * len(self.codes[t]):
                            found.setdefault(i, []).append((t, n, first - start, end - start))
        return [self._reported(texts[d], raws[d], found[d]) if d in found else [] for d in range(len(texts))]

    def _reported(self, text: str, raw: bytes, found: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float, int, int]]:
        best = []
        for t, n, first, end in sorted(set(found), key=lambda m: (-m[1], len(self.codes[m[0]]), m)):
            if not any(a <= first and end <= b for _, _, a, b in best):
                best.append((t, n, first, end))
        spans = [m.span() for m in _WORD.finditer(raw)]
        # characters up to each byte: bytes that go on with a character don't count
        chars = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)])
        size = lambda t: len(self.codes[t])
        return [(self.names[t], n, size(t), n / size(t), int(chars[spans[a][0]]), int(chars[spans[b][1]])) for t, n, a, b in sorted(best, key=lambda m: (m[2], m[3], m[0]))]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, template, matched, template_words, coverage, start and end of each match of each document."""
    chosen = standard_templates() if templates is None else templates

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = LicenseIndex(chosen)
        for frame in frame_slices(frames):
            found = index.matches(frame["text"].to_list(), coverage)
            rows = [(i, *m) for i, own in zip(frame["doc_id"], found, strict=True) for m in own]
            made = pd.DataFrame(rows, columns=["doc_id", "template", "matched", "template_words", "coverage", "start", "end"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, template string, matched int, template_words int, coverage double, start int, end int")

"""License scans: MinHash bands over overlapping windows, then containment.

A text's windows of ``WINDOW`` words, each starting half a window after the last,
are signed over their word shingles and meet the templates' windows through
bands.  A candidate template is confirmed by the share of its shingles that the
text around the window holds.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, shingle_hashes, spans_of, text_buffer, tidy, word_bounds, word_hashes
from .near_dedup import _odd, lowered

#: Words of a shingle: license lines are short, so three rather than five.
SHINGLE = 3
#: 24 bands of 2 rows: windows of similarity 0.5 share none with probability 0.001.
BANDS, ROWS = 24, 2
CONTAINED = 0.8
#: Templates are sent to the tasks; more words than this go in several scans.
MAX_TEMPLATE_WORDS = 1_000_000

# Public license notices by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


#: Full texts by SPDX name, and words of the pieces they are cut into.
TEXTS = Path(__file__).parent / "licenses"
PIECE = 64

# Full texts and headers of other licenses.
MORE = [
    ("MIT-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause-text", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-2.0-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def all_templates() -> list[tuple[str, str]]:
    """TEMPLATES, MORE and the pieces of the full texts; all pieces of a text have
    its name with -text."""
    out = TEMPLATES + MORE
    for path in sorted(TEXTS.glob("*.txt")):
        words = path.read_text(encoding="utf-8").split()
        cuts = [words[i : i + PIECE] for i in range(0, len(words), PIECE)]
        if len(cuts) > 1 and len(cuts[-1]) < PIECE // 2:
            cuts[-2:] = [cuts[-2] + cuts[-1]]
        out = out + [(path.stem + "-text", " ".join(c)) for c in cuts]
    return out


def _signatures(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of the shingle ranges [start, stop), none empty."""
    times, plus = _odd(71, bands * rows), _odd(83, bands * rows)
    # Overlapping ranges as pairs of bounds of one reduceat; the odd results are gaps.
    at = np.stack([starts, np.minimum(stops, len(h))], axis=1).ravel()
    keys = np.empty((len(starts), bands), np.uint64)
    padded = np.append(h, np.uint64(0))
    for b in range(bands):
        key = np.full(len(starts), _odd(97, bands)[b])
        for r in range(rows):
            x = padded * times[b * rows + r] + plus[b * rows + r]
            x[-1] = np.uint64(2**64 - 1)
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(x, at)[::2])
        keys[:, b] = key
    return keys


class Scanner:
    """The templates' windows by band key, and their shingle sets."""

    def __init__(self, templates: list[tuple[str, str]], bands: int = BANDS, rows: int = ROWS, contained: float = CONTAINED, shingle: int = SHINGLE):
        self.names = [n for n, _ in templates]
        self.bands, self.rows, self.contained, self.shingle = bands, rows, contained, shingle
        self.sets, sizes = [], []
        for _, text in templates:
            h, before = self._shingles(pa.array([text], pa.string()))[:2]
            self.sets.append(np.unique(h))
            sizes.append(len(h))
        # One window length for each power of two that a template's size asks for.
        self.scales = sorted({1 << int(np.ceil(np.log2(max(n, 2)))) for n in sizes})
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for scale in self.scales:
            own = [i for i, n in enumerate(sizes) if n and 1 << int(np.ceil(np.log2(max(n, 2)))) == scale]
            if own:
                k = np.concatenate([_signatures(self.sets[i], np.asarray([0]), np.asarray([len(self.sets[i])]), bands, rows)[0] for i in own])
                t = np.repeat(own, bands)
                order = np.argsort(k, kind="stable")
                self.keys[scale] = k[order], t[order], np.unique(np.concatenate([self.sets[i] for i in own]))

    def _shingles(self, column):
        raw, offsets = text_buffer(column)
        low = lowered(raw)
        starts, ends, first = word_bounds(low, offsets)
        h, before = shingle_hashes(word_hashes(low, starts, ends), first, self.shingle)
        return h, before, starts, ends, first

    def _bettered(self, best: dict, d: int, t: int) -> bool:
        """Whether a notice is another one's with a few words changed: the other is
        held to a larger share on most of the same words."""
        share, at, words = best[(d, t)]
        if not self.names[t].endswith("-notice"):
            return False
        for (e, u), (more, there, long) in best.items():
            if e == d and more > share and self.names[u].endswith("-notice") and 2 * (min(words - at, long - there) - max(-at, -there)) > words:
                return True
        return False

    def scan(self, column: pa.Array):
        """(document, template, containment, first word, words) of each find, the
        best place of a name's templates in a document."""
        out = []
        raw, offsets = text_buffer(column)
        for a, b in spans_of(offsets, 1 << 19):
            part = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((offsets[a : b + 1] - offsets[a]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[offsets[a] : offsets[b]]))])
            h, before, *_ = self._shingles(part)
            if not len(h):
                continue
            best: dict[tuple[int, int], tuple] = {}
            for scale, (keys, names, shingles) in self.keys.items():
                step = max(1, scale // 2)
                n = np.diff(before)
                count = np.where(n > 0, (np.maximum(n - scale, 0) + step - 1) // step + 1, 0)
                doc = np.repeat(np.arange(b - a), count)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = before[doc] + k * step
                stop = np.minimum(start + scale, before[doc + 1])
                good = start < stop
                doc, start, stop = doc[good], start[good], stop[good]
                # Windows that hold no shingle of any template can't lead to a find.
                known = np.isin(h, shingles)
                upto = np.concatenate([[0], np.cumsum(known)])
                some = upto[stop] > upto[start]
                doc, start, stop = doc[some], start[some], stop[some]
                if not len(doc):
                    continue
                hit = set()
                sig = _signatures(h, start, stop, self.bands, self.rows)
                # The shingles of a window that templates know, signed apart: text around a short notice doesn't hide it.
                flat = np.flatnonzero(known)
                own_sig = _signatures(h[flat], upto[start], upto[stop], self.bands, self.rows)
                for s in (sig, own_sig):
                    at = np.searchsorted(keys, s)
                    for w, band in zip(*np.nonzero(keys[np.minimum(at, len(keys) - 1)] == s), strict=True):
                        p = at[w, band]
                        while p < len(keys) and keys[p] == s[w, band]:
                            hit.add((int(w), int(names[p])))
                            p += 1
                for w, t in hit:
                    d = int(doc[w])
                    lo, hi = max(int(before[d]), int(start[w]) - scale), min(int(before[d + 1]), int(stop[w]) + scale)
                    inside = np.isin(h[lo:hi], self.sets[t])
                    share = len(np.unique(h[lo:hi][inside])) / len(self.sets[t])
                    if share >= self.contained:
                        where = np.flatnonzero(inside)
                        found = (share, -(lo + int(where[0]) - int(before[d])), int(where[-1] - where[0]) + self.shingle)
                        own = self.names.index(self.names[t])
                        if found > best.get((d, own), (0.0, 0, 0)):
                            best[(d, own)] = found
            out += [(a + d, t, share, -at, words) for (d, t), (share, at, words) in sorted(best.items()) if not self._bettered(best, d, t)]
        return out


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None, **options) -> DataFrame:
    """(doc_id, license, containment, first_word, n_words) for each name of
    ``templates`` (name, text; None: ``all_templates``) one of whose texts a document of ``docs`` (doc_id, text) holds:
    of its distinct word shingles, A-Z lower-cased, at least the share
    ``contained`` stands around one window.  The best place of a name is
    returned, the first of equal ones; texts that licenses share name them all; of notices
    that differ in a few words the one that fits best is named.

    Null and empty texts and templates give nothing; a template shorter than a
    shingle is matched as a whole text of its words only.  Repeated rows come
    back as often as they are given.
    """
    # All texts of a name go in one scan, notices first, so that they are weighed against each other.
    named: dict[str, list[tuple[str, str]]] = {}
    for name, text in all_templates() if templates is None else templates:
        named.setdefault(name, []).append((name, text or ""))
    rounds, words = [[]], 0
    for name in sorted(named, key=lambda n: not n.endswith("-notice")):
        size = sum(len(text.split()) for _, text in named[name])
        if rounds[-1] and words + size > MAX_TEMPLATE_WORDS:
            rounds.append([])
            words = 0
        rounds[-1] += named[name]
        words += size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(some):
        scanner = Scanner(some, **options)

        def run(batches):
            for b in batches:
                found = scanner.scan(b.column(1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([scanner.names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                    ["doc_id", "license", "containment", "first_word", "n_words"],
                )

        return texts.mapInArrow(tidy(run), "doc_id long, license string, containment double, first_word long, n_words long")

    out = one(rounds[0])
    for some in rounds[1:]:
        out = out.unionByName(one(some))
    return out

"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Windows are short: of W shingles of five words, at every quarter of W in a text and at every shingle of a template. A text
that holds 0.8 of a template's shingles breaks it in few places, as each break costs the four shingles across it; so the
longest unbroken stretch has a length that follows from the template's (`stretch`), and W is chosen so that some window of
the text lies in it. Such a window equals one of the template's and shares all bands. Windows with some other words share
a band with the probability 1 - (1 - J^ROWS)^BANDS, 0.997 for a J of 0.7. Retrieved templates are compared word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import as_texts, words

SHINGLE = 5
CONTAINMENT = 0.8
ROWS, BANDS = 2, 9
#: Window lengths in shingles; a template takes the longest that its least unbroken stretch is sure to hold.
WINDOWS = (1, 2, 4, 8)
#: Text bytes whose windows are hashed at once.
SLICE_BYTES = 4 << 20
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 2**63, SHINGLE + ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(2**64 - 1)

# Licenses and license notices as published.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-license": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def shingles(tokens: list[bytes]) -> list[bytes]:
    """Five-word shingles; shorter texts are one shingle, texts without words none."""
    if not tokens:
        return []
    return [b" ".join(tokens[i : i + SHINGLE]) for i in range(max(len(tokens) - SHINGLE, 0) + 1)]


def stretch(n: int) -> int:
    """Shingles of the longest unbroken stretch of a template of n that a text with CONTAINMENT of them holds at least, if each break loses the shingles across it."""
    missing = int(n * (1 - CONTAINMENT) + 1e-9)
    return -(-(n - missing) // (missing // (SHINGLE - 1) + 1))


def window_of(n: int) -> int:
    """The window length of a template of n shingles: wherever a window grid of quarter steps falls, one lies in the stretch."""
    return max(w for w in WINDOWS if w == 1 or w + w // 4 + (w < 4) - 1 <= stretch(n))


def _step(w: int) -> int:
    return max(w // 4, 1)


def _hashes(flat: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A hash for the five words from each place on; none where they aren't all inside one text."""
    n = len(flat) - SHINGLE + 1
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        h += flat[k : k + n] * _MIX[k]
        whole &= inside[k : k + n]
    h ^= h >> np.uint64(29)
    h *= _MIX[SHINGLE]
    return np.where(whole, h, _NONE)


def _bands(h: np.ndarray, starts: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(window length, band, key of each start): the least values of ROWS hash functions over each window, mixed."""
    valid = h != _NONE
    rows: dict[int, np.ndarray] = {}
    for k in range(ROWS * BANDS):
        least = np.where(valid, h * _FACTORS[k], _NONE)
        width = 1
        for w in sorted(starts):
            while width < w:
                least[:-width] = np.minimum(least[:-width], least[width:])
                width *= 2
            if w == 1 and k >= ROWS:
                continue  # single shingles are equal or not: one band
            got = least[starts[w]] * _MIX[SHINGLE + 1 + k % ROWS]
            if k % ROWS:
                rows[w] += got
                rows[w] ^= rows[w] >> np.uint64(31)
                yield w, k // ROWS, rows[w]
            else:
                rows[w] = got


def _flat(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row with gaps that no window crosses, which places hold words, and where texts begin."""
    gap = WINDOWS[-1] + SHINGLE
    begins = np.cumsum([0, *[len(t) + gap for t in texts]])
    flat, inside = np.zeros(begins[-1] + SHINGLE, np.uint64), np.zeros(begins[-1] + SHINGLE, bool)
    for at, tokens in zip(begins, texts, strict=False):
        flat[at : at + len(tokens)] = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
        inside[at : at + len(tokens)] = True
    return flat, inside, begins


class Templates:
    """Templates of a bounded list, with the tables to look windows up in."""

    def __init__(self, texts: dict[str, str]) -> None:
        tokens = {k: words(v.encode()) for k, v in texts.items()}
        tokens = {k: v for k, v in tokens.items() if v}
        self.shingles = {k: frozenset(shingles(v)) for k, v in tokens.items()}
        self.short = [k for k, v in tokens.items() if len(v) < SHINGLE]
        self.table: dict[tuple[int, int], dict[int, set[str]]] = {}
        self.windows: list[int] = []
        long = [k for k in tokens if k not in self.short]
        if long:
            flat, inside, begins = _flat([tokens[k] for k in long])
            h = _hashes(flat, inside)
            size = np.array([window_of(len(tokens[k]) - SHINGLE + 1) for k in long])
            starts, names = {}, {}
            for w in sorted(set(size.tolist())):
                own = [(np.arange(b, b + max(len(tokens[long[i]]) - SHINGLE + 1 - w, 0) + 1), long[i]) for i, b in enumerate(begins[:-1]) if size[i] == w]
                starts[w] = np.concatenate([s for s, _ in own])
                names[w] = [name for s, name in own for _ in s]
            self.windows = sorted(starts)
            for w, band, keys in _bands(h, starts):
                held = self.table.setdefault((w, band), {})
                for key, name in zip(keys.tolist(), names[w], strict=True):
                    held.setdefault(key, set()).add(name)
        self.first = {at: np.zeros(1 << 16, bool) for at in self.table}  # the keys' upper bits, to pass over nearly all windows at once
        for at, held in self.table.items():
            self.first[at][np.array(list(held), np.uint64) >> np.uint64(48)] = True

    def retrieve(self, texts: list[list[bytes]]) -> dict[int, set[str]]:
        """For each text's number, the templates whose windows share a band with one of its own."""
        out: dict[int, set[str]] = {}
        for k, tokens in enumerate(texts):
            if 0 < len(tokens) < SHINGLE and self.short:
                out[k] = set(self.short)
        if not self.windows or not any(len(t) >= SHINGLE for t in texts):
            return out
        flat, inside, begins = _flat(texts)
        h = _hashes(flat, inside)
        place = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h))))
        starts = {w: np.flatnonzero((h != _NONE) & (place % _step(w) == 0)) for w in self.windows}
        for w, band, keys in _bands(h, starts):
            held = self.table[w, band]
            for i in np.flatnonzero(self.first[w, band][keys >> np.uint64(48)]).tolist():
                names = held.get(int(keys[i]))
                if names:
                    out.setdefault(int(np.searchsorted(begins, starts[w][i], side="right")) - 1, set()).update(names)
        return out

    def verified(self, tokens: list[bytes], names: set[str]) -> dict[str, float]:
        """Of these templates, those of which CONTAINMENT of the shingles is in the text, with their share."""
        held = set(shingles(tokens))
        share = {name: len(self.shingles[name] & held) / len(self.shingles[name]) for name in names}
        return {k: v for k, v in share.items() if v >= CONTAINMENT}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_licenses, licenses (sorted, comma-joined), containment (largest; 0 where none).

    A license is found if a text holds 0.8 or more of its distinct five-word shingles, wherever they stand, so long as
    some unbroken stretch of it is as long as a broken-up whole must have (`stretch`). Null and empty texts hold none; null
    and repeated ids are scanned row by row; columns besides id and text are left out, whatever their names; no documents
    give no rows, and no templates find nothing.
    """
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts)
        for batch in batches:
            for part in common.slices(batch, 1, SLICE_BYTES):
                tokens = [words(t) for t in as_texts(part.column(1))]
                found = {k: known.verified(tokens[k], names) for k, names in known.retrieve(tokens).items()}
                rows = [found.get(k, {}) for k in range(len(tokens))]
                yield pa.record_batch(
                    [part.column(0), pa.array(map(len, tokens), pa.int64()), pa.array(map(len, rows), pa.int64()), pa.array([",".join(sorted(r)) for r in rows], pa.string()), pa.array([max(r.values(), default=0.0) for r in rows], pa.float64())],
                    ["doc_id", "n_words", "n_licenses", "licenses", "containment"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_licenses long, licenses string, containment double")


def keep_licensed(docs: DataFrame, allowed: list[str], templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id of the documents whose licenses are all allowed, or that have none."""
    found = scan_licenses(docs, templates)
    names = F.filter(F.split("licenses", ","), lambda x: x != "")
    return found.where(F.size(F.array_except(names, F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))) == 0).select("doc_id")

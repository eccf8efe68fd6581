"""License scans: MinHash bands over overlapping text windows, then exact
shingle containment.

A template with s five-word shingles belongs to the window class h, the least
power of two >= s - 1; windows of 2 h shingles start every h shingles, so any
s consecutive shingles lie inside one window. A window that holds a share c of
the template has Jaccard >= 0.8 s / (2 h + 0.2 s) >= 0.2 (c = 0.8), and with
BANDS = 64 bands of one MinHash each it collides with the template with
probability >= 1 - 0.8^64 = 0.9999994. Windows that collide are verified by
exact containment of the template's shingles in the window.

A window without a single template shingle can neither collide on a shared
minimum nor be verified, so signatures are only computed for windows around
template shingles; the templates are a bounded parameter and travel with the
tasks. Whole texts are scanned in pieces; each text is worked on by itself.

Defined cases: null text counts as empty; rows without id are scanned and keep
the null; repeated rows give repeated results; a template with fewer than five
words is its whole sequence; of templates that hold CONTAINMENT of each other,
the one with the greatest containment stands for a place. Marks (ASCII ones, typographic quotes and dashes)
count as white space in texts and templates, so that other marks, line breaks
and comment signs make no difference; places are still those of the white-space
separated words. Only a template of a single shingle that ends with a mark asks
for some mark after it, as five common words alone say little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.tables import text_or_empty
from pulseframe.llm.textvec import WORDS, mix, pieces, shingles, words
from pulseframe.session import ship_package

BANDS = 64
CONTAINMENT = 0.8

# Short licence lines and the notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                "following conditions are met",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
                         "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                         "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                         "language governing permissions and limitations under the License.",
    # Versions 2 and 3 differ in one word of these.
    **{f"{name}-notice": f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} License as "
                         "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
       for name, what, kind in (("GPL", "program", "General Public"), ("LGPL", "library", "Lesser General Public"),
                                ("AGPL", "program", "Affero General Public"))},
    "GNU-disclaimer": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                      "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU",
    "MIT-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                      "Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                      "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
                      "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                      "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                      "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                      "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
                      "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                 "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                 "non-commercial, and by any means.",
    **{f"CC-{name}-4.0-notice": f"This work is licensed under a Creative Commons {kind} 4.0 International License."
       for name, kind in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                          ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}

_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _marks(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to marks."""
    on = _MARK[data]
    if len(data) > 2:
        # U+2010 to U+201F: dashes and quotes.
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x90) & (data[2:] <= 0x9F))
        on[(at[:, None] + np.arange(3)).ravel()] = True
    return on


def _bare_words(data: np.ndarray, offs: np.ndarray):
    """Hash of every word without marks, whether a mark follows it, and the
    first word of each row; and its place among the white-space separated words of its row."""
    on = _marks(data)
    start, end, h, first = words(np.where(on, np.uint8(32), data), offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    marked = (end < offs[row + 1]) & on[np.minimum(end, max(len(data) - 1, 0))] if len(data) else np.zeros(0, bool)
    whole, _, _, whole_first = words(data, offs)
    place = np.searchsorted(whole, start, "right") - 1 - whole_first[row]
    return h, marked, first, place


def _shingles_of(text: str) -> np.ndarray:
    for _, data, offs in pieces(pa.array([text])):
        h, _, first, _ = _bare_words(data, offs)
        return shingles(h, first)[0]
    return np.zeros(0, np.uint64)


class Index:
    """Templates by window class, with their MinHash signatures."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.classes: dict[int, list] = {}
        closed = []  # single shingles that ask for a mark
        for name, text in templates.items():
            s = np.unique(_shingles_of(text))
            if len(s) == 1 and _marks(np.frombuffer(text.rstrip().encode(), np.uint8))[-1]:
                closed.append(s)
            if len(s):
                h = 1
                while h < len(s) - 1:
                    h *= 2
                self.classes.setdefault(h, []).append((name, s, self.signature(s)))
        named = [(t[0], t[1]) for ts in self.classes.values() for t in ts]
        # Templates that nearly hold each other: the one found best stands for a place.
        self.siblings = {a: {b for b, y in named if b != a and len(np.intersect1d(x, y)) >= CONTAINMENT * max(len(x), len(y))} for a, x in named}
        sets = [x for _, x in named]
        self.all = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.closed = np.concatenate(closed) if closed else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << 16, dtype=bool)
        self.bitmap[(self.all >> np.uint64(48)).astype(np.int64)] = True

    def signature(self, s: np.ndarray) -> np.ndarray:
        return mix(s[None, :] ^ self.salts[:, None]).min(axis=1)

    def scan(self, s: np.ndarray, near: np.ndarray):
        """(template, containment, first shingle, last shingle) of a text with
        shingles ``s``, of which ``near`` are in some template."""
        for h, templates in self.classes.items():
            at = np.unique(np.concatenate([near // h, near // h - 1]))
            for w in at[at >= 0]:
                lo = int(w) * h
                part = s[lo:lo + 2 * h]
                sig = None
                for name, t, want in templates:
                    sig = self.signature(part) if sig is None else sig
                    if (sig == want).any():
                        hit = np.isin(part, t)
                        share = len(np.unique(part[hit])) / len(t)
                        if share >= CONTAINMENT:
                            place = np.flatnonzero(hit) + lo
                            yield name, share, int(place[0]), int(place[-1])


def one_place(spans) -> dict:
    """(template, first, last) -> containment: spans of a template that overlap
    (seen from overlapping windows) are one place."""
    out, held = {}, None
    for name, lo, hi, share in sorted((n, lo, hi, share) for n, share, lo, hi in spans):
        if held and held[0] == name and lo <= held[2]:
            share = max(share, out.pop(held))
            lo, hi = held[1], max(held[2], hi)
        held = (name, lo, hi)
        out[held] = share
    return out


def licence_spans(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
                  bands: int = BANDS) -> DataFrame:
    """(id, licence, containment, first_word, last_word): verified windows, one
    row for each template and place (0-based words)."""
    ship_package(df.sparkSession)
    index = df.sparkSession.sparkContext.broadcast(Index(templates, bands))

    def scan(batches):
        ix = index.value
        for b in batches:
            ids, out = b.column("id"), []
            for i, data, offs in pieces(b.column("text")):
                h, marked, first, place = _bare_words(data, offs)
                s, at = shingles(h, first)
                near = np.flatnonzero(ix.bitmap[(s >> np.uint64(48)).astype(np.int64)])
                near = near[np.isin(s[near], ix.all)]
                row = np.searchsorted(at, near, "right") - 1
                last = np.minimum(first[row] + near - at[row] + WORDS, first[row + 1]) - 1
                open_end = np.isin(s[near], ix.closed) & ~marked[last]
                s[near[open_end]] = 0  # no shingle of a template
                near, row = near[~open_end], row[~open_end]
                for r in np.unique(row):
                    found = one_place(ix.scan(s[at[r]:at[r + 1]], near[row == r] - at[r]))
                    found = {(n, lo, hi): x for (n, lo, hi), x in found.items()
                             if not any(b in ix.siblings[n] and y > x and lo2 <= hi and lo <= hi2 for (b, lo2, hi2), y in found.items())}
                    w = place[first[r]:first[r + 1]]
                    out += [(i + int(r), name, share, int(w[lo]), int(w[min(hi + WORDS, len(w)) - 1])) for (name, lo, hi), share in found.items()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                                              pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                                             names=["id", "licence", "containment", "first_word", "last_word"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return docs.mapInArrow(scan, "id long, licence string, containment double, first_word long, last_word long")

"""Licence scans: Dice coefficient over word bigrams against templates.

Texts are normalised to lower-case runs of letters and digits. All passages of a
text are compared, so a licence is found as a whole text, as a header or as a
line inside other text, with words put in or changed anywhere. Dice >= t with a
template of b bigrams needs b * t / (2 - t) of them at least and b * (2 / t - 2)
others at most; texts and passages outside these bounds are never compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, slices, text_bytes, window_hashes
from .decontamination import _BREAK, words_of

DICE = 0.8
#: Licence texts and notices (public texts of their stewards).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
)


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, ...]]:
    """A single word counts as one bigram with nothing after it."""
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset((w,) for w in words)


def full_texts() -> tuple[tuple[str, str], ...]:
    """The whole texts in the folder licenses (public texts of their stewards), by file name."""
    folder = resources.files(__package__).joinpath("licenses")
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE):
        self.dice = dice
        self.ratio = dice / (2 - dice)
        known = [window_hashes(Words(text_bytes(pa.array([b" ".join(words_of(t)).decode()])), 0, 1).hashes(), 2) for _, t in templates]
        self.hashed = [(name, frozenset(x.tolist())) for (name, _), x in zip(templates, known, strict=True) if len(x)]
        self.need = np.array([self.ratio * len(own) - 1e-9 for _, own in self.hashed])
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *known]))
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        # of each key the templates that have it
        pairs = [(np.searchsorted(self.keys, np.array(sorted(own), np.uint64)), i) for i, (_, own) in enumerate(self.hashed)]
        slot, which = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p for p, _ in pairs], [np.full(len(p), i) for p, i in pairs]))
        order = np.argsort(slot, kind="stable")
        self.which, self.first = which[order], np.searchsorted(slot[order], np.arange(len(self.keys) + 1))

    def best(self, here: list[int], own: frozenset[int]) -> tuple[float, int, int] | None:
        """(Dice, first word, words) of the best passage (the earliest of equals), if it reaches the threshold.

        The best of all passages starts and ends with a bigram of the template. One
        with more than size * (2 / dice - 2) distinct other bigrams is below the
        threshold however it goes on. Two pointers give for each start the longest
        passage within that bound, and so the most template bigrams that any passage
        from there can have; starts are tried in order of what that allows, until
        it allows no more than what was found.
        """
        size = len(own)
        most = size * (2 / self.dice - 2) + 1e-9
        known, other, n, e = Counter(), Counter(), len(here), 0
        starts = []
        for s, x in enumerate(here):
            while e < n:
                y = here[e]
                if y in own:
                    known[y] += 1
                elif y in other or len(other) + 1 <= most:
                    other[y] += 1
                else:
                    break
                e += 1
            if x in own:
                starts.append((-2 * len(known) / (len(known) + size), s))
            if e == s:
                e = s + 1  # a bigram that no passage can hold
                continue
            held = known if x in own else other
            held[x] -= 1
            if not held[x]:
                del held[x]
        top = (0.0, 0, 0)
        for bound, s in sorted(starts):
            if -bound < max(top[0], self.dice - 1e-9) - 1e-12:
                break
            d, end = self._longest(here, s, own, most)
            if (d, -s) > (top[0], -top[1]):
                top = (d, s, end - s + 2)
        return top if top[0] >= self.dice - 1e-9 else None

    def _longest(self, here: list[int], s: int, own: frozenset[int], most: float) -> tuple[float, int]:
        """The best Dice of the passages from s on, and where the shortest such ends."""
        known, other, top, end, size = set(), set(), 0.0, s, len(own)
        for k in range(s, len(here)):
            x = here[k]
            if x not in own:
                other.add(x)
                if len(other) > most:
                    break
            elif x not in known:
                known.add(x)
                d = 2 * len(known) / (len(known) + len(other) + size)
                if d > top:
                    top, end = d, k
                if len(known) == size:
                    break
        return top, end

    def find(self, column: pa.Array, start: int, end: int) -> Iterator[tuple[int, str, float, int, int]]:
        """(text, licence, Dice, first word, words) of the best passage of each licence in each text."""
        if not len(self.keys):
            return
        w = Words(column, start, end, lower=True, no_word=_BREAK)
        h = window_hashes(w.hashes(), 2)
        if not len(h):
            return
        at = np.flatnonzero(self.some[(h >> np.uint64(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[slot] == h[at]
        at, slot = at[hit], slot[hit]
        text = np.searchsorted(w.first, at, "right") - 1
        inside = at + 2 <= w.first[text + 1]
        text, slot = text[inside], slot[inside]
        # how many distinct bigrams of each template a text has: the others are never compared
        both = np.unique(text * len(self.keys) + slot)
        text, slot = both // len(self.keys), both % len(self.keys)
        n = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, counts = np.unique(np.repeat(text, n) * len(self.hashed) + self.which[entry], return_counts=True)
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        held, here = -1, []
        for pair in pairs[counts >= self.need[pairs % len(self.hashed)]].tolist():
            t, i = divmod(pair, len(self.hashed))
            if t != held:
                held, here = t, h[int(w.first[t]) : int(w.first[t + 1]) - 1].tolist()
            name, own = self.hashed[i]
            got = self.best(here, own)
            if got and ((old := best.get((t, name))) is None or (got[0], -got[1], got[2]) > (old[0], -old[1], old[2])):
                best[t, name] = got
        for (t, name), (d, s, n) in sorted(best.items()):
            yield t, name, d, s, n


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple[tuple[str, str], ...] | None = None, dice: float = DICE) -> DataFrame:
    """A row for each licence in each text: the keep columns, license, dice, first_word, n_words (of its best passage; the earlier of equals).

    Null and empty texts have none. Rows that repeat give their rows again; other
    columns are left out. No shuffle: templates (notices and whole texts where none
    are given; some 150 KB) go with the task. Without templates nothing is found.
    """
    templates = (*TEMPLATES, *full_texts()) if templates is None else templates
    kept = docs.select(*keep, docs[text].alias("__text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, dice)
        for batch in batches:
            column = text_bytes(batch.column(batch.num_columns - 1))
            rows = [(a + t, *rest) for a, b in slices(column) for t, *rest in known.find(column, a, b)]
            if rows:
                at = pa.array([r[0] for r in rows], pa.int64())
                new = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *new], names=[*batch.schema.names[:-1], "license", "dice", "first_word", "n_words"])

    return kept.mapInArrow(run, ", ".join([*types, "license string, dice double, first_word bigint, n_words bigint"]))

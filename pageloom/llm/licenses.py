"""License scanning: MinHash bands over overlapping windows of a text retrieve templates, exact shingle containment verifies them.

For a template of ``n`` shingles, windows of 1.25 n shingles begin every quarter of it, so some window holds any passage of that
length whole. A passage that contains ``CONTAINMENT`` of the template has a Jaccard similarity of at least c / (2.25 - c) with that
window; the number of bands is what makes a collision at this similarity certain but for the chance ``MISS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.shared import text_id
from pageloom.llm.tokens import steps, strings, window_hash, words

SHINGLE = 2
CONTAINMENT = 0.8
ROWS = 2
MISS = 1e-4

#: (license, text to look for); a license may have several: notices of one line, headers, and whole texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
)
SCHEMA = "doc_id long, license string, containment double, first_word int"


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` values after which sets of this similarity are missed with at most this chance."""
    return int(np.ceil(np.log(miss) / np.log(1 - similarity**rows)))


class Index:
    """Templates with their shingles and bands; those of one number of shingles share their windows."""

    def __init__(self, templates: tuple, containment: float) -> None:
        self.names = [name for name, _ in templates]
        self.containment = containment
        similarity = containment / (2.25 - containment)
        self.bands = bands_for(similarity)
        rng = np.random.default_rng(12_582_917)
        self.factors = (rng.integers(0, 2**32, self.bands * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)
        w = words(strings(pa.array([text for _, text in templates], pa.string())))
        self.sets = []
        for i in range(len(templates)):
            h = window_hash(w.hash[w.ptr[i] : w.ptr[i + 1]], SHINGLE)
            if not len(h):
                raise ValueError(f"a template needs {SHINGLE} words or more")
            self.sets.append(np.unique(h))
        self.all = np.unique(np.concatenate(self.sets))
        member = [np.searchsorted(self.all, s) for s in self.sets]
        by = np.argsort(np.concatenate(member), kind="stable")
        self.owner = np.repeat(np.arange(len(templates)), [len(m) for m in member])[by]  # the templates of each shingle, shingle by shingle
        self.first = np.searchsorted(np.concatenate(member)[by], np.arange(len(self.all) + 1))
        self.least_shared = np.array([np.ceil(containment * len(s) - 1e-9) for s in self.sets])
        self.groups: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.groups.setdefault(len(s), []).append(i)
        self.least = [(_low(s)[:, None] * self.factors[None, :]).min(axis=0) for s in self.sets]
        self.widest = max(self.window(n) for n in self.groups)

    def possible(self, row: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
        """The rows that hold enough of some template's shingles anywhere; no window of the others can."""
        at = np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)
        found = self.all[at] == grams
        pairs = np.unique(row[found] * len(self.all) + at[found])
        row, gram = pairs // len(self.all), pairs % len(self.all)
        count = self.first[gram + 1] - self.first[gram]
        owner = self.owner[np.repeat(self.first[gram] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        shared = np.bincount(np.repeat(row, count) * len(self.sets) + owner, minlength=rows * len(self.sets)).reshape(rows, -1)
        return np.flatnonzero((shared >= self.least_shared).any(axis=1))

    @staticmethod
    def window(n: int) -> int:
        return n + -(-n // 4)

    @staticmethod
    def stride(n: int) -> int:
        return max(1, n // 4)


@lru_cache(maxsize=8)
def index(templates: tuple = TEMPLATES, containment: float = CONTAINMENT) -> Index:
    return Index(templates, containment)


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(16)).astype(np.uint32)


def _minima(x: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The minimum of ``width`` values from each place (fewer at the end), for ascending widths: from minima of powers of two."""
    m, have = x, 1
    for width in widths:
        while have * 2 <= width:
            m = np.minimum(m, np.concatenate([m[have:], np.full(min(have, len(m)), 2**32 - 1, np.uint32)])[: len(m)])
            have *= 2
        shift = width - have
        yield width, np.minimum(m, np.concatenate([m[shift:], np.full(min(shift, len(m)), 2**32 - 1, np.uint32)])[: len(m)]) if shift else m


def candidates(low: np.ndarray, place: np.ndarray, idx: Index) -> list[tuple[int, np.ndarray]]:
    """(template, window starts whose bands collide with it); ``place``: the start's number in its text, -1 for padding."""
    by_width = {idx.window(n): n for n in sorted(idx.groups)}
    widths = sorted(by_width)
    starts = {n: np.flatnonzero((place >= 0) & (place % idx.stride(n) == 0)) for n in idx.groups}
    hit = {i: np.zeros(len(starts[n]), bool) for n, members in idx.groups.items() for i in members}
    for b in range(idx.bands):
        agree: dict[int, np.ndarray] = {}
        for r in range(ROWS):
            f = b * ROWS + r
            values = np.where(place >= 0, low * idx.factors[f], np.uint32(2**32 - 1))
            for width, least in _minima(values, widths):
                n = by_width[width]
                at = least if idx.stride(n) == 1 and len(starts[n]) == len(low) else least[starts[n]]
                for i in idx.groups[n]:
                    same = at == idx.least[i][f]
                    agree[i] = same if r == 0 else agree[i] & same
        for i, same in agree.items():
            hit[i] |= same
    return [(i, starts[n][hit[i]]) for n, members in idx.groups.items() for i in members]


def find(column: pa.Array, idx: Index) -> Iterator[tuple[int, int, float, int]]:
    """(row, template, containment, first word of the window) of each verified window, the best one of each row and template."""
    for a, z in steps(column):
        w = words(column.slice(a, z - a))
        h = window_hash(w.hash, SHINGLE)
        count = np.maximum(np.diff(w.ptr) - SHINGLE + 1, 0)
        if not count.sum():
            continue
        row = np.repeat(np.arange(z - a), count)
        first = np.repeat(w.ptr[:-1], count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        grams = h[first + number]
        some = idx.possible(row, grams, z - a)
        if not len(some):
            continue
        kept = np.isin(row, some)
        row, number, grams = row[kept], number[kept], grams[kept]
        # room behind each text, so that no window reaches into the next
        order = np.cumsum(np.r_[0, row[1:] != row[:-1]])
        at = np.arange(len(row)) + order * idx.widest
        size = int(at[-1]) + idx.widest + 1
        low, place, of, all_ = np.zeros(size, np.uint32), np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.uint64)
        low[at], place[at], of[at], all_[at] = _low(grams), number, row, grams
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for i, found in candidates(low, place, idx):
            width = idx.window(len(idx.sets[i]))
            for s in found.tolist():
                inside = all_[s : s + width][place[s : s + width] >= 0]
                share = float(np.isin(idx.sets[i], inside).mean())
                if share >= idx.containment - 1e-9:
                    key = (int(of[s]), i)
                    best[key] = max(best.get(key, (0.0, 0)), (share, -int(place[s])))
        for (r, i), (share, minus) in sorted(best.items()):
            yield a + r, i, share, -minus


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple, containment: float) -> Iterator[pa.RecordBatch]:
    idx = index(templates, containment)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for row, i, share, word in find(strings(batch.column("text")), idx):
            key = (row, idx.names[i])
            best[key] = max(best.get(key, (0.0, 0)), (share, -word))
        if best:
            rows = [(ids[row], name, round(share, 6), -minus) for (row, name), (share, minus) in sorted(best.items())]
            a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(c), pa.array(d, pa.int32())], ["doc_id", "license", "containment", "first_word"])


def scan(docs: DataFrame, templates: tuple = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license of which a window contains ``containment`` or more of a template's shingles: the best
    containment, and the first word (from 0) of the first window that has it.

    Words are compared in lower case without punctuation. Null and empty texts and texts of one word contain nothing; a null doc_id and
    repeated rows are scanned like others; other columns are not read. Equal containments of several templates of one license count once.
    An empty table gives no rows. No exchange.
    """
    return text_id(docs).mapInArrow(lambda batches: _scan(batches, templates, containment), SCHEMA)

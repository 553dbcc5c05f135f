"""License scans by patience alignment.

Words that occur once in a text window and once in a template are anchors; the longest run of anchors that rises in
both is kept, and the gaps between them are aligned in the same way. The share of a template's words that is
aligned is its coverage.
"""

from __future__ import annotations

import bisect
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

LEAST_PERCENT = 75  # of a template's words that an alignment must cover

#: Public notices and licence texts, by SPDX-like names.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation,
Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more
details.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1.
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object
code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of
the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
this work.""",
}

_words = regex.compile(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*").findall


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; 2.0 is one word."""
    return _words(text.lower()) if text else []


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first, whose seconds rise (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect.bisect_left(tops, b)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal words, rising in both: common ends, anchors unique to both, and the gaps between in turn."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        where = {w: at for at, w in enumerate(b[k:m], k) if cb[w] == 1}
        anchors = rising([(at, where[w]) for at, w in enumerate(a[i:j], i) if ca[w] == 1 and w in where])
        if not anchors:
            continue
        for x, y in anchors:
            stack.append((i, x, k, y))
            out.append((x, y))
            i, k = x + 1, y + 1
        stack.append((i, j, k, m))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, percent: int):
        self.name, self.words = name, words(text)
        self.counts = Counter(self.words)
        self.need = -(-percent * len(self.words) // 100)
        # An alignment of `need` words can't do without all of some words that make up more than the rest: the longest ones.
        spare = len(self.words) - self.need
        self.marks: set[str] = set()
        held = 0
        for w in sorted(self.counts, key=lambda w: (-len(w), w)):
            if held > spare:
                break
            self.marks.add(w)
            held += self.counts[w]

    def windows(self, length: int, at: list[int]):
        """Stretches of a text of so many words that hold a mark: two template lengths at steps of half of one, and one and a quarter at steps of a quarter.

        Every stretch of one and a half template lengths is within one of the first, every copy as long as the
        template within one of the second, which a copy before or after it doesn't reach into as far.
        """
        n = len(self.words)
        for wide, step in ((2 * n, max(1, n // 2)), (n + max(1, n // 4), max(1, n // 4))):
            last = -1
            for k in at:  # the steps whose window holds this mark and none before
                for s in range(max(last + 1, -(-(k - wide + 1) // step), -(wide // step)), k // step + 1):
                    lo, hi = max(0, s * step), min(length, s * step + wide)
                    if lo < hi:
                        yield lo, hi
                last = max(last, k // step)

    def best(self, text: list[str], places: dict[str, list[int]]) -> tuple[int, int, int] | None:
        """(words covered, first, end) of the best alignment that covers enough, of equal ones the first."""
        at = sorted(k for w in self.marks for k in places.get(w, ()))
        if not at or sum(min(n, len(places.get(w, ()))) for w, n in self.counts.items() if w in self.marks) + len(self.words) - sum(self.counts[w] for w in self.marks) < self.need:
            return None
        found = None
        for lo, hi in self.windows(len(text), at):
            part = text[lo:hi]
            here = Counter(part)
            if sum(min(n, here[w]) for w, n in self.counts.items() if w in here) < max(self.need, found[0] + 1 if found else 0):
                continue
            pairs = align(part, self.words)
            if len(pairs) >= self.need and (found is None or len(pairs) > found[0]):
                found = (len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1)
                if len(pairs) == len(self.words):
                    break
        return found


@lru_cache(8)
def _templates(items: tuple, percent: int) -> list[Template]:
    return [Template(name, text, percent) for name, text in items]


def scan_text(text: str | None, templates: list[Template]) -> list[tuple[str, int, int, int, int]]:
    """(name, covered, words of the template, first word, end word) of each template that a text covers enough of, the longest cover first."""
    found = words(text)
    marks = set().union(*(t.marks for t in templates)) if templates else set()
    if marks.isdisjoint(found):
        return []
    places: dict[str, list[int]] = {}
    for k, w in enumerate(found):
        if w in marks:
            places.setdefault(w, []).append(k)
    hits = [(t, t.best(found, places)) for t in templates]
    return sorted(((t.name, h[0], len(t.words), h[1], h[2]) for t, h in hits if h), key=lambda x: (-x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = LEAST_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, first_word, end_word, licenses of every row.

    license is the template of which most words are aligned (ties: by name) among those covered to `percent` or
    more, null if none is; coverage its share; licenses the sorted names of all. Word places count from 0 and the
    end is outside. An alignment is sought within two template lengths of words; whole texts are scanned, in time
    that grows with their length. Null and empty texts have none. Repeated and null ids come back as they are, equal
    texts with equal results; other columns are ignored; an empty table gives no rows.
    """
    items = tuple(sorted((templates or TEMPLATES).items()))

    def run(batches):
        t = _templates(items, percent)
        for batch in batches:
            for piece, texts in text_pieces(batch):
                hits = [scan_text(x, t) for x in texts]
                first = [h[0] if h else (None, 0, 1, None, None) for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array([f[0] for f in first], pa.string()), pa.array([f[1] / f[2] for f in first], pa.float64()),
                        pa.array([f[3] for f in first], pa.int64()), pa.array([f[4] for f in first], pa.int64()), pa.array([",".join(sorted(x[0] for x in h)) for h in hits], pa.string()),
                    ],
                    ["doc_id", "license", "coverage", "first_word", "end_word", "licenses"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, license string, coverage double, first_word long, end_word long, licenses string")

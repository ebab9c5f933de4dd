"""License scans by patience alignment.

The words that are unique in both a text and a template become anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned the same way. Coverage is
the share of the template's words that are aligned; from `least` on, the template is found.

Where it is looked for, as part of the contract:
- Templates of LONG words or more: in the whole text; in windows of 2, 4, 8, ... template lengths, each
  half over the last; and in windows of a template length and a quarter on each side around each key
  word. So a text whose alignment as a whole reaches the coverage is always found, whatever stands
  between the words, and notices that repeat are found each.
- Shorter templates (one-line notices): only in the last kind of window, as a few words scattered over a
  long text are no notice.
A template's key words are its longest, until they are more than 1 - least of its words: a text that
reaches the coverage has one of them, so texts without are skipped exactly. A window that has too few
of the template's words, whatever their order, is skipped exactly too.

Of finds that overlap, of one template or several, the one with most aligned less missing words stays,
then the shortest, the first, and the first by name: so the longer of two templates wins where one
contains the other.

Defined cases: null or empty text: no row. Very long texts are scanned whole. Repeated rows give their
rows each. Null doc_id stays. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.coded import pieces_of

LONG = 20

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)


def _gnu_notice(name: str, version: int) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


# One-line notices, whole short public license texts, and the usual notices of long ones.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    **{f"CC-{kind.upper().replace(' ', '-')}-4.0-line": f"Licensed under CC {kind.upper()} 4.0." for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")},
    "MIT": _MIT_GRANT + _AS_IS,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_TERMS + _BSD_AS_IS,
    "BSD-3-Clause": _BSD_TERMS + _BSD_NAMES + _BSD_AS_IS,
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0-or-later": _gnu_notice("GNU General Public License", 2),
    "GPL-3.0-or-later": _gnu_notice("GNU General Public License", 3),
    "LGPL-3.0-or-later": _gnu_notice("GNU Lesser General Public License", 3),
    "AGPL-3.0-or-later": _gnu_notice("GNU Affero General Public License", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def split_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of lower-cased ASCII words and numbers."""
    low = text.translate(_LOWER)
    return [(m[0], *m.span()) for m in _WORD.finditer(low)]


_LOWER = {c: c + 32 for c in range(65, 91)}


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tops, ends, before = [], [], []
    for k, p in enumerate(places):
        at = bisect_left(tops, p)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(p)
            ends.append(k)
        else:
            tops[at], ends[at] = p, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [pairs[k] for k in increasing([p for _, p in pairs])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


def key_words(template: list[str], least: float) -> set[str]:
    """The longest words that make up more than 1 - least of the template's words."""
    most, got, out = len(template) * (1 - least), 0, set()
    for w, n in sorted(Counter(template).items(), key=lambda x: (-len(x[0]), x[0])):
        out.add(w)
        got += n
        if got > most:
            break
    return out


def _windows(seeds: list[int], template: list[str], plain: list[str]) -> Iterator[tuple[int, int]]:
    """(first word, word after) of the places where a template is looked for."""
    size, n, seen = len(template), len(plain), set()
    for at in seeds:
        # The template's words that the key word may be bound the window around it.
        places = [k for k, w in enumerate(template) if w == plain[at]]
        seen.add((max(0, at - places[-1] - size // 4 - 1), min(n, at + size - places[0] + size // 4 + 1)))
    if size >= LONG:
        width = 2 * size
        while width < 2 * n:
            half = width // 2
            starts = {max(0, at // half - back) * half for at in seeds for back in (0, 1)}
            seen |= {(low, min(n, low + width)) for low in starts}
            width *= 2
        seen.add((0, n))
    yield from sorted(seen)


def scan(text: str, templates: dict[str, tuple[list[str], set[str]]], least: float) -> list[tuple[str, int, int, int, int]]:
    """(license, start, end, aligned words, template words) found in a text; start and end are code points."""
    words = split_words(text)
    plain = [w for w, _, _ in words]
    have = Counter(plain)
    found = []
    for name, (template, keys) in templates.items():
        size, need = len(template), Counter(template)
        enough = lambda bag: sum(min(n, bag[w]) for w, n in need.items()) >= least * size
        if not any(w in have for w in keys) or not enough(have):
            continue
        hits = [k for k, w in enumerate(plain) if w in need]
        for low, high in _windows([k for k in hits if plain[k] in keys], template, plain):
            inside = hits[bisect_left(hits, low) : bisect_left(hits, high)]
            if len(inside) < least * size or not enough(Counter(plain[k] for k in inside)):
                continue
            pairs = patience(plain[low:high], template)
            if len(pairs) >= least * size:
                found.append((name, words[low + pairs[0][0]][1], words[low + pairs[-1][0]][2], len(pairs), size))
    out: list[tuple[str, int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (x[4] - 2 * x[3], x[2] - x[1], x[1], x[0])):
        if all(x[2] <= y[1] or x[1] >= y[2] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def prepared(templates: dict[str, str], least: float) -> dict[str, tuple[list[str], set[str]]]:
    """Words and key words of each template that has words."""
    split = {name: [w for w, _, _ in split_words(t)] for name, t in templates.items()}
    return {name: (t, key_words(t, least)) for name, t in split.items() if t}


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, start, end, n_aligned, n_words: one row for each template found in each document."""
    known = prepared(templates, least)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_aligned", pa.int64()), ("n_words", pa.int64())])
    keys = "|".join(re.escape(k) for k in sorted(set().union(*(k for _, k in known.values())))) or "$^"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for texts in pieces_of(batch["text"]):
                part = batch.slice(a, len(texts))
                a += len(texts)
                part = part.filter(pc.fill_null(pc.match_substring_regex(pc.ascii_lower(texts), keys), False))
                out = [(d, *x) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()) for x in scan(t, known, least)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    full = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return full.mapInArrow(rows, "doc_id long, license string, start long, end long, n_aligned long, n_words long")

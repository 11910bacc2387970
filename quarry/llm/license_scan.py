"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

Text and templates are normalised to lower-case runs of ASCII letters and digits. A candidate is any run of words; its
set of distinct word bigrams ``A`` matches a template's ``B`` if ``2 |A and B| / (|A| + |B|)`` reaches ``threshold``.
Pruning is exact: ``|A|`` must lie within ``[t / (2 - t), (2 - t) / t] * |B|``, and as at least ``t / (2 - t) * |B|``
bigrams are shared, a match holds one of any ``|B| - that + 1`` bigrams of the template, its anchors; a template without
an anchor in the text, or with fewer of its bigrams in the whole text, is left out. A candidate that starts or ends with
a bigram outside ``B`` is never better than without it, so candidates start and end with bigrams of ``B``; from a start,
only words that bring a new bigram change the coefficient, and the size bound ends it, so repeated text costs no more
than other text, however long a run of words is.

Of every start the best end counts (ties: the nearest); of overlapping ones of one licence the best remains (ties: the
earliest, then the shortest). No shuffle.

Defined results: a null text is empty; rows are judged one by one, so repeated rows get equal results and a null key is
carried along; an empty table gives an empty result; other columns do not matter. Spans are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import OrderedDict
from collections.abc import Iterator
from math import ceil, floor
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Public licence texts and their customary notices.
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD-3-Clause": [
        f"{_BSD_TERMS} {_BSD_NAME}",
        f"{_BSD_TERMS} {_BSD_NAME} {_BSD_DISCLAIMER}",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "BSD-2-Clause": [_BSD_TERMS, f"{_BSD_TERMS} {_BSD_DISCLAIMER}"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}



def load_templates(folder: str) -> dict[str, list[str]]:
    """Further templates, for the parameter of ``scan``: a folder of text files named by licence, read on the driver."""
    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted(Path(folder).glob("*.txt"))}


_TOKEN = re.compile(r"[a-z0-9]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float) -> None:
        self.t, self.templates = threshold, []
        near = threshold / (2 - threshold)
        for name, texts in templates.items():
            for text in texts:
                b = bigrams(_TOKEN.findall(text.translate(_ASCII_LOWER)))
                shared = ceil(near * len(b) - 1e-9)
                anchors = sorted(b, key=lambda g: (-len(g[0]) - len(g[1]), g))[: len(b) - shared + 1]
                self.templates.append((name, b, frozenset(anchors), ceil(near * len(b) - 1e-9), floor(len(b) / near + 1e-9)))
        self.anchors: dict[tuple[str, str], list[int]] = {}
        for i, x in enumerate(self.templates):
            for g in x[2]:
                self.anchors.setdefault(g, []).append(i)
        self.pivots = sorted({max(g, key=lambda w: (len(w), w)) for g in self.anchors})

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        low = text.translate(_ASCII_LOWER)
        if not any(p in low for p in self.pivots):
            return []
        tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(low)]
        words = [t[0] for t in tokens]
        grams = list(zip(words, words[1:], strict=False))
        hits = {x for g in grams if g in self.anchors for x in self.anchors[g]}  # templates
        found: dict[str, list[tuple[float, int, int]]] = {}
        have = set(grams) if hits else set()
        wanted = [self.templates[x] for x in hits if len(have & self.templates[x][1]) >= self.templates[x][3]]
        ahead: OrderedDict[tuple[str, str], int] = OrderedDict()  # distinct bigrams by their first place from here on
        for p in range(len(grams) - 1, -1, -1) if wanted else ():
            ahead[grams[p]] = p
            ahead.move_to_end(grams[p], last=False)
            for name, b, _, least, most in wanted:
                if grams[p] not in b:
                    continue
                best, shared = (0.0, 0), 0
                for size, (g, q) in enumerate(ahead.items(), 1):
                    if size > most:
                        break
                    if g in b:
                        shared += 1
                        if shared >= least and (dice := 2 * shared / (size + len(b))) > best[0]:
                            best = (dice, q)
                if best[0] >= self.t:
                    found.setdefault(name, []).append((best[0], tokens[p][1], tokens[best[1] + 1][2]))
        out = []
        for name, matches in found.items():
            kept: list[tuple[int, int, float]] = []
            for d, s, e in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
                at = bisect_right(kept, (s, e, 2.0))
                if (not at or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
                    insort(kept, (s, e, d))
            out += [(name, d, s, e) for s, e, d in kept]
        return sorted(out, key=lambda m: (m[2], m[3], m[0]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, n_matches, best_license, best_dice, matches) of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("n_matches", T.LongType()), T.StructField("best_license", T.StringType()), T.StructField("best_dice", T.DoubleType()), T.StructField("matches", T.ArrayType(MATCH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates or TEMPLATES, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [scanner.scan(v.as_py() or "") for v in batch.column(1)]
            best = [min(f, key=lambda m: (-m[1], m[0])) if f else (None, 0.0) for f in found]
            rows = [[dict(zip(MATCH.names, m, strict=True)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array(rows, kind)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)

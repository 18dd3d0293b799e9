"""License scans by patience alignment of texts with license templates.

A text's words are aligned with a template's: words unique to both sides are anchors, their longest increasing
subsequence is kept, and the gaps between them are aligned the same way, after equal words at both ends of a gap.
Coverage is the share of the template's words that are aligned. Where a template may lie is found losslessly: at
coverage c at most (1 - c) * m of its m words are missing, so one of any floor((1 - c) * m) + 1 of its word positions
is there; the positions of the longest words are looked up in the text, and a window around each hit is aligned.
The phrases that name a license and its version must be in the text whole, whatever the coverage: a template with such
phrases is looked up by them, and only what stands between them is aligned.

Defined results: null and empty texts have no license and give no row; repeated rows each get their rows; texts are
scanned whole, whatever their length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
#: Statements and notices of public licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Whole texts of short licenses, without their copyright lines.
TEMPLATES["MIT"].append(
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
TEMPLATES["ISC"].append(
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
TEMPLATES["BSD-2-Clause"].append(
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
)
TEMPLATES["Zlib"] = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
]
#: Phrases that name a license: a template that holds one is found only where the phrase stands whole.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License, Version 2.0"],
    "BSD-3-Clause": ["Neither the name"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    "Unlicense": ["public domain"],
}
#: Phrases that tell another license where one of them stands in the hit or in the AFTER words that follow it.
OTHERS = {"BSD-2-Clause": ["Neither the name", "All advertising materials"], "BSD-3-Clause": ["All advertising materials"]}
AFTER = 150


def _add(license: str, names: list[str], texts: list[str], identifiers: tuple[str, ...] = ()) -> None:
    tags = [f"SPDX-License-Identifier: {x}" for x in (license, *identifiers)]
    NAMES.setdefault(license, []).extend(names + tags)
    TEMPLATES.setdefault(license, []).extend(texts + tags)


for _l, _names in {
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"], "MIT": [], "ISC": ["ISC License"], "Unlicense": ["The Unlicense"], "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"], "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"], "0BSD": ["BSD Zero Clause License"],
}.items():
    _add(_l, _names, [f"Licensed under the {x}." for x in _names])
for _l, _name, _versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
    for _v in _versions:
        _id = f"{_l}-{_v if '.' in _v else _v + '.0'}"
        _said = [x for v in dict.fromkeys((_v, _v if "." in _v else _v + ".0")) for x in (f"{_name}, version {v}", f"{_name} v{v}", f"{_name} {v}")]
        _terms = f"is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
        _add(_id, [_name, f"version {_v}", *_said], [f"{lead} under the {x}." for x in _said for lead in ("This work is licensed", "Licensed")] + [f"This program {_terms}"], (f"{_id}-only", f"{_id}-or-later", f"{_id}+"))
for _kind, _long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _said = [f"CC {_kind} {_v}", f"CC-{_kind}-{_v}", f"Creative Commons {_long} {_v}"]
        _add(f"CC-{_kind}-{_v}", _said, [f"Licensed under {_said[0]}.", f"Licensed under {_said[1]}.", f"Licensed under the {_said[2]} International License."])
_add("CC0-1.0", ["CC0 1.0"], ["Licensed under CC0 1.0.", "CC0 1.0 Universal"])
#: Short names, which count only behind "licensed under" whole.
for _l, _names in {
    "Apache-2.0": ["Apache 2.0"], "MPL-2.0": ["MPL 2.0"], "EPL-2.0": ["EPL 2.0"], "GPL-2.0": ["GPLv2", "GPL v2", "GNU GPL version 2"], "GPL-3.0": ["GPLv3", "GPL v3", "GNU GPL version 3"], "LGPL-2.1": ["LGPLv2.1", "LGPL v2.1"], "LGPL-3.0": ["LGPLv3", "LGPL v3"], "AGPL-3.0": ["AGPLv3", "AGPL v3"],
}.items():
    _add(_l, _names, [f"{lead} under {the}{x}." for x in _names for lead in ("Licensed", "Released", "Distributed") for the in ("", "the ")])
#: The title lines of whole license texts.
for _l, _title in {
    "GPL-2.0": "GNU General Public License Version 2, June 1991", "GPL-3.0": "GNU General Public License Version 3, 29 June 2007", "LGPL-2.1": "GNU Lesser General Public License Version 2.1, February 1999", "LGPL-3.0": "GNU Lesser General Public License Version 3, 29 June 2007",
    "AGPL-3.0": "GNU Affero General Public License Version 3, 19 November 2007", "Apache-2.0": "Apache License Version 2.0, January 2004", "MPL-2.0": "Mozilla Public License Version 2.0", "MIT": "The MIT License", "ISC": "The ISC License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-2-Clause": "BSD 2-Clause License",
}.items():
    TEMPLATES[_l].append(_title)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], rising in both: patience alignment of whole sequences."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b[w] == 1}
        pairs = [(where[w], j) for j, w in enumerate(b[b0:b1], b0) if w in where]
        if not pairs:
            continue
        # longest increasing subsequence of the positions in a, by piles
        tops, top_at, back = [], [], [-1] * len(pairs)
        for k, (i, _) in enumerate(pairs):
            p = bisect_left(tops, i)
            back[k] = top_at[p - 1] if p else -1
            tops[p : p + 1], top_at[p : p + 1] = [i], [k]
        chain, k = [], top_at[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        for (i, j), (x, y) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            if i >= a0:
                out.append((i, j))
            if i + 1 < x and j + 1 < y:
                todo.append((i + 1, x, j + 1, y))
    return sorted(out)


def _places(phrase: list[str], text: list[str], start: int, end: int) -> Iterator[int]:
    n = len(phrase)
    return (i for i in range(max(0, start), min(end, len(text)) - n + 1) if text[i] == phrase[0] and text[i : i + n] == phrase)


class Template:
    def __init__(self, name: str, text: str, coverage: float, names: list[str] = [], others: list[str] = []):
        self.name, self.words, self.coverage = name, words(text), coverage
        self.others = [words(x) for x in others]
        m = len(self.words)
        self.slack = m // 4 + 2
        #: Runs of word positions (first, end) that must be in the text whole.
        named = {j for x in names if (p := words(x)) for i in _places(p, self.words, 0, m) for j in range(i, i + len(p))}
        self.runs: list[tuple[int, int]] = []
        for j in sorted(named):
            if self.runs and self.runs[-1][1] == j:
                self.runs[-1] = (self.runs[-1][0], j + 1)
            else:
                self.runs.append((j, j + 1))
        #: Positions of which at least one is in any text that covers enough of the template.
        self.keys: dict[str, list[int]] = {}
        if self.runs:
            first = max(range(*self.runs[0]), key=lambda j: (len(self.words[j]), -j))
            self.keys[self.words[first]] = [first]
            return
        need = min(m, int((1 - coverage) * m + 1e-9) + 1)
        for j in sorted(range(m), key=lambda j: (-len(self.words[j]), j))[:need]:
            self.keys.setdefault(self.words[j], []).append(j)

    def _around(self, text: list[str], at: int) -> list[tuple[int, int]]:
        """Pairs of an alignment in which the first run stands at word `at` of the text, each next one where it comes next."""
        m, (a, b) = len(self.words), self.runs[0]
        if text[at : at + b - a] != self.words[a:b]:
            return []
        start, end = max(0, at - a - self.slack), at - a + m + self.slack
        out = [(start + i, j) for i, j in align(text[start:at], self.words[:a])]
        out += [(at + k, a + k) for k in range(b - a)]
        here, done = at + b - a, b
        for x, y in self.runs[1:]:
            i = next(_places(self.words[x:y], text, here, end), None)
            if i is None:
                return []
            out += [(here + p, done + q) for p, q in align(text[here:i], self.words[done:x])]
            out += [(i + k, x + k) for k in range(y - x)]
            here, done = i + y - x, y
        return out + [(here + p, done + q) for p, q in align(text[here:end], self.words[done:])]

    def find(self, text: list[str], places: dict[str, list[int]]) -> list[tuple[float, int, int]]:
        """(coverage, first word, words) of each place; of overlapping ones the best stays."""
        m, hits = len(self.words), []
        if self.runs:
            found = (self._around(text, i - j + self.runs[0][0]) for w, (j,) in self.keys.items() for i in places.get(w, ()) if i - j + self.runs[0][0] >= 0)
        else:
            windows = {max(0, i - j - self.slack) for w, js in self.keys.items() for i in places.get(w, ()) for j in js}
            found = ([(at + i, j) for i, j in align(text[at : at + m + 2 * self.slack], self.words)] for at in sorted(windows))
        for got in found:
            if got and len(got) >= self.coverage * m - 1e-9 and got[-1][0] - got[0][0] + 1 <= m + self.slack:
                if not any(i is not None for x in self.others for i in [next(_places(x, text, got[0][0], got[-1][0] + AFTER), None)]):
                    hits.append((len(got) / m, got[0][0], got[-1][0] - got[0][0] + 1))
        out: list[tuple[float, int, int]] = []
        for c, a, n in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(a + n <= x or a >= x + y for _, x, y in out):
                out.append((c, a, n))
        return sorted(out, key=lambda h: h[1])


def scan_texts(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """docs (doc_id, text) → one row for each document and license found: doc_id, license, coverage (the best),
    first_word and n_words (where that is), places (how many)."""
    known = [Template(name, t, coverage, NAMES.get(name, []), OTHERS.get(name, [])) for name, ts in templates.items() for t in dict.fromkeys(ts)]
    keep = {w for t in known for w in t.keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws, places = words(text or ""), {}
                if keep.isdisjoint(ws):  # lossless: a text without any of the key words covers no template
                    continue
                for i, w in enumerate(ws):
                    if w in keep:
                        places.setdefault(w, []).append(i)
                hits = [(c, a, n, t) for t in known if not places.keys().isdisjoint(t.keys) for c, a, n in t.find(ws, places)]
                best: dict[str, tuple] = {}
                taken: list[tuple[int, int]] = []
                for c, a, n, t in sorted(hits, key=lambda h: (-h[0], -len(h[3].words), h[1], h[3].name)):
                    if all(a + n <= x or a >= x + y for x, y in taken):  # of overlapping licenses the best stays
                        taken.append((a, n))
                        old = best.get(t.name)
                        best[t.name] = (c, a, n, 1) if old is None else (*old[:3], old[3] + 1)
                out += [(doc, name, *row) for name, row in sorted(best.items())]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.record_batch([pa.array(v, t) for v, t in zip(cols, (b.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "coverage", "first_word", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, first_word long, n_words long, places long")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

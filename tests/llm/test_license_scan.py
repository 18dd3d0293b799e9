import random

import pytest
from quillmill.llm import license_scan as ls


def test_alignment_is_increasing_and_finds_insertions():
    rng = random.Random(0)
    for _ in range(200):
        b = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 30))]
        a = [w for w in b if rng.random() < 0.9]
        got = ls.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    b = [f"w{i}" for i in range(40)]
    a = b[:10] + ["new", "words"] + b[12:]
    assert len(ls.align(a, b)) == 38
    assert ls.align([], b) == [] and len(ls.align(b, b)) == 40


def test_documents(spark, awkward, empty):
    mit = ls.TEMPLATES["MIT"][1]
    cut = " ".join(w for i, w in enumerate(mit.split()) if i % 9)  # a ninth of the words is missing
    filler = "erent thing " * 20_000
    rows = [(1, f"x y.\nReleased under the MIT License.\nmore"), (2, f"{filler} {cut} {filler}"), (3, "license permission mit"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (7, "Released under the MIT License. released UNDER the mit license")]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "l", 1.0) for r in rows], "doc_id long, text string, license string, coverage double")
    got = {(r.doc_id, r.license): r for r in ls.scan_texts(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (6, "CC-BY-NC-4.0"), (7, "MIT")}
    assert got[1, "MIT"].coverage == 1.0 and got[1, "MIT"].first_word == 2 and got[7, "MIT"].places == 2
    assert 0.8 <= got[2, "MIT"].coverage < 1 and got[2, "MIT"].first_word >= 40_000
    assert ls.scan_texts(df).count() == len(got) + 1
    assert ls.scan_texts(awkward).count() == 0 and ls.scan_texts(empty).count() == 0


def test_look_alikes(spark):
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    bsd3 = ls.TEMPLATES["BSD-3-Clause"][0]
    lines = {
        "Released under the BSD License.": None, "Released under the MIT License.": "MIT", "Released under the ISC License.": "ISC", "Released under the mat License.": None,
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY 3.0.": "CC-BY-3.0", "Licensed under CC BY 5.0.": None, "Licensed under CC0 1.0.": "CC0-1.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under the Apache License, Version 1.1.": None, lgpl: "LGPL-2.1", lgpl.replace("2.1", "2"): None,
        lgpl.replace("Lesser", "Affero").replace("2.1", "3"): "AGPL-3.0", ls.TEMPLATES["ISC"][0]: "ISC", ls.TEMPLATES["Unlicense"][0]: "Unlicense", bsd3: "BSD-3-Clause", bsd3[: bsd3.index(" Neither")]: "BSD-2-Clause",
        "Released under the BSD 3-Clause License.": "BSD-3-Clause", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "SPDX-License-Identifier: Foo": None, "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007 Copyright": "GPL-3.0",
    }
    df = spark.createDataFrame([(f"{x}",) for x in lines], "text string").selectExpr("text as doc_id", "'some words. ' || text || ' More words' as text")
    got = {}
    for r in ls.scan_texts(df).collect():
        assert r.doc_id not in got, (r, got[r.doc_id])
        got[r.doc_id] = r.license
    assert {x: got.get(x) for x in lines} == lines


WORDINGS = {
    "GPL-3.0": ["Licensed under the GNU General Public License, version 3", "This program is distributed under the GNU General Public License v3", "released under the GPLv3."],
    "GPL-2.0": ["Released under the GNU General Public License 2.0.", "Distributed under the GNU General Public License, version 2", "Licensed under GPL v2"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1", "released under the GNU Lesser General Public License v2.1", "Distributed under the LGPLv2.1"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", "Made available under the GNU Affero General Public License v3.0", "Released under AGPLv3"],
    "EPL-1.0": ["Released under the Eclipse Public License 1.0", "Licensed under the Eclipse Public License, Version 1.0", "distributed under the Eclipse Public License v1.0"],
    "EPL-2.0": ["Released under the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, Version 2.0", "Licensed under EPL 2.0"],
    "Apache-2.0": ["Released under the Apache License, Version 2.0", "Distributed under the Apache License 2.0", "Licensed under Apache 2.0"],
    "MPL-2.0": ["Released under the Mozilla Public License 2.0", "Licensed under the Mozilla Public License, version 2.0", "Distributed under the MPL 2.0"],
    "MIT": ["Licensed under the MIT License", "Distributed under the MIT License", "Released under the MIT license!"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "Released under the Boost Software License 1.0", "Licensed under the Boost Software License 1.0"],
    None: ["the GNU General Public License is long", "Apache 2.0 serves pages", "we talk of GPL v2 here", "Licensed under the Eclipse Public License 9.0", "a public licence, version 3"],
}


def test_each_license_in_three_wordings(spark):
    rows = [(i, name, f"some words before {text} and words after it") for i, (name, text) in enumerate((n, t) for n, ts in WORDINGS.items() for t in ts)]
    got = {}
    for r in ls.scan_texts(spark.createDataFrame(rows, "doc_id long, want string, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert {i: got.get(i) for i, _, _ in rows} == {i: {name} if name else None for i, name, _ in rows}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_repeated_notices_are_all_counted(spark, n):
    rows = [(1, "x " + "Released under the MIT License. " * n), (2, (ls.TEMPLATES["BSD-2-Clause"][0] + ". ") * n), (3, ("some words " + ls.TEMPLATES["ISC"][0] + " ") * n)]
    got = {r.doc_id: (r.license, r.places) for r in ls.scan_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", n), 2: ("BSD-2-Clause", n), 3: ("ISC", n)}


def test_whole_texts_are_known(spark):
    rows = [(i, name, "Copyright 2020 somebody " + max(ls.TEMPLATES[name], key=len) + " and more words") for i, name in enumerate(["MIT", "ISC", "BSD-2-Clause", "Zlib", "BSD-3-Clause"])]
    got = {r.doc_id: r.license for r in ls.scan_texts(spark.createDataFrame(rows, "doc_id long, want string, text string")).collect()}
    assert got == {i: name for i, name, _ in rows}


def test_every_window_is_seen():
    """Where a template is cut short or a few words differ, looking at every window finds nothing that the key words miss."""
    rng = random.Random(2)
    for name in ("MIT", "ISC", "BSD-2-Clause", "GPL-3.0"):
        for t in ls.TEMPLATES[name][:2]:
            m = ls.Template(name, t, 0.8, ls.NAMES.get(name, []), ls.OTHERS.get(name, []))
            for _ in range(6):
                ws = ls.words(t)
                for _ in range(rng.randint(0, max(1, len(ws) // 4))):
                    ws[rng.randrange(len(ws))] = f"other{rng.randint(0, 99)}"
                text = [f"w{i}" for i in range(9)] + ws + [f"v{i}" for i in range(9)]
                at = {}
                for i, w in enumerate(text):
                    at.setdefault(w, []).append(i)
                best = max(len(ls.align(text[i : i + len(m.words) + 2 * m.slack], m.words)) for i in range(len(text)))
                whole = all(any(text[i : i + b - a] == m.words[a:b] for i in range(len(text))) for a, b in m.runs)
                assert bool(m.find(text, at)) == (best >= 0.8 * len(m.words) - 1e-9 and whole)

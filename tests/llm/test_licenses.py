"""The license scan against a brute-force scan of all windows, on whole licence texts, nested folders and odd rows."""

import math

from lodestone.llm import licenses
from lodestone.llm.licenses import APACHE, BSD_HEAD, BSD_NAME, BSD_TAIL, MIT, TEMPLATES, forms, words_of

SCHEMA = "doc_id long, path string, text string"
PROSE = "the river ran slowly past the old mill and the miller counted sacks of flour in the evening light while his son drew water"
WRAPPED = " * Licensed under the Apache\n * License, Version 2.0\n"
FILES = [
    (1, "LICENSE", "The MIT License (MIT)\n\nCopyright (c) 2020 Some Body\n\n" + MIT),
    (2, "a/b.py", "def f(): return 1"),
    (3, "a/c/COPYING", f"Copyright 2019, One\n{BSD_HEAD}\n{BSD_NAME}\n{BSD_TAIL}"),
    (4, "a/c/d/e.txt", PROSE),
    (5, "a/c/d/f.py", "# SPDX-License-Identifier: GPL-2.0-only\n" + PROSE),
    (6, "a/c/g.java", f"/*\n{WRAPPED} */\n{PROSE}"),
    (7, "a/h.txt", f"{PROSE} {PROSE}, released under the MIT license as agreed, {PROSE}"),
    (8, "top.txt", PROSE),
    (9, "z/LICENSE.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + f"{PROSE} " * 30),
    (10, "z/y/x.c", None),
    (11, None, PROSE),
    (12, "q/r.txt", ""),
    (12, "q/r.txt", "Released under the MIT License"),
    (13, "n/notes.txt", " ".join(APACHE.split()[:60]) + " " + PROSE),
]


def cosines(text, n_docs, counts):
    """Best similarity of any window of any form's length, by brute force: (similarity, license)."""
    idf = lambda w: math.log((1 + n_docs) / (1 + counts.get(w, 0))) + 1
    known = {w for _, f in forms(TEMPLATES) for w in f}
    words, best = words_of(text or ""), (0.0, "")
    vector = lambda part: {w: part.count(w) * (idf(w) if w in known else math.log(1 + n_docs) + 1) for w in part}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for name, form in forms(TEMPLATES):
        b = vector(form)
        width = len(form) + max(1, len(form) // 8) - 1
        for i in range(len(words)):
            if (a := vector(words[i : i + width])) and a.keys() & b.keys():
                best = max(best, (sum(a[w] * b[w] for w in a.keys() & b.keys()) / norm(a) / norm(b), name))
    return best


def test_files_and_folders(spark):
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(FILES, SCHEMA)).collect()}
    assert len(got) == len(FILES)
    by_id = {k: r for (k, _), r in got.items() if k != 12}
    assert {k: r["license"] for k, r in by_id.items()} == {1: "MIT", 2: None, 3: "BSD-3-Clause", 4: None, 5: "GPL-2.0", 6: "Apache-2.0", 7: "MIT", 8: None, 9: "GPL-3.0", 10: None, 11: None, 13: "Apache-2.0"}
    assert {k for k, r in by_id.items() if r["is_file"]} == {1, 3, 9, 13}
    assert {k: (r["effective"], r["inherited_from"]) for k, r in by_id.items() if r["license"] is None} == {2: ("MIT", ""), 4: ("BSD-3-Clause", "a/c"), 8: ("MIT", ""), 10: ("GPL-3.0", "z"), 11: (None, None)}
    assert got[12, "MIT"]["is_file"] and got[12, None]["inherited_from"] == "q" and got[12, None]["n_windows"] == 0


def test_windows_against_all_windows(spark):
    docs = spark.createDataFrame(FILES, SCHEMA)
    n_docs, counts = licenses.document_frequencies(docs, sorted({w for _, f in forms(TEMPLATES) for w in f}))
    for r in licenses.scan(docs).collect():
        text = next(t for k, _, t in FILES if k == r["doc_id"] and (k != 12 or bool(t) == bool(r["license"])))
        similarity, name = cosines(text, n_docs, counts)
        if r["license"] is None:
            assert similarity < licenses.THRESHOLD
        else:  # windows of long forms start at steps, so the best start may be missed by a little
            assert 0.9 * similarity <= r["similarity"] <= similarity + 1e-6 and r["license"] == name


def test_leading_terms_lose_nothing():
    weights = {"a": 5.0, "b": 4.0, "c": 3.0, "d": 1.0}
    for counts in ({}, {"a": 9, "b": 5, "c": 1, "d": 1}):
        got = licenses.leading(weights, counts, 0.6)
        rest = sum(v * v for w, v in weights.items() if w not in got)
        assert math.sqrt(rest / sum(v * v for v in weights.values())) < 0.6
    assert licenses.leading(weights, {}, 0.6) == ["a", "b"] and got == ["c", "d", "b", "a"][: len(got)]
    assert [licenses.fewest(weights, t) for t in (0.6, 0.75, 0.95, 1.0)] == [1, 2, 3, 4]


def test_very_long_and_empty_tables(spark):
    rows = [(1, "a/b", ("license " * 3000) + "Released under the MIT License " + PROSE * 300)]
    assert licenses.scan(spark.createDataFrame(rows, SCHEMA)).first()["license"] is not None
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0

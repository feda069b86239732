"""License scan: sparse TF-IDF cosine of windows of words to headers and licence texts, then inheritance from the nearest directory."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, let, small

# Short forms by which headers name a licence, the notices that licences ask for, titles, and whole texts of the short licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", APACHE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "MIT": ["Released under the MIT License", "SPDX-License-Identifier: MIT", MIT],
    "ISC": ["SPDX-License-Identifier: ISC", ISC],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", GNU.format(name="GNU General Public License", number="3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", GNU.format(name="GNU General Public License", number="2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", GNU.format(name="GNU Lesser General Public License", number="3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", GNU.format(name="GNU Affero General Public License", number="3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": ["Released under the 2-clause BSD License", "SPDX-License-Identifier: BSD-2-Clause", f"{BSD_HEAD} {BSD_TAIL}"],
    "BSD-3-Clause": ["Released under the 3-clause BSD License", "SPDX-License-Identifier: BSD-3-Clause", f"{BSD_HEAD} {BSD_NAME} {BSD_TAIL}"],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0"],
    "Proprietary": ["Copyright, all rights reserved"],
}
THRESHOLD = 0.6
#: A text is a licence file if licensed windows cover this share of its words, or if its name says so and one window is licensed.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)[^/]*$"
BROADCAST_ROWS = 100_000


def words_of(text: str) -> list[str]:
    """alnum_words() of a Python string."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def forms(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, words_of(text)) for name, texts in sorted(templates.items()) for text in texts]


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that have each template word: counts over all whole texts, one number a template word."""
    words = F.array_intersect(alnum_words(F.col(text_col)), F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("w")).groupBy("w").count().collect()
    counts = {r[0]: r[1] for r in rows}
    return counts.pop("", 0), counts


def leading(weights: dict[str, float], counts: dict[str, int], threshold: float) -> list[str]:
    """The rarest terms of a vector without which no other vector reaches the threshold: the rest is too short, whatever stands beside it."""
    left = total = sum(v * v for v in weights.values())
    out = []
    for w in sorted(weights, key=lambda w: (counts.get(w, 0), -weights[w], w)):
        if left < threshold * threshold * total:
            break
        out.append(w)
        left -= weights[w] * weights[w]
    return out


def fewest(weights: dict[str, float], threshold: float) -> int:
    """How many different terms of a vector another one must hold at least to reach the threshold."""
    need, held = threshold * threshold * sum(v * v for v in weights.values()), 0.0
    for k, v in enumerate(sorted(weights.values(), reverse=True), 1):
        held += v * v
        if held >= need:
            return k
    return len(weights)


def rated_windows(text: Column, templates: dict[str, list[str]], n_docs: int, counts: dict[str, int], threshold: float) -> Column:
    """struct<n, found>: the number of words, and the windows as similar to a template as the threshold asks.

    found is array<struct<similarity, license, start, width>>. A window is as
    long as the template (with an eighth of slack for long ones) and lies where
    one of the template's leading terms would have it; no other can be similar
    enough. Windows with too few different terms of the template are passed
    over before the cosine. Words outside the templates weigh as much as a word
    of no document.
    """
    idf = lambda w: math.log((1 + n_docs) / (1 + counts.get(w, 0))) + 1
    listed = forms(templates)
    unknown = math.log(1 + n_docs) + 1
    anchors: dict[str, list[tuple[int, int]]] = {}
    vectors, steps, least = [], [], []
    for k, (_, words) in enumerate(listed):
        weights = {w: words.count(w) * idf(w) for w in words}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        vectors.append({w: v / norm for w, v in weights.items()})
        steps.append(max(1, len(words) // 8))
        least.append(fewest(weights, threshold))
        for w in leading(weights, counts, threshold):
            anchors.setdefault(w, []).extend((k, o) for o, x in enumerate(words) if x == w)
    # tables as one literal each, which the optimizer folds
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    weight_of = literal({w: idf(w) for w in sorted({w for _, f in listed for w in f})}, "map<string,double>")
    vector_of = literal([dict(sorted(v.items())) for v in vectors], "array<map<string,double>>")
    name_of = literal([n for n, _ in listed], "array<string>")
    width_of, step_of, least_of = (literal(x, "array<int>") for x in ([len(f) for _, f in listed], steps, least))
    terms_of, anchor_words = literal([sorted(v) for v in vectors], "array<array<string>>"), literal(sorted(anchors), "array<string>")
    # a form and an offset as one number, so that duplicates are found by hash
    places = literal({w: [(k << 32) + o for k, o in at] for w, at in sorted(anchors.items())}, "map<string,array<bigint>>")
    hint = rf"(?i)(?<![a-zA-Z0-9])(?:{'|'.join(sorted(anchors))})(?![a-zA-Z0-9])"

    def rate(words: Column) -> Column:
        def cell(code: Column, i: Column) -> Column:
            form, offset = F.shiftright(code, 32), code.bitwiseAND(F.lit((1 << 32) - 1))
            step = F.get(step_of, form.cast("int"))
            start = F.greatest(F.lit(0), i - offset)
            return F.shiftleft(form, 32) + (start - start % step)

        here = F.array_intersect(words, anchor_words)
        at = lambda held: F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.when(F.array_contains(held, w), w).alias("w"))), lambda x: x["w"].isNotNull())
        cells = F.array_distinct(F.flatten(F.transform(let(here, at), lambda x: F.transform(F.try_element_at(places, x["w"]), lambda c: cell(c, x["i"])))))

        form_of = lambda code: F.shiftright(code, 32).cast("int")
        start_of = lambda code: code.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        size_of = lambda form: F.get(width_of, form) + F.get(step_of, form) - 1

        def promising(code: Column) -> Column:
            form = form_of(code)
            return F.size(F.array_intersect(F.slice(words, start_of(code) + 1, size_of(form)), F.get(terms_of, form))) >= F.get(least_of, form)

        def window(code: Column) -> Column:
            form, start, width = form_of(code), start_of(code), size_of(form_of(code))

            def cosine(part: Column) -> Column:
                count = lambda w: F.size(F.filter(part, lambda x: x == w))
                vector = F.get(vector_of, form)
                one = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("norm"))

                def add(a: Column, w: Column) -> Column:
                    return let(count(w) * F.coalesce(F.try_element_at(weight_of, w), F.lit(unknown)), lambda v: F.struct((a["dot"] + v * F.coalesce(F.try_element_at(vector, w), F.lit(0.0))).alias("dot"), (a["norm"] + v * v).alias("norm")))

                return F.aggregate(F.array_distinct(part), one, add, lambda a: F.round(a["dot"] / F.greatest(F.sqrt(a["norm"]), F.lit(1e-9)), 9))

            return F.struct(let(F.slice(words, start + 1, width), cosine).alias("similarity"), F.get(name_of, form).alias("license"), start.alias("start"), F.least(width, F.size(words) - start).alias("width"))

        return F.struct(F.size(words).alias("n"), F.filter(F.transform(F.filter(cells, promising), window), lambda x: x["similarity"] >= threshold).alias("found"))

    return F.when(text.rlike(hint), let(alnum_words(text), rate))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per file: its own license, or that of the nearest directory above it that has a license file.

    Columns: doc_id, path, n_windows (licensed windows), license, similarity,
    is_file, effective, inherited_from (directory, '' for the top). Every word
    of the whole text counts. Null texts and paths have no license; of several
    license files in one directory the most similar counts, of equal ones the
    last by name. Rows may repeat, each is judged on its own; an empty table
    gives an empty one; other columns are ignored. Longer licences are known by
    title and notice only; ``templates`` takes others.
    """
    templates = templates or TEMPLATES
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    n_docs, counts = document_frequencies(rows, sorted({w for _, f in forms(templates) for w in f}))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)

    def verdict(rated: Column) -> Column:
        found = F.coalesce(rated["found"], F.array())
        best = F.array_max(F.transform(found, lambda x: F.struct(x["similarity"].alias("similarity"), x["license"].alias("license"))))
        covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["start"], x["start"] + x["width"] - 1)))))
        is_file = (F.size(found) > 0) & ((covered >= FILE_SHARE * rated["n"]) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
        return F.struct(F.size(found).cast("long").alias("n_windows"), best.alias("best"), F.coalesce(is_file, F.lit(False)).alias("is_file"))

    judged = let(rated_windows(F.col("text"), templates, n_docs, counts, threshold), verdict)
    # narrow rows, kept: the texts are judged once
    own = cut(rows.select("doc_id", "path", folder.alias("folder"), judged.alias("own")).select("doc_id", "path", "folder", "own.*"))
    owners = own.where("is_file AND path IS NOT NULL").groupBy("folder").agg(F.max("best").alias("of"))
    # nearest owner of each different folder, then of each file
    parts = F.split("folder", "/")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    folders = own.where("path IS NOT NULL").select("folder").distinct().select(F.col("folder").alias("of_folder"), F.explode(above).alias("folder"))
    nearest = folders.join(small(owners, BROADCAST_ROWS), "folder").groupBy("of_folder").agg(F.max(F.struct(F.length("folder").alias("depth"), F.col("folder").alias("folder"), F.col("of.license").alias("license"))).alias("up"))
    joined = own.join(small(nearest, BROADCAST_ROWS), F.col("best").isNull() & (F.col("folder") == F.col("of_folder")), "left")
    return joined.select("doc_id", "path", "n_windows", F.col("best.license").alias("license"), F.col("best.similarity").alias("similarity"), "is_file", F.coalesce("best.license", "up.license").alias("effective"), F.when(F.col("best").isNull(), F.col("up.folder")).alias("inherited_from"))

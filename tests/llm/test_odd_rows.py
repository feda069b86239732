"""Values, not only counts, for nulls, empty, long, tied and repeated rows; proximity against brute force."""

import collections
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near_duplicates, quality_rules
from lodestone.llm.common import free, small

from .test_operators import LONG, ODD, odd


def by_id(frame, *columns):
    out = collections.defaultdict(list)
    for r in frame.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_quality_rules(spark):
    got = by_id(quality_rules.judge(odd(spark)), "n_words", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got[1] == got[2] == [(0, 0, 0, True, False)] and got[4] == [(3, 0, 0, True, False)] * 2
    assert got[3] == [(20_000, 0, 20_000, True, False)] and got[None] == [(6, 0, 0, True, False)]


def test_decontamination(spark):
    docs = odd(spark)
    got = by_id(decontaminate.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text")), "n_words", "hits", "items")
    assert got[1] == got[2] == [(0, [], [])]
    assert got[4] == [(3, [0, 1, 2], [4])] * 2 and got[None][0][:2] == (6, [0, 1, 2, 3, 4, 5]) and set(got[None][0][2]) == {4, None}
    assert got[3][0][0] == 20_000 and len(got[3][0][1]) == 20_000 and got[3][0][2] == [3]


def test_near_duplicates(spark):
    got = by_id(near_duplicates.link(odd(spark)), "n_shingles", "component_id", "kept")
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[4] == [(1, 4, True)] * 2
    assert got[None] == [(2, None, True)] and got[3] == [(977, 3, True)] and len(ODD) == sum(map(len, got.values()))
    copies = near_duplicates.link(spark.createDataFrame([(9, LONG), (5, LONG), (7, LONG + " end")], "doc_id long, text string"))
    assert by_id(copies, "component_id", "kept") == {9: [(5, False)], 5: [(5, True)], 7: [(5, False)]}


def test_proximity_against_all_pairs(spark):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = {i: [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))] for i in range(25)}
    items = {i: [draw.choice(vocabulary + ["absent"] * (i == 3)) for _ in range(n)] for i, n in enumerate((1, 2, 5, 12, 14))}
    counts, slop = collections.Counter(w for d in docs.values() for w in d), 2
    want = set()
    for item, words in items.items():
        width = min(10, len(words))
        for k in range(len(words) - width + 1):
            window = words[k : k + width]
            if all(counts[w] for w in window):
                (_, a), (_, b) = (sorted((counts[w], o) for o, w in enumerate(window)) * 2)[:2]
                for doc, said in docs.items():
                    want |= {(doc, item, p) for p, w in enumerate(said) if w == window[a] for q, v in enumerate(said) if v == window[b] and abs(q - p - (b - a)) <= slop}
    table = lambda rows, key: spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], f"{key} long, text string")
    assert {tuple(r) for r in decontaminate.proximity(table(docs, "doc_id"), table(items, "item_id"), slop).collect()} == want and want


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    frame = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "a long, b string")
    hinted = lambda df: bool(re.search("broadcast", df._jdf.queryExecution().logical().toString()))
    assert hinted(small(frame, 20)) and not hinted(small(frame, 19)) and not hinted(small(frame, 20, 500))
    assert free("n", ["a", "N", "n_"]) == "n__" and free("x", ["a"]) == "x"

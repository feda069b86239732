"""Divergence of sources, the mix of sources and ranked search: against plain computations, on odd rows and on hot groups."""

import bisect
import collections
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, mixing, ranking
from lodestone.llm.queries import ORACLE, QUERIES

from .test_operators import DATA, LONG, ODD, odd

NAMES = ("op11_divergence", "op12_mix", "op13_search")
SOURCED = "doc_id long, text string, lang string, source string"


def against(spark, name, documents, benchmark=None):
    """Rows of an operator and of its SQL over the same tables."""
    run = {"op11_divergence": divergence.audit, "op12_mix": lambda d: mixing.Mix(d).taken(), "op13_search": lambda d: ranking.search(d, benchmark)}[name]
    con = duckdb.connect()
    con.register("documents", documents.select(*[c for c in ("doc_id", "text", "lang", "source") if c in documents.columns]).toArrow())
    if benchmark is not None:
        con.register("benchmark", benchmark.select("item_id", "text").toArrow())
    want = con.sql(ORACLE[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in run(documents).collect()]
    key = lambda r: repr([r[k] for k in sorted(r)])
    return sorted(got, key=key), sorted(want, key=key)


@pytest.mark.parametrize("name", NAMES)
def test_tables_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLE[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    key = lambda r: repr([r[k] for k in sorted(r)])
    assert sorted(got, key=key) == sorted(want, key=key) and got


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    """Null texts, langs, sources and ids, empty and long texts, repeated rows, clashing columns; and no rows at all."""
    docs = odd(spark).withColumn("source", F.when(F.col("doc_id") > 2, F.col("lang")))
    items = spark.createDataFrame([(1, "one two THREE one"), (2, None), (3, ""), (4, "w1 w2 é"), (None, "three six"), (6, "absent")], "item_id long, text string")
    got, want = against(spark, name, docs, items)
    assert got == want and (got or name == "op11_divergence")
    if name == "op12_mix":
        assert len(got) == len(ODD)
    empty = odd(spark, []).withColumn("source", F.lit("a"))
    assert against(spark, name, empty, items)[0] == [] and (name != "op13_search" or against(spark, name, docs, items.limit(0))[0] == [])


def corpus(draw, n, sources):
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "x1"]
    rows = []
    for i in range(n):
        source = sources[0] if draw.random() < 0.4 else draw.choice(sources)
        text = " ".join(draw.choice(words[: draw.randint(3, len(words))]) for _ in range(draw.choice((0, 1, 5, 40, 200)))) + draw.choice(("", ".", "\n"))
        rows.append((i // 2 if draw.random() < 0.1 else i, text, draw.choice(["en", "en", "fr"]), source))
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_hot_source_against_sql(spark, name):
    rows = corpus(random.Random(3), 120, ["s0", "s1", "s10", "s2", None, ""])
    docs = spark.createDataFrame(rows, SOURCED)
    items = spark.createDataFrame([(i, t) for i, (_, t, _, _) in enumerate(rows[:25])], "item_id int, text string")
    got, want = against(spark, name, docs, items)
    assert got == want


def test_pairs_dealt_out_in_squares(spark, monkeypatch):
    """Many sources of one language, in several shards and squares, give what one square gives."""
    docs = spark.createDataFrame(corpus(random.Random(4), 150, [f"s{i}" for i in range(9)]), SOURCED)
    want = sorted(map(tuple, divergence.audit(docs).collect()))
    for k, v in (("SIDE", 3), ("SHARD_ROWS", 40), ("SHARD_BYTES", 4000)):
        monkeypatch.setattr(divergence, k, v)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want and any(t[2] == "term" for t in want)


def test_the_schedule_is_a_mix(spark, monkeypatch):
    """Slots go to sources as their targets ask, in every stretch; blocks are equal; no word is taken over three times; reruns agree."""
    monkeypatch.setattr(mixing, "RUN", 16)
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "big" if i % 3 else f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, SOURCED)
    mix = mixing.Mix(docs, block=8)
    goal = {r["source"]: r["goal"] for r in mix.sources.collect()}
    placed = mix.schedule().collect()
    slots = collections.defaultdict(int)
    for r in placed:
        slots[r["slot"], r["source"]] += r["words"]
    for source, n in goal.items():
        mine = [w for (_, s), w in slots.items() if s == source]
        assert sum(mine) == n and sorted(mine)[1:] == [8] * (len(mine) - 1), source
    assert len({s for s, _ in slots}) == len(slots)
    # each stretch of the schedule holds a source's share to within two slots
    order = sorted(slots)
    top = max(s for s, _ in order)
    for source in goal:
        mine = sorted(s for s, x in order if x == source)
        for a, b in ((0, top // 4), (top // 3, top // 2), (top // 5, top)):
            held = bisect.bisect_left(mine, b) - bisect.bisect_left(mine, a)
            assert abs(held - len(mine) * (b - a) / (1 << top.bit_length())) <= 4, source
    taken = {r["doc_id"]: r for r in mix.taken().collect()}
    assert all(r["taken"] <= 3 * r["size"] for r in taken.values()) and {k: r["taken"] for k, r in taken.items()} == {r["doc_id"]: r["taken"] for r in mixing.Mix(docs.repartition(3), block=8).taken().collect()}
    assert sum(r["taken"] for r in taken.values()) == sum(goal.values())


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1, "c": 5, "d": 100, "e": 0, None: 4}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    weights, total = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3], strict=True)), sum(sizes.values())
    full: dict = {}
    while True:  # share, cap, and share the excess again
        rest = total - sum(full.values())
        share = {k: rest * w / sum(x for y, x in weights.items() if y not in full) for k, w in weights.items() if k not in full}
        over = {k: 3.0 * sizes[k] for k, v in share.items() if v > 3 * sizes[k]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(full | share) and math.isclose(sum(got.values()), total)


def test_wand_against_all_scores():
    draw = random.Random(7)
    for _ in range(200):
        lists, scores = [], collections.Counter()
        for _ in range(draw.randint(1, 8)):
            docs = sorted(draw.sample(range(60), draw.randint(1, 40)))
            impacts = [draw.randint(0, 9) for _ in docs]
            scores.update(dict(zip(docs, impacts, strict=True)))
            lists.append((docs, impacts, max(impacts)))
        k, least = draw.randint(1, 12), draw.choice((0, 5, 12))
        want = sorted(((s, d) for d, s in scores.items() if s >= max(least, 1)), key=lambda x: (-x[0], x[1]))[:k]
        assert ranking.best(lists, k, least) == want


def test_search_in_passes_and_shards(spark, monkeypatch):
    """Items in several passes, another seed, ids of strings: the same ranks."""
    rows = [(f"d{i:03}", f"{LONG[: 400 + 30 * (i % 50)]} w{i % 90} w{i % 7}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    items = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w{2 * i}, w{i}") for i in range(40)], "item_id string, text string")
    want = sorted(map(tuple, ranking.search(docs, items, 5).collect()))
    monkeypatch.setattr(ranking, "ITEM_TERMS", 20)
    monkeypatch.setattr(ranking, "SEED_SHARE", 3)
    assert sorted(map(tuple, ranking.search(docs, items, 5).collect())) == want and len(want) == 200 and want[0][1] == 1

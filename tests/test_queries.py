"""Each query with SQL against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from lodestone import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def value(v):
    if isinstance(v, (bool, str)):
        return str(v)
    if v is None or v is pd.NaT or pd.isna(v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float, Decimal)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)


def rows(frame):
    return sorted(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_against_sql(spark, duck, key):
    got, want = queries.QUERIES[key](spark, DATA).toPandas(), duck.execute(queries.ORACLE[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_clusters_are_greedy_and_complete(spark):
    """Each card joins the first group of its block all of whose members it matches; pairs are those of the SQL query above."""
    cards = queries.blocks(spark, DATA).select("id", "lang", "source").toPandas().sort_values("id")
    near = {tuple(r) for r in queries.dedup_pairs(spark, DATA).collect()}
    want, groups = {}, {}
    for r in cards.itertuples():
        held = groups.setdefault((r.lang, r.source), [])
        mine = next((g for g in held if all((m, r.id) in near for m in g)), None)
        if mine is None:
            held.append(mine := [])
        mine.append(r.id)
        want[r.id] = mine[0]
    assert dict(map(tuple, queries.dedup_clusters(spark, DATA).collect())) == want
    assert 1 < len(set(want.values())) < len(want)


def test_candidates_of_similar_texts_against_all_pairs(spark):
    import random

    from lodestone.operators import clusters

    draw, rows, base = random.Random(1), [], [f"s{i}" for i in range(60)]
    for i in range(40):
        own = [x if draw.random() > 0.08 else f"x{i}{x}" for x in base] if i % 2 else [f"y{i}{j}" for j in range(30)]
        rows.append((i, "k", f"title {i % 7}", ["title", str(i % 7)], own))
    table = spark.createDataFrame(rows, "id int, k string, title string, tokens array<string>, shingles array<string>")
    dice = lambda a, b: 2 * len(set(a) & set(b)) / (len(a) + len(b))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[2] == b[2] or dice(a[4], b[4]) >= 0.88)}
    assert {(r["a"], r["b"]) for r in clusters.candidates(table, ["k"]).collect()} == want
    assert any(a % 2 and b % 2 and a % 7 != b % 7 for a, b in want)

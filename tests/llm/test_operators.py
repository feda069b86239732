"""Operators against brute force on small tables, and on nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language, licenses, near_duplicates, pieces, pii, quality_model, quality_rules, substrings, wrappers
from lodestone.llm.queries import PIECES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
ODD = [(1, None, "a"), (2, "", "b"), (3, LONG, None), (4, "one two three", "a"), (4, "one two three", "a"), (None, "one two three four five six", "a"), (7, "Mr John Smith wrote to a@b.org from 10.0.0.1. 🙂", "b")]
SCHEMA = "doc_id long, text string, lang string"


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def odd(spark, rows=ODD):
    """Odd rows with extra columns named as the operators' own."""
    extra = ("words", "rep", "key", "band", "n", "term", "pos", "seg", "sig", "lines", "quality", "item_id", "kept", "url")
    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit("x") for k in extra})


OPERATORS = {
    "quality_rules": lambda d: quality_rules.judge(d),
    "decontaminate": lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "substrings": lambda d: substrings.deduplicate(d),
    "pii": lambda d: pii.pseudonymise(d, "k"),
    "quality_model": lambda d: quality_model.score(d, quality_model.train(d)),
    "licenses": lambda d: licenses.scan(d.select("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), "text")),
    "language": lambda d: language.predict(d, language.train(d, "doc_id", "text", "lang")),
    "near_duplicates": lambda d: near_duplicates.link(d),
    "pieces": lambda d: pieces.encode(d, PIECES),
    "wrappers": lambda d: wrappers.main_text(d.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_count(spark, name):
    assert OPERATORS[name](odd(spark)).count() == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](odd(spark, [])).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_base_rules(docs, texts):
    for r in quality_rules.judge(docs).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marked = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(marked) > 20 * len(w)) and not (r["kept"] and r["base_failed"])


def test_contamination(spark, docs, texts):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = split(r["text"] or "")
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(r["item_id"])
    sizes = {len(k) for k in windows}
    for r in decontaminate.contamination(docs, items).collect():
        w, hit, found = split(texts[r["doc_id"]]), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[i : i + k])):
                    found |= ids
                    hit.update(range(i, i + k))
        assert (r["n_words"], len(r["hits"]), set(r["items"])) == (len(w), len(hit), found)


def test_repeated_bytes(docs, texts):
    seen, want = set(), {}
    for key in sorted(texts):
        b = texts[key].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if (s := b[i : i + 100]) in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[key] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.deduplicate(docs).collect()} == want


def components_by_hand(texts):
    sets = {}
    for key, t in texts.items():
        w = WORD.findall(low(t))
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root, before = {k: k for k in sets}, None
    while root != before:
        before = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


def test_near_duplicates(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.link(docs).collect()}
    assert got == components_by_hand(texts)


def test_family_of_edited_copies_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    draw = random.Random(5)
    base, family = [f"w{i}" for i in range(120)], {}
    for key in range(90):
        edited = list(base) if key % 3 else [*family[key - 1].split()] if key else list(base)
        for at in draw.sample(range(120), draw.randint(1, 5)):
            edited[at] = f"x{key}y{at}"
        family[key] = " ".join(edited)
    want = components_by_hand(family)
    assert 2 < len({c for _, c, _ in want.values()}) < 90
    docs = spark.createDataFrame([(k, t, None) for k, t in family.items()], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.link(docs).collect()}
    assert got == want


def test_language_on_held_out_documents(docs):
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language.predict(docs, language.train(docs.where(~out), "doc_id", "text", "lang")).where(out).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.95


def test_surrogates_are_consistent_and_distinct(spark):
    rows = [(1, "mail a@b.org and c@d.org", "en"), (2, "mail a@b.org now", "en"), (3, "nothing here", "en")]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    first, second = re.findall(r"\S+@\S+", got[1])
    assert first != second and "a@b.org" not in got[1] and re.findall(r"\S+@\S+", got[2]) == [first] and got[3] == "nothing here"

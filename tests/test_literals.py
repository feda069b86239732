"""Words that patterns need: none that a pattern can do without, and patterns without theirs are not tried (F6 of round 4)."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import segments
from lodestone.functions.literals import Words, needed
from lodestone.operators import engine
from lodestone.operators import lexicon as lex


@pytest.mark.parametrize(
    "pattern, words",
    [("abc|xyz", {"abc", "xyz"}), ("(?:ab)?cde", {"cde"}), ("ab.{0,9}(?:mdl|usd)", {"mdl", "usd"}), ("intern(?:ship)?", {"intern"}), ("ab|c", None), ("[ab]c", None), ("(?i)abc", None), (r"(?<![\p{L}\p{N}])(?:c\+\+)(?!\p{L})", {"c++"}), ("x*", None), ("(?:tests?|exams?) needed", {" needed"})],
)
def test_needed(pattern, words):
    assert needed(pattern) == (words and frozenset(words))


def test_standing_finds_words_over_each_other(spark):
    words = Words(["abcd", "abx|bcd", "c# code", "c# yes", "опыт", *(f"{c}{c}q" for c in "defghijklm")])
    texts = ["abcd c# codes", "xabxbcd", "нетопыт", "ddq mmq", "", "ab c#"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words.standing(F.col("t")).alias("w")).collect()
    assert {r.t: {*r.w} for r in rows} == {t: {w for w in words.words if w in t} for t in texts}


def test_gated_patterns_find_what_they_found(spark):
    """Each pattern of the engine, with and without its gate, on texts made of pieces of the patterns themselves."""
    known = [*engine._SAID, *engine._DUTIES, *(engine.phrase(p) for p in lex.SKILLS.values())]
    pieces = [re.sub(r"\[[^\]]*\]\*?|\(\?:|[()\\?*]|\.\{[^}]*\}|\{[^}]*\}", "", x) for p in known for x in p.split("|")]
    texts = ["", *pieces, *(f"3 {a} {b}" for a, b in zip(pieces, pieces[7:]))]
    words = Words(known)
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", words.standing(F.col("t"))).localCheckpoint()
    plain = d.select(*[engine.said(F.col("t"), p).alias(str(i)) for i, p in enumerate(known)]).collect()
    gated = d.select(*[words.when(F.col("w"), p, engine.said(F.col("t"), p)).alias(str(i)) for i, p in enumerate(known)]).collect()
    assert plain == gated and all(any(r[i] for r in plain) for i in range(len(lex.SKILLS)))


def test_engine_gates_its_patterns(spark):
    assert all(map(needed, [*engine._SAID, *engine._DUTIES, *segments.HEADERS.values()]))
    d = spark.createDataFrame([("a", "b", "c", "d", "e", "f", "open")], "title string, text string, location string, work_mode string, schedule string, description_quality string, availability string")
    plan = engine.evaluate(d).select("quality_flags")._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap(_words" in plan

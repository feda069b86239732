"""Findings on work that was done more often than once a row."""

from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import folding, segments, text
from lodestone.operators import clusters

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_look_up_tables_are_not_cut_anew_for_each_piece(spark):
    d = spark.createDataFrame([("ﬁx №5 ½ ㎏ ǆ Привет, “x” … ﷺ",), ("ΌΣΟΣ Øre ½",), ("",)], "t string")
    assert "lambdafunction(split(lambda" not in plan(d.select(folding.folded(F.col("t"))))
    for before, after in d.select("t", folding.folded(F.col("t"))).collect():
        assert after == folding.fold(before)


def test_headers_are_looked_for_in_plain_letters_first(spark):
    """Marked forms are tried on characters outside ASCII only, and texts without a header are told by a plain copy."""
    assert segments.accented("a").startswith("(?:a|(?!\\p{ASCII})[a")
    bodies = ["Intro\nRESPONSABILITĂȚI:\nscrie cod\nCerinţe: SQL", "ОБЯЗАННОСТИ:\nкод", "x" * 50, "no header. requirement", "İn\nBENEFICII\nceai"]
    d = spark.createDataFrame([(b,) for b in bodies], "t string")
    found = d.select(segments.sections(F.col("t")).alias("s"), segments.plain(F.col("t")).alias("p")).collect()
    assert [(r.s.intro, r.s.responsibilities, r.s.requirements, r.s.benefits) for r in found] == [("Intro", "scrie cod", "SQL", ""), ("", "код", "", ""), ("", "x" * 50, "", ""), ("", "no header. requirement", "", ""), ("İn", "", "", "ceai")]
    assert [len(r.p) for r in found] == [len(b) for b in bodies]


def test_titles_cut_the_first_line_once(spark):
    assert plan(queries.title_forms(spark, DATA)).count("coalesce(text") == 1


def test_folding_binds_a_costly_text(spark):
    d = spark.createDataFrame([("Ă b",)], "t string")
    assert plan(d.select(text.normalize(F.reverse("t")).alias("x"))).count("reverse(") == 1


def test_hashes_are_sent_for_pairs_of_similar_titles_only(spark, monkeypatch):
    sent, plain = {}, clusters._beside
    monkeypatch.setattr(clusters, "_beside", lambda pairs, side, column: sent.update({column: {tuple(r) for r in pairs.collect()}}) or plain(pairs, side, column))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, "a b c d", words), (2, "x y z", words), (3, "a b c e", words[1:]), (4, "q", ["other"] * 1 + words[40:])]
    cards = spark.createDataFrame([(i, "en", t, t.split(), s) for i, t, s in rows], "id long, lang string, title string, tokens array<string>, shingles array<string>")
    assert {tuple(r) for r in clusters.pairs(cards, ["lang"]).collect()} == {(1, 3)}
    assert sent["tokens"] >= {(1, 2), (1, 3), (2, 3)} and sent["hashes"] == {(1, 3)}

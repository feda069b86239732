"""Behaviour of text, page, rule and state operators on small rows."""

import datetime as dt
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from lodestone.functions import facts, html, segments, text
from lodestone.operators import clusters, engine, lexicon, search, state, status
from lodestone.plans import analysis
from lodestone.sources import sites, versions
from lodestone.streaming import ingest


def one(spark, value, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)) if columns else spark.range(1)
    return frame.select(value.alias("x")).first()["x"]


def test_folding_of_every_character(spark):
    """Each assigned character by itself against Unicode's own normal forms."""
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    frame = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string").repartition(4)
    got = {r[0]: r[1] for r in frame.select("code", text.normalize(F.col("c"))).collect()}
    after_latin = regex.compile(r"(\p{Script=Latin})\p{M}+")

    def want(c):
        out = unicodedata.normalize("NFC", after_latin.sub(r"\1", unicodedata.normalize("NFKD", c))).lower()
        return out.translate(dict(zip(map(ord, "‘’–— "), "''-- ", strict=True)))

    assert {hex(c): (got[c], want(chr(c))) for c in codes if got[c] != want(chr(c))} == {}
    said = {"ﬁnance ½ № Ｆｕｌｌ": "finance 1⁄2 no full", "И\u0306од е\u0308ж": "йод ёж", "e\u0301\u0302t": "et", "Straße ĲSSEL": "straße ijssel", "“a” … 🙂": "“a” ... 🙂", "각 가": "각 가"}
    assert {k: one(spark, text.normalize(F.lit(k))) for k in said} == said


def test_normalize_keeps_marks_of_other_scripts(spark):
    assert one(spark, text.normalize(F.col("t")), t="ÉTÉ Ёй \u2018a\u2019 \u2013\u00a0b") == "ete ёй 'a' - b"
    assert one(spark, text.clean(F.col("t")), t=" a\u00a0 \tb \n\n\n\n c ") == "a b\n\nc"
    assert one(spark, text.normalize(F.col("t")), t=None) == ""


def test_names_and_links(spark):
    names = {"ICS Foo S.R.L.": "foo", "OCN Bar SA": "bar", "O.C.N. Gama": "gama", "Inc SC Ltd": "inc sc ltd", "SRL Beta": "srl beta", "Alfa SRL": "alfa"}
    assert {k: one(spark, text.company(F.lit(k))) for k in names} == names
    assert one(spark, text.company(F.lit("SRL Alfa Beta, Ltd"), ("srl ",), (" ltd",))) == "alfa beta"
    valid = {"Top angajator 2024": None, "Telegram": "Telegram", "N/A": None, "+373 22 1": None, " A\n B ": "A B", "x" * 151: None, "LinkedIn": None}
    assert {k: one(spark, text.valid_company(F.lit(k))) for k in valid} == valid


def test_titles_that_differ_stay_apart(spark):
    titles = {
        ("Developer (Python)", ""): "developer python", ("Developer (Java)", ""): "developer java", ("Tester (Alfa SRL)", "Alfa"): "tester alfa srl", ("Tester (Alfa)", "Alfa SRL"): "tester", ("Tester (Chișinău)", ""): "tester", ("Tester (500 - 700 EUR)", ""): "tester",
        ("Сисадмин", ""): "system administrator", ("Administrator de sistem (сис. админ)", ""): "system administrator", ("Internship Java", ""): "internship java", ("Internship IT", ""): "it internship", ("IT Internship, Chisinau", ""): "it internship",
        ("Sysadmin (Alfa) Alfa Chisinau", "none"): "sysadmin alfa alfa", ("Operator Alfa", "ICS Alfa"): "operator", ("Alfa", "Alfa"): "alfa", ("", ""): "",
    }
    frame = spark.createDataFrame([(n, t, e) for n, (t, e) in enumerate(titles)], "n int, t string, e string")
    got = [r[0] for r in frame.orderBy("n").select(text.title(F.col("t"), F.col("e"))).collect()]
    assert got == list(titles.values())


def test_links(spark):
    link = lambda v: one(spark, text.safe_link(F.lit(v), ["example.org"], r"/job/\d+"))
    assert link("https://www.example.org/job/12/?a=1#x") == "https://example.org/job/12"
    assert link("http://example.org/job/12") is None and link("https://evil.org/job/12") is None and link("not a link") is None


def test_dice_and_shingles_of_short_texts(spark):
    assert one(spark, F.size(text.shingles(F.lit("a b c")))) == 0
    assert one(spark, text.dice(F.array(), F.array())) == 0.0


def test_sections_repeat_and_keep_the_intro(spark):
    got = one(spark, segments.sections(F.lit("Hello\nRequirements:\nSQL\nBenefits: tea\nRequirements\nGit")))
    assert (got["intro"], got["requirements"], got["benefits"], got["responsibilities"]) == ("Hello", "SQL\nGit", "tea", "")
    assert one(spark, segments.sections(F.lit("only text")))["responsibilities"] == "only text"
    got = one(spark, segments.sections(F.lit("Cerințe:\nSQL\nResponsabilități:\nWrite code\nRequirements:\nEnglish\nМы предлагаем: чай")))
    assert (got["requirements"], got["responsibilities"], got["benefits"]) == ("SQL\nEnglish", "Write code", "чай")


def test_sentences_are_unchanged_parts(spark):
    said = "Cunoașterea limbii engleze constituie un avantaj;\nОпыт работы с Nagios и т.д. является преимуществом.\nNo experience required! Use e.g. Linux. Done"
    got = one(spark, segments.sentences(F.lit(said)))
    assert got == ["Cunoașterea limbii engleze constituie un avantaj;", "Опыт работы с Nagios и т.д. является преимуществом.", "No experience required!", "Use e.g. Linux.", "Done"]


@pytest.mark.parametrize(("said", "low"), [("3+ years of experience", 3.0), ("6 months experience", 0.5), ("experience up to 1 year", 0.0), ("two years of experience", 2.0), ("опыт от 2 лет", 2.0), ("2 years experience preferred", None), ("company with 20 years of experience", None), ("", None), ("Minimum 3 yrs experience", 3.0), ("опыт не менее двух лет", 2.0), ("at least two years, or 5 years of experience", 5.0), ("mentored by people with 9 years of experience", None), ("1 year of experience (2 years preferred)", 1.0)])
def test_experience(spark, said, low):
    assert one(spark, facts.experience(F.lit(said))["minimum"]) == low


def test_salary(spark):
    pay = lambda field, body: one(spark, facts.salary(F.lit(field), F.lit("t"), F.lit(body)))
    assert pay("500", "") == "500" and pay(None, "Salary: 900 EUR net") == "900 EUR" and pay(None, "salary after internship 900 EUR") == ""
    assert pay(None, "Salary: EUR 500") == "EUR 500" and pay(None, "Remunerare: 9000 lei") == "9000 lei" and pay(None, "Salary: 500 - 700 EUR") == "500 - 700 EUR"
    assert pay(None, "Payment terms: invoices over 900 EUR") == "" and pay(None, "Salariu de la 9 000 lei") == "de la 9 000 lei" and pay(None, "Salary:\nJunior: 300 EUR\n500 EUR;\nbonus") == "Junior: 300 EUR; 500 EUR"


def case(spark, **given):
    row = {"title": "Junior QA tester", "text": "We test web applications with our team. " * 4 + "No experience required.", "location": "Chisinau", "work_mode": None, "schedule": None, "description_quality": "verified", "availability": "open"} | given
    return engine.evaluate(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))).first()


def test_rule_engine_decides(spark):
    got = case(spark)
    assert (got["category"], got["entry_fit"], got["status"], got["fit_score"]) == ("QA & Testing", "beginner", "active", 90)
    assert "No Experience Required" in got["tags"] and "No Experience Required" in got["tag_evidence"]
    assert all(q["text"] in "No experience required." for q in got["tag_evidence"]["No Experience Required"])
    assert case(spark, title="Office manager", text="Papers and calls. " * 9)["exclusion_reason"] == lexicon.EXCLUDED["unrelated"]
    assert case(spark, location=None)["entry_fit"] == "review"
    assert case(spark, availability="closed")["exclusion_reason"] == lexicon.EXCLUDED["closed"]
    assert case(spark, text="We need 3 years of experience with tests. " * 4)["exclusion_reason"] == lexicon.EXCLUDED["experience"]
    assert case(spark, text=None, title=None)["status"] == "excluded"


def details(spark, page, as_of="2021-01-01"):
    found = sites.details(spark.createDataFrame([("page", page)], "source string, html string"), {"page": sites.GENERIC})
    return found.select("*", sites.closed(F.expr(f"TIMESTAMP '{as_of}'")).alias("shut")).first()


PAGE = '<html><title>T</title><nav><a href="/n">n</a></nav><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"QA","hiringOrganization":{"name":"Alfa"},"validThrough":"2020-01-01"}]}</script><main><p>%s</p></main></html>'


def test_pages(spark):
    page = PAGE % ("word " * 30)
    got = details(spark, page)
    assert (got["title"], got["company"], got["error"]) == ("QA", "Alfa", None)
    assert one(spark, html.html_to_text(F.col("p")), p=page).startswith("word word")
    assert details(spark, "<p>x")["error"] == "description too short"
    shut = got["shut"]
    assert shut["closed"] and shut["reason"] == "posting expired"
    assert one(spark, html.html_to_text(F.col("p")), p=None) == ""


def test_fields_and_notices_of_pages(spark):
    advert = "<div class='vacancy-content'>" + "duties of the role " * 10 + "</div>"
    labelled = "<div><span class='text-muted3'>Oraș:</span><b>Bălți</b></div><div><span class='text-muted3'>Salariu:</span> <b>900 EUR</b></div>" + advert
    got = details(spark, labelled)
    assert (got["location"], got["salary"], got["error"], got["notice"]) == ("Bălți", "900 EUR", None, None)
    listed = "".join(f"<li class='vacancy-summary-item-mobile'>{x}</li>" for x in ("Chișinău", "no", "day", "any", "office")) + "<p class='vacancy-salary'>5 lei</p>" + advert
    got = details(spark, listed)
    assert [got[k] for k in ("location", "experience", "schedule", "education", "work_mode", "salary")] == ["Chișinău", "no", "day", "any", "office", "5 lei"]
    notice = lambda p: details(spark, p)["notice"]
    assert notice("<div role='alert'>Acest anunț a expirat</div>" + advert) == "Acest anunț a expirat"
    assert notice("<main>Vacancy not found</main>") == "Vacancy not found"
    assert notice("<p>This job is closed</p>" + advert) is None and notice("<aside><h2>This job is closed</h2></aside>" + advert) is None
    assert notice("<div style='display: none'><h1>Вакансия закрыта</h1></div>" + advert) is None


def test_plain_values_are_not_parsed(spark):
    assert one(spark, html.text_of(F.col("t")), t="a < b & c") == "a < b & c" and one(spark, html.text_of(F.col("t")), t="<b>a</b> &amp; c") == "a & c"
    assert one(spark, html.text_of(F.col("t")), t=None) == ""


def test_search_rejects_unknown_values(spark):
    with pytest.raises(ValueError):
        search.search(spark.range(1).toDF("fit"), fit="nobody")
    assert search.search(spark.createDataFrame([(["a"],)], "tags array<string>"), tags=[]).count() == 1


def test_upsert_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, "a", 9, 0), (2, "b", 9, 0)], "k int, title string, v int, seen int")
    b = spark.createDataFrame([(2, "B", 1), (3, "c", 1)], "k int, title string, seen int")
    first = state.upsert(t, b, "k", "seen", "title", "v")
    assert sorted(map(tuple, first.collect())) == [(1, "a", 9, 0), (2, "B", 0, 1), (3, "c", 0, 1)]
    assert sorted(map(tuple, state.upsert(first, b, "k", "seen", "title", "v").collect())) == sorted(map(tuple, first.collect()))


def test_upsert_keeps_rows_without_key(spark):
    t = spark.createDataFrame([(None, "a", 9, 0), (1, "b", 9, 0)], "k int, title string, v int, seen int")
    b = spark.createDataFrame([(None, "c", 1), (1, "b", 1)], "k int, title string, seen int")
    assert sorted(map(str, map(tuple, state.upsert(t, b, "k", "seen", "title", "v").collect()))) == ["(1, 'b', 9, 1)", "(None, 'a', 9, 0)", "(None, 'c', 0, 1)"]


def test_tags_by_words_and_by_patterns(spark):
    rules = {"a": "the", "b": "c#", "c": "sp(?:ark|oon)", "d": "thé"}
    assert one(spark, search.tagged(F.col("t"), rules), t="The C# Spoon.") == ["a", "b", "c"]
    assert one(spark, search.tagged(F.col("t"), rules), t="there spooner xthe") == [] and one(spark, search.tagged(F.col("t"), rules), t=None) == []


def test_search_across_fields_and_tags(spark):
    cards = spark.createDataFrame([(1, "Big Bés", "bes town", ["red", "low"]), (2, "x", "y", ["red"])], "id int, title string, text string, tags array<string>")
    found = lambda t: [r["id"] for r in search.search(cards, text=t, over=("title", "text")).collect()]
    assert found("BES bes t") == [1] and found("town red") == [1] and found("red low") == [1] and found("y red") == [2] and found("low red") == []


def test_personal_state_resets(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    e = spark.createDataFrame([(1, at(1), "applied"), (1, at(2), ""), (1, at(3), "applied"), (1, at(4), "offer"), (2, at(1), "applied"), (2, at(2), None)], "u int, ts timestamp, s string")
    got = state.personal(e, ["u"], "ts", F.col("s"), [F.asc("ts")]).collect()
    assert [(r["u"], r["status"], r["applied_at"].day, r["updated_at"].day) for r in got] == [(1, "offer", 3, 4)]


def test_runs(spark):
    s = spark.createDataFrame([(1, "failed"), (1, "success"), (2, "failed"), (3, "success")], "run int, st string")
    assert {r["run"]: r["run_status"] for r in status.run_status(s, "run", "st").collect()} == {1: "partial", 2: "failed", 3: "success"}


def test_greedy_clusters(spark):
    long = [str(i) for i in range(100)]
    cards = spark.createDataFrame([(1, "x", ["x"], long), (2, "y", ["x"], long[:99]), (3, "z", ["z"], []), (4, "x", ["x"], []), (5, "q", None, None)], "id int, title string, tokens array<string>, shingles array<string>").na.drop().withColumn("k", F.lit(None).cast("string"))
    assert dict(map(tuple, clusters.clusters(cards, ["k"], ["id"]).collect())) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_stream_upserts_each_batch(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k int, title string, seen int"
    spark.createDataFrame([(1, "a", 1)], schema).write.parquet(source)
    run = lambda: ingest.upsert_stream(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "c"), "k", "seen", "title", "v").awaitTermination()
    run()
    spark.createDataFrame([(1, "b", 2), (2, "c", 2)], schema).write.mode("append").parquet(source)
    run()
    assert sorted((r["k"], r["title"], r["v"]) for r in ingest.current(spark, root).collect()) == [(1, "b", 0), (2, "c", 0)]


def test_write_back_publishes_whole_versions(spark, tmp_path):
    root = str(tmp_path / "adverts")
    rows = [(1, "Junior QA tester", "No experience required. " * 9, "Chisinau", None, None, "verified", "open", 0, None), (2, "Senior lawyer", "Papers. " * 20, "Chisinau", None, None, "verified", "open", 0, None)]
    table = spark.createDataFrame(rows, "id int, title string, text string, location string, work_mode string, schedule string, description_quality string, availability string, analysis_version int, analyzed_at timestamp_ntz")
    assert versions.publish(table, root) == 0
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert analysis.write_back(spark, root, at) == 1
    got = {r["id"]: (r["status"], r["analysis_version"], r["analyzed_at"].year) for r in versions.current(spark, root).collect()}
    assert got == {1: ("active", engine.VERSION, 2024), 2: ("excluded", engine.VERSION, 2024)}
    (tmp_path / "adverts" / "version=0000000009").mkdir()  # a version that never was committed
    assert versions.current(spark, root).count() == 2
    for _ in range(3):
        analysis.write_back(spark, root, at)
    assert versions.clean(spark, root, keep=3) == 0 and versions.clean(spark, root, keep=3, hours=0) == 3
    assert len([p for p in (tmp_path / "adverts").iterdir() if (p / "_SUCCESS").exists()]) == 3
    with pytest.raises(ValueError):
        analysis.write_back(spark, str(tmp_path / "none"), at)

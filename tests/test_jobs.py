"""The full write-back, and cards without duplicates against the rule worked out advert by advert."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import engine
from lodestone.plans import jobs
from lodestone.sources import versions

AT = "TIMESTAMP '2026-05-01 00:00:00'"
STORED = "id long, title string, company string, link string, source string, description string, description_quality string, location string, work_mode string, schedule string, salary string, availability string, analysis_version int, analyzed_at timestamp"
GOOD = "Responsibilities:\nTest web applications with our team in Chișinău every day.\nRequirements:\nNo experience required. " + "We teach you all you need to know. " * 3


def stored(n, description, quality="unverified", company="Alfa", location=None, source="Lucru.md", version=0, at=None):
    return (n, "Junior QA tester", company, f"https://www.lucru.md/ro/lucru/x/{n}", source, description, quality, location, None, None, "500 EUR", "open", version, at)


def test_write_back_fills_every_column(spark, tmp_path):
    past = dt.datetime(2026, 1, 1)
    rows = [stored(1, GOOD, "verified"), stored(2, "x" * 30_000), stored(3, None, company="Facebook"), stored(4, f"Menu Descrierea poziției vacante {GOOD} Trimite CV Despre companie", source="Delucru.md", location="Bălți"), stored(5, "as it was", version=engine.VERSION, at=past), stored(6, "", "verified")]
    table = spark.createDataFrame(rows, STORED)
    root = str(tmp_path / "jobs")
    versions.publish(table, root)
    assert jobs.write_back(spark, root, F.expr(AT)) == 1
    got = {r["id"]: r for r in versions.current(spark, root).collect()}
    assert set(got[1].asDict()) == {*table.columns, *jobs.WRITTEN} and len(got) == 6
    assert (got[1]["description"], got[1]["description_quality"], got[1]["location"], got[1]["entry_fit"], got[1]["status"]) == (GOOD, "verified", "Chișinău", "beginner", "active")
    assert got[1]["responsibilities_text"].startswith("Test web") and got[1]["requirements_text"].startswith("No experience") and got[1]["raw_description"] == GOOD
    assert got[1]["reasons"][0]["label"].startswith("The vacancy explicitly says") and got[1]["analyzed_at"] == dt.datetime(2026, 5, 1)
    assert (got[2]["description"], got[2]["description_quality"], got[2]["raw_description"], got[2]["location"]) == (None, "contaminated", "x" * 30_000, "")
    assert (got[3]["description"], got[3]["description_quality"], got[3]["company"]) == (None, "missing", "N/A")
    assert got[4]["description"] == GOOD.strip() and (got[4]["description_quality"], got[4]["location"]) == ("recovered", "Bălți")
    assert (got[5]["description"], got[5]["raw_description"], got[5]["analyzed_at"], got[5]["category"]) == ("as it was", None, past, None)
    assert got[6]["description_quality"] == "missing"
    assert jobs.write_back(spark, root, F.expr(AT), only_pending=False) == 2
    again = {r["id"]: r for r in versions.current(spark, root).collect()}
    assert again[4]["raw_description"] == rows[3][5] and again[5]["analyzed_at"] == dt.datetime(2026, 5, 1)


def test_reasons_cite_what_shows_them(spark):
    text = "Requirements:\nAt least 3 years of experience with tests. SQL is nice. " + "We test web applications with our team. " * 4
    row = ("Junior QA tester", text, "Chisinau", None, None, "verified", "open")
    got = engine.evaluate(spark.createDataFrame([row], "title string, text string, location string, work_mode string, schedule string, description_quality string, availability string")).first()["reasons"]
    assert [tuple(r) for r in got if r["evidence"]] == [("At least 3 year(s) of experience stated.", "At least 3 years of experience with tests.")]
    assert got[0]["label"] == engine.lex.EXCLUDED["experience"]


FIELDS = "id long, title string, company string, link string, source string, description string, description_quality string, detail_checked_at string, scraped_at string, entry_fit string, experience_min double, fit_score int, category string, tags array<string>, quality_flags array<string>, salary string, status string, responsibilities_text string, requirements_text string"


def adverts(draw, n):
    base, out = [f"s{i}" for i in range(50)], []
    for i in range(n):
        body = [x if draw.random() > 0.02 else f"e{i}{x}" for x in base] if draw.random() < 0.7 else [f"z{i}{j}" for j in range(30)]
        name = " ".join(["junior", "web", "developer", "team", draw.choice("abc")]) if draw.random() < 0.8 else f"tester {draw.choice('ab')}"
        site, link = draw.choice([("Lucru.md", f"https://www.lucru.md/ro/lucru/x/{i}"), ("Rabota.md", f"https://www.rabota.md/ro/joburi/x/{i}")])
        link = link if draw.random() > 0.05 else "https://evil.test/1"
        out.append((i, name, draw.choice(["ICS Alfa SRL", "Alfa", "N/A", "Beta"]), link, site, " ".join(body), draw.choice(["verified", "unverified"]), draw.choice(["2026-01-01 00:00:00", "2026-02-01 00:00:00", None]), draw.choice(["2026-01-01 00:00:00", "2026-01-02 00:00:00"]), draw.choice(["beginner", "beginner", "review"]), draw.choice([None, None, 1.0]), draw.choice([50, 60]), "QA & Testing", draw.choice([["SQL"], ["Remote", "SQL"], ["No Experience Required"], ["English Required"]]), draw.choice([["PAY_NOT_STATED"], [], [], ["DEGREE_REQUIRED"]]), draw.choice(["500 EUR", None]), draw.choice(["active", "active", "active", "excluded"]), None, None))
    return out


def by_hand(rows):
    runs = lambda words: {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0

    def record(r):
        d = dict(zip([f.split()[0] for f in FIELDS.split(", ")], r, strict=True))
        who = {"ICS Alfa SRL": "alfa", "Alfa": "alfa", "Beta": "beta", "N/A": ""}[d["company"]]
        asked = sorted(t for t in d["tags"] if t in ("Remote", "English Required"))
        return d | {"who": who, "key": (who, d["entry_fit"], d["experience_min"], asked, sorted({*d["quality_flags"]} - {"PAY_NOT_STATED"})), "words": {*d["title"].split()}, "runs": runs(d["description"].split())}

    same = lambda x, y: bool(x["who"]) and x["key"] == y["key"] and (x["title"] == y["title"] or dice(x["words"], y["words"]) >= 0.7 and min(len(x["runs"]), len(y["runs"])) >= 25 and dice(x["runs"], y["runs"]) >= 0.88)
    rank = lambda x: (x["description_quality"] == "verified", x["detail_checked_at"] or "", len(x["runs"]), x["salary"] is not None, -len(x["title"]), x["id"])
    groups = []
    for x in sorted((record(r) for r in rows if "evil" not in r[3]), key=lambda x: (-x["fit_score"], [-ord(c) for c in x["scraped_at"]], x["id"])):
        mine = next((g for g in groups if all(same(x, m) for m in g)), None)
        if mine is None:
            groups.append(mine := [])
        mine.append(x)
    out = {}
    for g in groups:
        best = max(g, key=rank)
        out[best["id"]] = [(best["source"], best["link"]), *((m["source"], m["link"]) for m in g if m is not best)]
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_cards(spark, seed):
    rows = adverts(random.Random(seed), 80)
    got = {r["id"]: [tuple(s) for s in r["sources"]] for r in jobs.cards(spark.createDataFrame(rows, FIELDS)).collect()}
    want = by_hand(rows)
    assert got == want and any(len(s) > 1 for s in want.values())


def test_read_and_filters(spark):
    rows = adverts(random.Random(6), 60)
    table = spark.createDataFrame(rows, FIELDS)
    want = by_hand([r for r in rows if r[16] == "active"])
    by_id = {r[0]: r for r in rows}
    got = [r["id"] for r in jobs.read(table, fit="beginner", source="Lucru.md", tags=["SQL"], text="DEVELOPER").collect()]
    mine = [i for i, s in want.items() if by_id[i][9] == "beginner" and any(n == "Lucru.md" for n, _ in s) and "SQL" in by_id[i][13] and "developer" in by_id[i][1]]
    assert got == sorted(mine, key=lambda i: (-by_id[i][11], [-ord(c) for c in by_id[i][8]], by_id[i][3])) and got
    found = {(r["facet"], r["name"]): r["n"] for r in jobs.filters(table).collect()}
    assert found["fit", "all"] == len(want) and found["fit", "other"] == 0 and found["excluded", "excluded"] == sum(r[16] == "excluded" for r in rows)
    assert found["review", "degree"] == sum(by_id[i][9] == "review" and "DEGREE_REQUIRED" in by_id[i][14] for i in want) and found["category", "QA & Testing"] == len(want)
    assert found["tag", "SQL"] == sum("SQL" in by_id[i][13] for i in want)
    with pytest.raises(ValueError):
        jobs.read(table, fit="excluded")

"""Stored responses, and refreshes of several sources from them."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.plans import refresh
from lodestone.sources import lease, responses, versions

LONG = "You will test web applications with our team in Chișinău. No experience required, we teach you all you need to know about the job."


def stored(source, url, body="x", status=200, final_url=None, elapsed_ms=100, failure=None):
    return {"source": source, "url": url, "final_url": final_url, "status": status, "elapsed_ms": elapsed_ms, "body": body, "failure": failure}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], responses.SCHEMA)


def test_responses(spark, tmp_path):
    at = "https://www.lucru.md/ro/lucru/qa/1"
    rows = [
        stored("Lucru.md", at), stored("Lucru.md", at, status=404), stored("Lucru.md", at, status=500), stored("Lucru.md", at, body="x" * 5_000_001), stored("Lucru.md", at, elapsed_ms=16_000), stored("Lucru.md", at, final_url="https://www.lucru.md/ro/lucru/other/2"),
        stored("Lucru.md", at, final_url="https://lucru.md/ro/munca/moved/9/1/"), stored("Lucru.md", at, final_url="https://www.lucru.md/ro/"), stored("Lucru.md", "https://evil.test/1"), stored("Lucru.md", at, body=None), stored("Lucru.md", at, failure="socket hang up", status=None),
    ]
    got = [(r["outcome"], r["reason"]) for r in responses.judged(frame(spark, rows), details=True).collect()]
    assert [o for o, _ in got] == ["page", "closed", "failed", "failed", "failed", "failed", "page", "failed", "failed", "failed", "failed"]
    assert got[1][1] == "Source returned HTTP 404." and "5000000" in got[3][1] and "redirected" in got[5][1] == got[7][1] and got[8][1] == "Invalid source URL" and got[10][1] == "socket hang up"
    assert [r["outcome"] for r in responses.judged(frame(spark, rows[:3]), details=False).collect()] == ["page", "failed", "failed"]
    for n, part in enumerate((rows[:4], rows[4:])):
        (tmp_path / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    out = str(tmp_path / "out")
    stream = responses.judged(responses.read(spark, str(tmp_path / "*.json"), stream=True, files_per_batch=1), details=True)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = responses.judged(responses.read(spark, str(tmp_path / "*.json")), details=True)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect())) and batch.count() == len(rows)


def card(name, company="Alfa", n=1):
    return f"<div class='vacancyCardItem'><a class='vacancyShowPopup' href='/ro/lucru/x/{n}'>{name}</a><i class='company-name'>{company}</i></div>"


def detail(text, extra=""):
    return f"<p class='vacancy-title'>QA tester</p>{extra}<div class='vacancy-content'>{text}</div><b class='vacancy-summary-item-mobile'>Chișinău</b>"


def test_refresh(spark, tmp_path):
    root, noon = str(tmp_path), dt.datetime(2026, 5, 1, 12)
    link = lambda n: f"https://www.lucru.md/ro/lucru/x/{n}"
    listing = card("Junior QA tester", n=1) + card("Trainee developer", "Beta", 2) + card("Gone", n=3) + card("Broken", n=4)
    asked = []

    def scrape(source, pages):
        asked.append((source, pages))
        if source == "Rabota.md":
            raise OSError("no such host")
        return frame(spark, [stored(source, "https://www.lucru.md/ro/1", listing), stored(source, "https://www.lucru.md/ro/2", status=503)] if source == "Lucru.md" else [stored(source, "https://www.delucru.md/1", "<p>none</p>")])

    pages = [stored("Lucru.md", link(1), detail(LONG)), stored("Lucru.md", link(2), detail(LONG, "<div class='alert'>This job has expired</div>")), stored("Lucru.md", link(3), status=410), stored("Lucru.md", link(4), "<p>menu</p>")]
    enrich = lambda source, queue: frame(spark, pages).join(queue.select(F.col("link").alias("url")), "url", "left_semi").select(*[c.split()[0] for c in responses.SCHEMA.split(", ")])
    got = refresh.refresh(spark, root, ["Rabota.md", "Lucru.md", "Delucru.md"], scrape, enrich, noon, pages=99, details=0)
    assert asked[0] == ("Rabota.md", 10) and got["status"] == "partial"
    by = {o["source"]: o for o in got["sources"]}
    assert [by[s]["status"] for s in ("Rabota.md", "Lucru.md", "Delucru.md")] == ["failed", "partial", "success"] and by["Rabota.md"]["errors"] == ["no such host"]
    # one detail a source is the least there is
    assert (by["Lucru.md"]["found"], by["Lucru.md"]["listing_pages"], by["Lucru.md"]["detail_attempted"]) == (4, 1, 1)
    got = refresh.refresh(spark, root, ["Lucru.md"], scrape, enrich, noon + dt.timedelta(hours=7))
    # a closed advert that is listed again is read again
    assert [sum(o[k] for o in (by["Lucru.md"], got["sources"][0])) for k in ("verified", "failed")] == [1, 1] and got["sources"][0]["closed"] == 2
    held = {r["link"]: r for r in versions.current(spark, f"{root}/jobs").collect()}
    assert len(held) == 4 and held[link(1)]["description"] == LONG and (held[link(1)]["description_quality"], held[link(1)]["location"], held[link(1)]["title"], held[link(1)]["entry_fit"]) == ("verified", "Chișinău", "QA tester", "beginner")
    assert held[link(2)]["availability_reason"] == "This job has expired" and held[link(3)]["availability_reason"] == "Source returned HTTP 410." and held[link(3)]["exclusion_reason"] == "The original vacancy page is no longer available."
    assert held[link(4)]["detail_error"] == "description too short" and held[link(4)]["analysis_version"] == held[link(1)]["analysis_version"] > 0
    runs = versions.current(spark, f"{root}/runs").where("source IS NULL").orderBy("run_id").collect()
    assert [r["status"] for r in runs] == ["partial", "partial"]
    other = lease.acquire(spark, root, "other", (noon + dt.timedelta(days=1)).timestamp())
    assert refresh.refresh(spark, root, [], scrape, enrich, noon + dt.timedelta(days=1, minutes=5)) == {"skipped": True, "reason": "Another refresh is running."} and other
    assert main(["filters", "--root", root], spark) == main(["jobs", "--root", root, "--fit", "all"], spark) == 0

"""python -m lodestone refresh | analyze | jobs | filters: the table of adverts under --root, from stored responses."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import jobs, refresh
from .sources import responses, sites
from .sources.versions import current


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("command", choices=("refresh", "analyze", "jobs", "filters"))
    parser.add_argument("--root", required=True)
    parser.add_argument("--listings", help="stored responses of listing pages")
    parser.add_argument("--responses", help="stored responses of detail pages")
    parser.add_argument("--pages", type=int, default=5)
    parser.add_argument("--details", type=int, default=100)
    parser.add_argument("--force", action="store_true", help="analyse all rows, not only those that are due")
    for name in ("category", "source", "mode", "review", "text"):
        parser.add_argument(f"--{name}", default="")
    parser.add_argument("--fit", default="beginner")
    parser.add_argument("--tag", action="append", default=[])
    parser.add_argument("--limit", type=int, default=20, help="cards to show")
    given = parser.parse_args(args)
    spark, now = spark or SparkSession.builder.appName("lodestone").getOrCreate(), dt.datetime.now()
    if given.command == "refresh":
        pages = lambda source, n: responses.read(spark, given.listings).where(F.col("source") == source)
        details = lambda source, queue: responses.read(spark, given.responses).join(queue.select(F.col("link").alias("url")), "url", "left_semi")
        done = refresh.refresh(spark, given.root, list(sites.SITES), pages, details, now, given.pages, given.details)
        print(done)
        return int(done.get("status") in ("failed", "partial"))
    table = f"{given.root}/jobs"
    if given.command == "analyze":
        print(jobs.write_back(spark, table, F.lit(now).cast("timestamp"), only_pending=not given.force))
    elif given.command == "jobs":
        found = jobs.read(current(spark, table), given.fit, category=given.category, tags=given.tag, source=given.source, mode=given.mode, review=given.review, text=given.text)
        found.select("fit_score", "title", "company", "category", "link", "duplicate_count").show(given.limit, truncate=60)
    else:
        jobs.filters(current(spark, table)).orderBy("facet", "name").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""A refresh: listing and detail pages of each source into the table of adverts, under a lease, each source's failures kept to itself."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources import lease, responses, sites
from ..sources.bronze import DEFAULTS
from ..sources.shared import cut
from ..sources.versions import commit, current
from . import jobs

PAGES, DETAILS, ERRORS = (1, 10), (1, 300), 10
#: Columns of an advert that a listing gives, and those that details add.
LISTED = {"id": ("bigint", None), "title": ("string", None), "link": ("string", None), "source": ("string", None), "scraped_at": ("timestamp", None), "last_seen_at": ("timestamp", None), "description": ("string", None), "availability_reason": ("string", None)}
FIELDS = ("location", "work_mode", "schedule", "salary")
RUNS = "run_id long, source string, started_at timestamp, finished_at timestamp, status string, listing_pages long, found long, detail_attempted long, verified long, closed long, failed long, errors array<string>"

#: Gives the stored responses for a source's pages 1..n, or for a queue of (source, link).
Scrape = Callable[[str, int], DataFrame]
Enrich = Callable[[str, DataFrame], DataFrame]


def _within(value: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], value))


def added(table: DataFrame | None, adverts: DataFrame, at: Column) -> DataFrame:
    """The table after a listing: new links come in with all defaults, known ones are seen again and take a new title."""
    batch = adverts.select(F.xxhash64("link").alias("id"), "title", "company", "link", "source").withColumns({"scraped_at": at, "last_seen_at": at})
    batch = state.evolve(batch, LISTED | DEFAULTS | {f: ("string", None) for f in FIELDS} | {"education": ("string", None), "experience": ("string", None), "date_posted": ("string", None)})
    if table is None:
        return batch
    wider = state.evolve(table, {c: (t, None) for c, t in batch.dtypes})
    return state.upsert(wider, batch, "link", "last_seen_at", "title", "analysis_version")


def queued(table: DataFrame, source: str, at: Column, limit: int, force: bool = False, retry_failed: bool = False) -> DataFrame:
    """The adverts of a source to read again: active ones first, then the longest untried, the longest unchecked, the smallest id."""
    again = (F.col("availability") == "closed") & (F.col("last_seen_at") > F.col("detail_checked_at"))
    poor = ~F.col("description_quality").eqNullSafe(F.lit("verified")) | F.col("detail_error").isNotNull() | F.coalesce(again, F.lit(False))
    due = F.lit(True) if force or retry_failed else state.due(at, F.col("detail_checked_at"), F.col("detail_attempted_at"), poor)
    rows = table.where((F.col("source") == source) & due)
    if retry_failed:
        rows = rows.where(F.col("detail_error").isNotNull())
    order = [F.when(F.coalesce("status", F.lit("active")) == "active", 0).otherwise(1), F.asc_nulls_first("detail_attempted_at"), F.asc_nulls_first("detail_checked_at"), F.asc("id")]
    return rows.orderBy(*order).limit(limit).select("source", "link")


def read_details(stored: DataFrame, at: Column) -> DataFrame:
    """(link, outcome, reason, ...) of stored detail responses: ok with what the page says, closed, or failed."""
    rows = responses.judged(stored, details=True)
    found = sites.details(rows.withColumnRenamed("reason", "why")).withColumn("shut", sites.closed(at))
    failed = F.col("outcome") == "failed"
    reason = F.when(failed | (F.col("outcome") == "closed"), F.col("why")).when(F.col("shut.closed"), F.col("shut.reason")).otherwise(F.col("error"))
    outcome = F.when(failed, "failed").when((F.col("outcome") == "closed") | F.col("shut.closed"), "closed").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    return found.select(F.col("url").alias("link"), outcome.alias("outcome"), reason.alias("reason"), "title", "company", "description", *FIELDS, "education", "experience", "date_posted")


def applied(table: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The table after detail reads: those that are ok also set place, mode, schedule, pay and the other fields, and verify the description."""
    more = ("outcome", *FIELDS, "education", "experience", "date_posted")
    side = found.select(F.col("link").alias("d_link"), *[F.col(c).alias(f"d_{c}") for c in more])
    out = state.detailed(table, found.select("link", "outcome", "title", "company", "description", "reason"), "link", at)
    both = out.join(side, F.col("link") == F.col("d_link"), "left")
    ok = F.coalesce(F.col("d_outcome") == "ok", F.lit(False))
    changed = {c: F.when(ok, F.col(f"d_{c}")).otherwise(F.col(c)) for c in more[1:]}
    return both.withColumns(changed | {"description_quality": F.when(ok, "verified").otherwise(F.col("description_quality"))}).select(*table.columns)


def refresh(spark: SparkSession, root: str, sources: list[str], scrape: Scrape, enrich: Enrich, as_of: dt.datetime, pages: int = 5, details: int = 100, wanted: Callable[[Column], Column] | None = None) -> dict:
    """Refreshes the tables ``jobs`` and ``runs`` under ``root``; returns the run's number, status and each source's outcome, or that another one is running.

    1 to 10 pages and 1 to 300 details a source. A source whose listing or
    details fail as a whole counts the failure and lets the others go on. What
    fails after the sources, such as the analysis, fails the run and is raised
    once that is noted.
    """
    pages, details = _within(pages, PAGES), _within(details, DETAILS)
    at, table = F.lit(as_of).cast("timestamp"), f"{root}/jobs"
    run = lease.acquire(spark, root, uuid.uuid4().hex, as_of.timestamp())
    if run is None:
        return {"skipped": True, "reason": "Another refresh is running."}
    outcomes, fatal = [], None
    try:
        for source in sources:
            n, errors = dict.fromkeys(("listing_pages", "found", "detail_attempted", "verified", "closed", "failed"), 0), []
            broken = 0
            try:
                judged = cut(responses.judged(scrape(source, pages).where(F.col("source") == source), details=False))
                n["listing_pages"], broken = (judged.where(c).count() for c in ("outcome = 'page'", "outcome = 'failed'"))
                errors += [r[0] for r in judged.where("outcome = 'failed'").orderBy("url").select("reason").limit(ERRORS).collect()]
                found = sites.listing(judged.where("outcome = 'page'")).dropDuplicates(["link"])
                found = cut(found.where(wanted(F.col("title"))) if wanted else found)
                n["found"] = found.count()
                if n["found"]:
                    commit(spark, table, lambda old, found=found: added(old, found, at), lease=run)
            except Exception as error:  # noqa: BLE001  a source's failure is its own
                broken += 1
                errors.append(str(error)[:300])
            try:
                held = current(spark, table)
                queue = cut(queued(held, source, at, details)) if held is not None else None
                n["detail_attempted"] = queue.count() if queue else 0
                if n["detail_attempted"]:
                    read = cut(read_details(enrich(source, queue), at).join(queue.select("link"), "link", "left_semi").dropDuplicates(["link"]))
                    counted = {r[0]: r[1] for r in read.groupBy("outcome").count().collect()}
                    n |= {"verified": counted.get("ok", 0), "closed": counted.get("closed", 0), "failed": counted.get("failed", 0)}
                    errors += [f"{r[0]}: {r[1]}"[:300] for r in read.where("outcome = 'failed'").orderBy("link").select("link", "reason").limit(ERRORS).collect()]
                    commit(spark, table, lambda old, read=read: applied(old, read, at), lease=run)
            except Exception as error:  # noqa: BLE001
                n["failed"] += 1
                errors.append(str(error)[:300])
            some = n["listing_pages"] or n["verified"] or n["closed"]
            status = ("partial" if some else "failed") if errors or broken or n["failed"] else "success"
            outcomes.append({"run_id": run, "source": source, "started_at": as_of, "finished_at": as_of, "status": status, **n, "errors": errors[:ERRORS]})
            lease.renew(spark, root, run, as_of.timestamp())
        if current(spark, table) is not None:
            jobs.write_back(spark, table, at, lease=run)
    except Exception as error:  # noqa: BLE001
        fatal = error
    every = [o["status"] for o in outcomes]
    status = "failed" if fatal or all(s == "failed" for s in every) else "partial" if any(s != "success" for s in every) else "success"
    columns = [c.split()[0] for c in RUNS.split(", ")]
    whole = {"run_id": run, "source": None, "started_at": as_of, "finished_at": as_of, "status": status, "errors": [str(fatal)[:300]] if fatal else []}
    new = spark.createDataFrame([tuple(o.get(c) for c in columns) for o in [*outcomes, whole]], RUNS)
    commit(spark, f"{root}/runs", lambda old: new if old is None else old.unionByName(new), lease=run)
    lease.release(spark, root, run, as_of.timestamp())
    if fatal:
        raise fatal
    return {"run": run, "status": status, "sources": outcomes}

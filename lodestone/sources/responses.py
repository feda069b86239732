"""Stored responses of listing and detail pages: which are pages, and why the others are not. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import allowed
from .sites import SITES, Site, _by_source

#: A response as a fetcher stores it: a line of JSON.
SCHEMA = "source string, url string, final_url string, status int, elapsed_ms long, body string, failure string"
# The largest body in bytes, the longest wait in seconds, and states that mean a page is gone for good.
MAX_BYTES, MAX_SECONDS, GONE = 5_000_000, 15, (404, 410)


def read(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Responses under a path of any file system that Spark reads, at once or as a stream of new files."""
    reader = (spark.readStream if stream else spark.read).schema(SCHEMA)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _last_part(link: Column) -> Column:
    return F.element_at(F.split(link, "/"), -1)


def judged(responses: DataFrame, details: bool, sites: dict[str, Site] = SITES) -> DataFrame:
    """source, url, html, outcome (page, closed or failed) and reason of each response.

    A failed request, a state outside 200 to 299, a body over MAX_BYTES, a wait
    of over MAX_SECONDS and no body at all are failures. Of detail pages those
    that are gone are closed; one that came from another advert, or from off the
    site, has been redirected and tells nothing. Failures have no html.
    """
    link = lambda c: _by_source(F.col("source"), sites, lambda s: allowed(F.col(c), s.origin, s.path, s.aliases))
    rows = responses.withColumns({"__link": link("url"), "__final": link("final_url")}) if details else responses
    reason = F.when(F.col("failure").isNotNull(), F.col("failure"))
    if details:
        moved = F.col("final_url").isNotNull() & (F.col("__final").isNull() | (_last_part(F.col("__final")) != _last_part(F.col("__link"))))
        gone = F.coalesce(F.col("status").isin(*GONE), F.lit(False)) & F.col("failure").isNull() & F.col("__link").isNotNull()
        reason = F.when(F.col("__link").isNull(), "Invalid source URL").when(gone, F.format_string("Source returned HTTP %d.", "status")).otherwise(reason)
    reason = F.coalesce(
        reason,
        F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.format_string("Request failed with status code %d", "status"))
        .when(F.col("elapsed_ms") > MAX_SECONDS * 1000, F.lit(f"timeout of {MAX_SECONDS * 1000}ms exceeded"))
        .when(F.octet_length("body") > MAX_BYTES, F.lit(f"maxContentLength size of {MAX_BYTES} exceeded"))
        .when(F.col("body").isNull(), F.lit("The response has no body.")),
    )
    if details:
        reason = F.coalesce(reason, F.when(moved, F.lit("Vacancy redirected away from its detail page; availability unconfirmed.")))
    outcome = F.when(reason.isNull(), "page").otherwise("failed") if not details else F.when(gone, "closed").when(reason.isNull(), "page").otherwise("failed")
    return rows.select("source", "url", F.when(reason.isNull(), F.col("body")).alias("html"), outcome.alias("outcome"), reason.alias("reason"))

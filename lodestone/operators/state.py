"""Keyed tables under change: upsert, partial updates, schema evolution, recheck queues, leases, personal state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evolve(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with each absent column added as (type, default); the same again changes nothing."""
    new = {k: F.lit(v).cast(t) for k, (t, v) in columns.items() if k not in df.columns}
    return df.withColumns(new) if new else df


def upsert(target: DataFrame, batch: DataFrame, key: str, seen: str, compared: str, version: str) -> DataFrame:
    """``target`` after ``batch`` (one row a key).

    New keys come in whole. Known keys take the seen time and the compared
    column; the version falls to 0 only if the compared column changed. One
    full outer join on the key; null keys stay apart.
    """
    # presence is told by a column of its own, as a key may be null
    t, b = target.withColumn("__old", F.lit(True)).alias("t"), batch.withColumn("__new", F.lit(True)).alias("b")
    both = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    old, new = F.col("t.__old").isNotNull(), F.col("b.__new").isNotNull()
    out = []
    for c in target.columns:
        has = c in batch.columns
        if c == version:
            value = F.when(old & new & ~F.col(f"t.{compared}").eqNullSafe(F.col(f"b.{compared}")), 0).when(old, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}") if has else F.lit(0))
        elif c in (seen, compared):
            value = F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
        else:
            value = F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}") if has else F.lit(None))
        out.append(value.alias(c))
    return both.select(*out)


def detailed(table: DataFrame, found: DataFrame, key: str, as_of: Column) -> DataFrame:
    """``table`` after detail reads (key, outcome, title, company, description, reason).

    ok: the first description is kept as raw_description, empty or N/A names
    keep the old ones, errors go, the row is open and due for analysis. closed:
    reason and times. failed: the error (300 characters) and the attempt only.
    """
    f = found.select(*[F.col(c).alias(f"f_{c}") for c in found.columns])
    both = table.join(f, F.col(key) == F.col(f"f_{key}"), "left")
    ok, shut, bad = (F.coalesce(F.col("f_outcome") == x, F.lit(False)) for x in ("ok", "closed", "failed"))
    named = lambda c: F.when(ok & ~F.coalesce(F.col(f"f_{c}"), F.lit("")).isin("", "N/A"), F.col(f"f_{c}")).otherwise(F.col(c))
    return both.withColumns(
        {
            "raw_description": F.when(ok, F.coalesce("raw_description", "description")).otherwise(F.col("raw_description")),
            "description": F.when(ok, F.col("f_description")).otherwise(F.col("description")),
            "title": named("title"),
            "company": named("company"),
            "availability": F.when(ok, "open").when(shut, "closed").otherwise(F.col("availability")),
            "availability_reason": F.when(ok, F.lit(None)).when(shut, F.col("f_reason")).otherwise(F.col("availability_reason")),
            "detail_error": F.when(ok | shut, F.lit(None)).when(bad, F.substring("f_reason", 1, 300)).otherwise(F.col("detail_error")),
            "detail_checked_at": F.when(ok | shut, as_of).otherwise(F.col("detail_checked_at")),
            "detail_attempted_at": F.when(ok | shut | bad, as_of).otherwise(F.col("detail_attempted_at")),
            "analysis_version": F.when(ok | shut, 0).otherwise(F.col("analysis_version")),
        }
    ).select(*table.columns)


def pending(df: DataFrame, version: int) -> DataFrame:
    """Rows analysed under other rules, or never."""
    return df.where(F.coalesce(F.col("analysis_version") != version, F.lit(True)) | F.col("analyzed_at").isNull())


def due(as_of: Column, checked: Column, attempted: Column, poor: Column, stale: str = "INTERVAL 7 DAYS", retry: str = "INTERVAL 6 HOURS") -> Column:
    """Rows to check again: never checked, stale or poor, and not tried within the retry time; never null."""
    old = checked.isNull() | (checked <= as_of - F.expr(stale)) | F.coalesce(poor, F.lit(False))
    return F.coalesce(old, F.lit(True)) & F.coalesce(attempted.isNull() | (attempted <= as_of - F.expr(retry)), F.lit(True))


def queue(df: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in a total order; Spark cuts groups before it shuffles them."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("__rank") <= limit).drop("__rank")


def lease(runs: DataFrame, as_of: Column, hold: str = "INTERVAL 2 HOURS") -> DataFrame:
    """Each run with its next status: a running one past its hold has failed; ``live`` marks those that still hold the lease."""
    live = (F.col("status") == "running") & (F.col("started_at") > as_of - F.expr(hold))
    return runs.withColumn("live", F.coalesce(live, F.lit(False))).withColumn("status", F.when((F.col("status") == "running") & ~F.col("live"), "failed").otherwise(F.col("status")))


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def take_while(pages: DataFrame, feed: str, page: str, stop: Column) -> DataFrame:
    """Pages of each feed up to its first stop, that one included. The stops are one small row a feed."""
    last = pages.where(stop).groupBy(feed).agg(F.min(page).alias("__last"))
    return pages.join(last, feed, "left").where(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__last")


def personal(events: DataFrame, key: list[str], at: str, status: Column, order: list[Column]) -> DataFrame:
    """The last state of each key from its status changes: (key, status, applied_at, updated_at).

    applied_at is the first time with a status since it was last empty. Keys
    whose last status is empty are dropped.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    marked = events.withColumn("__s", F.coalesce(status, F.lit(""))).withColumn("__run", F.sum(F.when(F.col("__s") == "", 1).otherwise(0)).over(w)).withColumn("__i", F.row_number().over(w))
    last = marked.groupBy(*key).agg(F.max_by(F.struct(F.col("__s"), F.col("__run"), F.col(at)), "__i").alias("l"))
    first = marked.where("__s <> ''").groupBy(*key, "__run").agg(F.min(at).alias("applied_at"))
    now = last.where("l.__s <> ''").select(*key, F.col("l.__s").alias("status"), F.col("l.__run").alias("__run"), F.col(f"l.{at}").alias("updated_at"))
    return now.join(first, [*key, "__run"]).drop("__run")


def overlaps(states: DataFrame, cards: DataFrame, link: str = "links") -> DataFrame:
    """(entry_id, card_id): for each card the first entry that shares a link with it."""
    left = states.select("entry_id", F.explode(link).alias("__l")).distinct()
    right = cards.select("card_id", F.explode(link).alias("__l")).distinct()
    return right.join(left, "__l").groupBy("card_id").agg(F.min("entry_id").alias("entry_id"))

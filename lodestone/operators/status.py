"""Runs and sources: latest rows, freshness, roll-ups, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest ``order``; partial maxima before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")


def source_status(failed: Column, errors: Column, succeeded: Column) -> Column:
    """success without failures; with some: partial if anything succeeded, else failed."""
    return F.when(~(failed | errors), "success").when(succeeded, "partial").otherwise("failed")


def run_status(df: DataFrame, by: str, status: str, fatal: Column | None = None) -> DataFrame:
    """Status of each run from its sources: all failed (or fatal): failed; any not a success: partial; else success."""
    every, some = F.bool_and(F.col(status) == "failed"), F.bool_or(F.col(status) != "success")
    if fatal is not None:
        every = every | F.bool_or(fatal)
    return df.groupBy(by).agg(F.when(every, "failed").when(some, "partial").otherwise("success").alias("run_status"))


def refresh(sources: DataFrame, runs: DataFrame, cards: DataFrame, source: str, run: str, finished: str, stale: Column, failed: Column) -> DataFrame:
    """One row a source: last run, last success, and counts over its cards; defaults for sources that never ran."""
    ran = runs.groupBy(source).agg(F.max_by(F.struct("status", finished), run).alias("__last"), F.max_by(finished, F.when(F.col("status") == "success", F.col(run))).alias("last_success"))
    ran = ran.select(source, F.col("__last.status").alias("last_status"), F.col(f"__last.{finished}").alias("last_finished"), "last_success")
    stats = cards.groupBy(source).agg(F.count("*").alias("total"), F.count_if(stale).alias("stale"), F.count_if(failed).alias("failures"))
    out = sources.join(ran, source, "left").join(stats, source, "left")
    return out.select(source, F.coalesce("last_status", F.lit("never")).alias("last_status"), "last_finished", "last_success", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "stale", "failures")])


def first_errors(df: DataFrame, by: list[str], order: str, error: str, n: int) -> DataFrame:
    """The first ``n`` errors of each group: a bounded heap a group, whatever its size."""
    from pyspark.sql import Window

    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__rank") <= n)
    return ranked.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__rank", F.col(error).alias("e")))), lambda x: x["e"]), "; ").alias("errors"))


def differences(expected: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose expected and actual values differ; nulls equal nulls."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in expected.items()]))


def coverage(candidates: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Candidates with their first stored row and an outcome: visible, stored_excluded or missing."""
    one = stored.groupBy(*keys).agg(F.min_by("status", order).alias("status"))
    return candidates.join(one, keys, "left").withColumn("outcome", F.when(F.col("status").isNull(), "missing").when(F.col("status") == "active", "visible").otherwise("stored_excluded"))


def booked(runs: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """``runs`` (run_id, source, status, started_at, finished_at, found, saved, failed, error) after the outcomes in ``done`` (run_id, source, found, saved, failed, error).

    A known run takes its counters, the first 300 characters of its error, the
    end time and its status; an unknown one is begun and ended at once. Runs
    without an outcome stay. One join on the run id.
    """
    d = done.select(*[F.col(c).alias(f"d_{c}") for c in ("run_id", "source", "found", "saved", "failed", "error")], F.lit(True).alias("d_new"))
    both = runs.withColumn("__old", F.lit(True)).join(d, F.col("run_id") == F.col("d_run_id"), "full_outer")
    new = F.col("d_new").isNotNull()
    ended = source_status(F.col("d_failed") > 0, F.col("d_error").isNotNull(), F.col("d_saved") > 0)
    take = lambda c, value: F.when(new, value).otherwise(F.col(c)).alias(c)
    return both.select(
        F.coalesce("run_id", "d_run_id").alias("run_id"), F.coalesce("source", "d_source").alias("source"), take("status", ended), F.when(F.col("__old").isNull(), as_of).otherwise(F.col("started_at")).alias("started_at"), take("finished_at", as_of),
        *[take(c, F.col(f"d_{c}")) for c in ("found", "saved", "failed")], take("error", F.substring("d_error", 1, 300)),
    )

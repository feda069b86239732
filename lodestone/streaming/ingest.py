"""Streams over stored pages and events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..sources.shared import cut
from ..sources.versions import key_bucket, commit, current  # noqa: F401  current() reads what the stream wrote


def upsert_stream(batches: DataFrame, root: str, checkpoint: str, key: str, seen: str, compared: str, version: str, buckets: int = 1) -> StreamingQuery:
    """Upserts a stream into a versioned table under ``root``, all that is available and then stops.

    Each batch is a change of the newest version, whoever wrote it; the stream's
    id and the batch's number go with it, so that a batch which runs twice after
    a failure counts once, and a stream with a new checkpoint goes on from what
    is there. With ``buckets``, only those of the batch's keys are read and
    written again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut(state.first_seen(batch, [key], [F.col(seen).desc()]))
        touched = [r[0] for r in rows.select(key_bucket(key, buckets)).distinct().collect()]  # at most ``buckets`` numbers
        name = spark.sparkContext.getLocalProperty("sql.streaming.queryId")

        def change(old: DataFrame | None) -> DataFrame:
            return rows.withColumn(version, F.lit(0)) if old is None else state.upsert(old, rows, key, seen, compared, version)

        commit(spark, root, change, stream=(name, number), key=key, buckets=buckets, touched=touched)

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"upsert-{uuid.uuid4().hex}").start()


def windowed(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per key and event-time window; rows later than ``late`` are dropped. An extension beside the batch roll-ups."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def is_due(as_of: Column, checked: str, attempted: str, poor: Column) -> Column:
    return state.due(as_of, F.col(checked), F.col(attempted), poor)

"""Keyed state over batches of a stream against the same question over all rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.operators import state
from lodestone.streaming import stateful


def drained(spark, tmp_path, schema, batches, build):
    """Rows (batch, ...) that come out as the batches of files are read one after the other, each by a run of its own."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        frame = build(spark.readStream.schema(schema).parquet(source))
        keep = lambda part, number: part.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
        frame.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_fold_of_late_changes(spark, tmp_path):
    draw, start = random.Random(2), dt.datetime(2026, 1, 1)
    events = [(draw.randrange(6), i, start + dt.timedelta(minutes=7 * i + draw.randrange(5)), draw.choice(["applied", "interview", "", "offer"])) for i in range(90)]
    held = [e for e in events[20:50] if draw.random() < 0.4]  # these come a batch late
    batches = [events[:20] + [e for e in events[20:50] if e not in held], events[50:70] + held, events[70:]]
    schema = "k int, n int, ts timestamp, st string"
    got = drained(spark, tmp_path, schema, batches, lambda s: stateful.personal_stream(s, "k", "ts", "n", "st", "1 day"))
    last = got.groupBy("key").agg(F.max_by(F.struct("status", "applied_at", "updated_at"), "batch").alias("x")).where("x.status <> ''").select("key", "x.*")
    want = state.personal(spark.createDataFrame(events, schema), ["k"], "ts", F.col("st"), [F.asc("ts"), F.asc("n")]).select("k", "status", "applied_at", "updated_at")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) and want.count() > 2


def test_what_the_watermark_has_passed_is_folded_for_good():
    first = [(1, 1, "applied"), (5, 2, ""), (3, 3, "offer")]
    assert stateful.folded(stateful.folded(stateful.EMPTY, first), [(9, 4, "applied"), (7, 5, "interview")]) == stateful.folded(stateful.EMPTY, [*first, (9, 4, "applied"), (7, 5, "interview")]) == ("applied", 7, 9)


def test_due_again(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2026, 1, day, hour)
    schema = "link string, ts timestamp, ok boolean"
    batches = [[("a", at(1), True), ("b", at(1), False), ("c", at(1), False)], [("c", at(1, 3), True), ("z", at(1, 8), True)], [("z", at(2), True)], [("z", at(9), True)], [("z", at(10), True)]]
    got = drained(spark, tmp_path, schema, batches, lambda s: stateful.due_stream(s, "link", "ts", "ok", "0 seconds"))
    assert sorted((r["key"], r["due_at"], r["reason"]) for r in got.collect() if r["key"] != "z") == [("a", at(8), "stale"), ("b", at(1, 6), "retry"), ("c", at(8, 3), "stale")]

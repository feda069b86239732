"""Keyed state over streams: the fold of personal states, and adverts that fall due again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds after which a failed read is tried again, and a good one is stale.
RETRY, STALE = 6 * 3600 * 1_000_000, 7 * 24 * 3600 * 1_000_000
EMPTY = ("", None, None)


def ready(spark: SparkSession) -> None:
    """Keyed state with timers needs the store on disk; set here unless the session names one of its own."""
    if "HDFSBacked" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKS)


def folded(base: tuple, events: list[tuple]) -> tuple:
    """(status, applied, updated) after events (at, id, status) in their order: the first time with a status since it was last empty stays."""
    status, applied, updated = base
    for at, _, said in sorted(events):
        applied = None if said == "" else at if applied is None else applied
        status, updated = said, at
    return status, applied, updated


class Fold(StatefulProcessor):
    """Folds each key's status changes. What the watermark has passed is folded for good; younger changes are kept, so that late ones fall into their place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "status string, applied long, updated long")
        self.open = handle.getListState("open", "at long, id long, status string")

    def _settle(self, new: list[tuple], watermark: int) -> tuple[tuple, list[tuple]]:
        base = tuple(self.base.get()) if self.base.exists() else EMPTY
        events = [*(tuple(e) for e in self.open.get()), *new] if self.open.exists() else new
        old, young = [e for e in events if e[0] < watermark * 1000], [e for e in events if e[0] >= watermark * 1000]
        if old:
            base = folded(base, old)
            self.base.update(base)
        if young:
            self.open.put(young)
        else:
            self.open.clear()
        return base, young

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(i), s) for part in rows for a, i, s in zip(part["at"], part["id"], part["status"], strict=True)]
        base, young = self._settle(new, timerValues.getCurrentWatermarkInMs())
        if young:
            self.handle.registerTimer(max(e[0] for e in young) // 1000 + 1)
        status, applied, updated = folded(base, young)
        yield pd.DataFrame({"key": [key[0]], "status": [status], "applied": pd.array([applied], "Int64"), "updated": pd.array([updated], "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        base, young = self._settle([], timerValues.getCurrentWatermarkInMs())
        if not young and base[0] == "":  # nothing is left to say on this key
            self.base.clear()
        yield from ()

    def close(self) -> None:
        pass


def personal_stream(changes: DataFrame, key: str, at: str, order: str, status: str, late: str) -> DataFrame:
    """The state of each key after each batch of its status changes: (key, status, applied_at, updated_at); an empty status takes the key back.

    The last row of a key is what operators.state.personal() gives over all
    changes, as long as none is later than ``late``. State is kept for keys with
    a status, and for changes that the watermark has not passed.
    """
    ready(changes.sparkSession)
    kind = dict(changes.dtypes)[key]
    rows = changes.withWatermark(at, late).select(F.col(key).alias("key"), at, F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("id"), F.coalesce(F.col(status), F.lit("")).alias("status"))
    out = rows.groupBy("key").transformWithStateInPandas(Fold(), f"key {kind}, status string, applied long, updated long", "Update", "EventTime")
    return out.select("key", "status", F.timestamp_micros("applied").alias("applied_at"), F.timestamp_micros("updated").alias("updated_at"))


class Due(StatefulProcessor):
    """Remembers each key's last attempt, and speaks up when it is to be tried again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, good boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [(int(a), bool(g)) for part in rows for a, g in zip(part["at"], part["good"], strict=True)]
        if self.last.exists():
            seen.append(tuple(self.last.get()))
        at, good = max(seen)
        self.last.update((at, good))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((at + (STALE if good else RETRY)) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, good = self.last.get()
        yield pd.DataFrame({"key": [key[0]], "due": [at + (STALE if good else RETRY)], "reason": ["stale" if good else "retry"]})

    def close(self) -> None:
        pass


def due_stream(attempts: DataFrame, key: str, at: str, good: str, late: str) -> DataFrame:
    """(key, due_at, reason) of each key once the watermark reaches the time at which it is due: a week after a good read, six hours after a failed one.

    A later attempt puts the time off. The state is one attempt and one timer a
    key.
    """
    ready(attempts.sparkSession)
    kind = dict(attempts.dtypes)[key]
    rows = attempts.withWatermark(at, late).select(F.col(key).alias("key"), at, F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.coalesce(F.col(good), F.lit(False)).alias("good"))
    out = rows.groupBy("key").transformWithStateInPandas(Due(), f"key {kind}, due long, reason string", "Update", "EventTime")
    return out.select("key", F.timestamp_micros("due").alias("due_at"), "reason")

"""A lease that one holder has at a time, kept beside a table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .log import Log

#: Seconds after which a holder that says nothing has lost its lease.
HOLD = 2 * 3600


def acquire(spark: SparkSession, root: str, holder: str, now: float, hold: float = HOLD) -> int | None:
    """The number of a new lease, larger than all before it, or None while another one is held. A lease past its time is taken over."""
    log = Log(spark, f"{root}/lease")
    number, entry = log.last() or (-1, {"state": "free", "at": 0.0})
    if entry["state"] == "held" and entry["at"] > now - hold:
        return None
    return number + 1 if log.put(number + 1, {"state": "held", "holder": holder, "at": now, "lease": number + 1}) else None


def _next(spark: SparkSession, root: str, lease: int, state: str, now: float) -> bool:
    log = Log(spark, f"{root}/lease")
    number, entry = log.last() or (-1, {})
    return entry.get("lease") == lease and entry["state"] == "held" and log.put(number + 1, entry | {"state": state, "at": now})


def renew(spark: SparkSession, root: str, lease: int, now: float) -> bool:
    """Holds on to a lease; False if it has passed to another holder."""
    return _next(spark, root, lease, "held", now)


def release(spark: SparkSession, root: str, lease: int, now: float) -> bool:
    """Gives a lease back; False if it has passed to another holder."""
    return _next(spark, root, lease, "free", now)

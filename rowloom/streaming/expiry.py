"""Idle expiry: sessions without activity and old finished jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(activity: DataFrame, key: str, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Keys whose last activity lies more than ``hours`` before ``now``."""
    last = activity.groupBy(key).agg(F.max(ts).alias("last_used_at"))
    return last.filter(F.col("last_used_at") < now - F.expr(f"INTERVAL {hours} HOURS"))


def older_than(jobs: DataFrame, ts: str, now: Column, days: int = 30, statuses: list[str] | None = None) -> DataFrame:
    """Rows created more than ``days`` before ``now``, optionally only of end states."""
    old = jobs.filter(F.col(ts) < now - F.expr(f"INTERVAL {days} DAYS"))
    return old.filter(F.col("status").isin(*statuses)) if statuses else old


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str = "24 hours", late: str | None = None) -> DataFrame:
    """Sessions closed by a gap without activity; emitted on a stream once the gap has passed.

    A stream needs ``late``, how late an action may come, to know that a gap has passed.
    """
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("actions")).select(
        key, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("expires_at"), "actions"
    )

"""Fixed-window request limits: the first N requests of a key and window pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.plans.ranking import number_rows


def accepted(events: DataFrame, key: str, ts: str, event_id: str, limit: int, seconds: int = 60) -> DataFrame:
    """Every request with ``accepted`` and, where refused, ``retry_after`` seconds.

    Requests of a window are taken in time order; a crowded window is numbered
    second by second.
    """
    at = F.unix_timestamp(ts)
    placed = number_rows(
        events.withColumn("window_no", F.floor(at / seconds)),
        [key, "window_no"],
        [ts, event_id],
        number="__n",
        block=F.unix_timestamp(ts),
    )
    ok = F.col("__n") <= limit
    wait = F.lit(seconds) - F.pmod(at, F.lit(seconds))
    return placed.withColumn("accepted", ok).withColumn("retry_after", F.when(~ok, wait)).drop("__n")


def window_counts(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60, late: str | None = None) -> DataFrame:
    """Accepted and refused requests per key and window; the same on a stream and on a table.

    On a stream ``late`` bounds how late a request may come, and with it the
    state; without it every request counts, in update mode.
    """
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    counts = events.groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(
        key,
        F.col("window.start").alias("window_start"),
        "requests",
        F.least(F.col("requests"), F.lit(limit).cast("long")).alias("accepted"),
        F.greatest(F.col("requests") - limit, F.lit(0).cast("long")).alias("rejected"),
    )

"""Job state folded from status updates, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_STATES = ("SUCCESS", "FAILED", "CANCELLED")


def fold(updates: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Present state per job from ``(job_id, seq, ts, status, progress, error)``.

    Progress is clamped to 0..100 and 100 on success; a job starts with its
    first RUNNING update and completes with its last end state. Errors are whole
    unless ``error_chars`` cuts them.
    """
    clamped = F.when(F.col("progress").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))))
    p = F.when(F.col("status") == "SUCCESS", 100).otherwise(clamped)
    seen = p.isNotNull()
    at = F.struct("ts", "seq")
    error = F.max_by("error", F.when(F.col("error").isNotNull(), at))
    return updates.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by(p, F.when(seen, at)).cast("int").alias("progress"),
        (error if error_chars is None else F.substring(error, 1, error_chars)).alias("error"),
        F.min(F.when(F.col("status") == "RUNNING", F.col("ts"))).alias("started_at"),
        F.max_by("ts", F.when(F.col("status").isin(*END_STATES), at)).alias("completed_at"),
        F.max("ts").alias("updated_at"),
    )


def fold_stream(updates: DataFrame, error_chars: int | None = None) -> DataFrame:
    """The same fold on a stream, in update mode; updates may arrive in any order."""
    return fold(updates, error_chars)

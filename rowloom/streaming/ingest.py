"""Incremental ingest: new rows become chunks, and a later chunk of an id replaces an earlier one.

The index is a table in batches. A batch writes only its own chunks, so its
cost follows the new data; the newest chunk of an id is chosen on reading, and
``compact`` folds the batches when there are many. Beside the chunks lies a
narrow table of ids per batch: what is newest is worked out there, and only ids
that occur again meet the chunks.

Files (``ingest_files``) also keep a state per file: its signature, the last
chunk written and whether it is complete. A file whose signature is complete is
not chunked again, one that was interrupted goes on behind its last chunk, and
chunks of an earlier version of a file are left out on reading.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom.operators.chunking import resume_filter
from rowloom.session import pin, small_side
from rowloom.sources.archives import unchanged_filter

FILE = ["group", "filename"]
STATE = "group string, filename string, file_sig string, last_chunk int, completed boolean, since long, batch long, step int"
STEP = 1000  # chunks of a file between two marks of its state


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    options = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**options).start()


def _newest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of every key with the highest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def ingest(
    stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], index: str, checkpoint: str, key: str = "doc_id", order: str | None = None, **trigger
) -> StreamingQuery:
    """Run ``to_chunks`` on every batch of new rows and add the result to the index.

    A batch that runs again after a failure overwrites its own part only. Of
    several chunks of one id in a batch the one with the highest ``order`` counts;
    without ``order`` ids must be distinct within a batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        chunks = to_chunks(batch)
        chunks = _newest(chunks, [key], order) if order else chunks
        chunks.write.mode("overwrite").parquet(f"{index}/chunks/batch={number}")
        written = batch.sparkSession.read.parquet(f"{index}/chunks/batch={number}")
        written.select(key).write.mode("overwrite").parquet(f"{index}/ids/batch={number}")

    return _run(stream, write, checkpoint, trigger)


def read_index(spark: SparkSession, index: str, key: str = "doc_id") -> DataFrame:
    """The newest chunk of every id. Chunks of ids that occur once are read and not moved."""
    chunks, ids = spark.read.parquet(f"{index}/chunks"), spark.read.parquet(f"{index}/ids")
    again = ids.groupBy(key).agg(F.max("batch").alias("__newest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = chunks.join(small_side(pin(again)), key, "left")
    return met.filter(F.col("__newest").isNull() | (F.col("__newest") == F.col("batch"))).drop("__newest", "batch")


def compact(spark: SparkSession, index: str, target: str, key: str = "doc_id") -> None:
    """Write the present state of an index as the first batch of a new one."""
    read_index(spark, index, key).write.parquet(f"{target}/chunks/batch=-1")
    spark.read.parquet(f"{target}/chunks/batch=-1").select(key).write.parquet(f"{target}/ids/batch=-1")


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parts written so far; none if there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def file_state(spark: SparkSession, index: str) -> DataFrame:
    """``group, filename, file_sig, last_chunk, completed, since`` of every file, as last written; ``since`` is the batch its version began in."""
    marks = _parts(spark, f"{index}/state", STATE)
    last = marks.groupBy(*FILE).agg(F.max_by(F.struct("file_sig", "last_chunk", "completed", "since"), F.struct("batch", "step")).alias("r"))
    return last.select(*FILE, "r.*")


def ingest_files(
    stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], index: str, checkpoint: str, order: str = "seq",
    embed: Callable[[DataFrame], DataFrame] | None = None, step: int = STEP, **trigger,
) -> StreamingQuery:
    """Run ``to_chunks`` on the files of every batch that have changed and add the result to the index.

    Files are rows ``(group, filename, file_sig, <order>, ...)``; of several
    versions in a batch the one with the highest ``order`` counts. ``to_chunks``
    keeps ``group, filename, file_sig`` and adds ``chunk_index`` from 0. The
    chunks of a batch are passed through ``embed`` and written in steps of
    ``step`` chunks a file; the state is marked after each, so that a batch that
    runs again goes on where it stopped.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = pin(file_state(spark, index))
        files = unchanged_filter(_newest(batch, FILE, order), state.filter("completed"))
        chunks = pin(resume_filter(to_chunks(files), state.filter("NOT completed")))
        ends = chunks.groupBy(*FILE, "file_sig").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))
        known = state.filter("NOT completed").select(*FILE, "file_sig", "since")
        ends = pin(ends.join(known, [*FILE, "file_sig"], "left").withColumn("since", F.coalesce("since", F.lit(number).cast("long"))))
        span = ends.agg(F.min("first").alias("a"), F.max("last").alias("b")).first()
        if span.a is None:
            return
        for n in range(span.a // step, span.b // step + 1):
            some = chunks.filter(F.expr(f"chunk_index div {step}") == n)
            some = embed(some) if embed else some
            some.write.mode("overwrite").parquet(f"{index}/chunks/batch={number}/step={n}")
            upto = F.least(F.col("last"), F.lit((n + 1) * step - 1)).cast("int").alias("last_chunk")
            done = ends.filter((F.col("first") < (n + 1) * step) & (F.col("last") >= n * step))
            marks = done.select(*FILE, "file_sig", upto, (F.col("last") < (n + 1) * step).alias("completed"), "since")
            marks.write.mode("overwrite").parquet(f"{index}/state/batch={number}/step={n}")

    return _run(stream, write, checkpoint, trigger)


def read_files(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of the present version of every file. The state, one row a file, meets the chunks; they are not grouped."""
    now = pin(file_state(spark, index).select(*FILE, "file_sig", "since"))
    met = spark.read.parquet(f"{index}/chunks").join(small_side(now), [*FILE, "file_sig"])
    return met.filter("batch >= since").drop("since", "batch", "step")

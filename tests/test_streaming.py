"""Streams over several batches against their batch forms."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rowloom.operators import chunking
from rowloom.reports import streams
from rowloom.streaming import expiry, ingest, jobs, limits


def parts(spark, df, n):
    """The rows in ``n`` files that a stream reads one at a time."""
    root = tempfile.mkdtemp(prefix="rowloom-stream-")
    for i in range(n):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(root), root


def folder():
    return tempfile.mkdtemp(prefix="rowloom-out-")


def collect(spark, stream, mode):
    rows = []

    def keep(batch, number):
        rows.extend((number, r) for r in batch.collect())

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", folder()).trigger(availableNow=True).start().awaitTermination()
    return rows


def updates(spark):
    return spark.range(300).select(
        (F.col("id") % 7).alias("job_id"),
        F.col("id").alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "RUNNING", "SUCCESS", "FAILED")]), (F.xxhash64("id") % 4 + 4).cast("int") % 4 + 1).alias("status"),
        F.when(F.col("id") % 3 == 0, (F.col("id") - 100).cast("int")).alias("progress"),
        F.when(F.col("id") % 11 == 0, F.repeat(F.lit("e"), 3000)).alias("error"),
        F.floor(F.col("id") / 60).alias("part"),
    )


def test_job_state_stream_equals_batch(spark):
    df = updates(spark)
    stream, _ = parts(spark, df, 5)
    last = {}
    for number, r in collect(spark, jobs.fold_stream(stream), "update"):
        last[r.job_id] = r
    want = {r.job_id: r for r in jobs.fold(df.drop("part")).collect()}
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in want.items()}


def test_window_counts_append_after_watermark(spark):
    df = updates(spark).select("job_id", "ts", "part")
    stream, _ = parts(spark, df, 5)
    got = collect(spark, limits.window_counts(stream, "job_id", "ts", 5, 60, late="10 seconds"), "append")
    batch = {(r.job_id, r.window_start): tuple(r) for r in limits.window_counts(df, "job_id", "ts", 5, 60).collect()}
    assert got and all(batch[r.job_id, r.window_start] == tuple(r) for _, r in got)
    assert len({(r.job_id, r.window_start) for _, r in got}) == len(got)


def test_idle_sessions_close(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 100, 0), ("b", 50, 0), ("z", 9000, 1), ("z", 9001, 2)], "user string, s long, part int")
    df = df.select("user", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "part")
    stream, _ = parts(spark, df, 3)
    got = {(r.user, r.actions) for _, r in collect(spark, expiry.idle_sessions(stream, "user", "ts", "10 minutes", "1 minute"), "append")}
    assert got == {("a", 2), ("b", 1)}


def test_limits_take_the_first_of_each_window(spark):
    rows = [(1, "k", 0), (2, "k", 1), (3, "k", 59), (4, "k", 60), (5, "m", 59)]
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_040))
    got = {r.id: (r.accepted, r.retry_after) for r in limits.accepted(df, "k", "ts", "id", 2).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (True, None), 5: (True, None)}


def test_ids_of_one_batch_are_ordered(spark):
    df = spark.createDataFrame([("a", i, f"v{i}", 0) for i in range(9)] + [("b", 3, "only", 0)], "doc_id string, seq int, text string, part int").repartition(5)
    stream, _ = parts(spark, df, 1)
    index = folder() + "/index"
    ingest.ingest(stream, lambda b: b, index, folder(), order="seq").awaitTermination()
    assert sorted((r.doc_id, r.text) for r in ingest.read_index(spark, index).collect()) == [("a", "v8"), ("b", "only")]


FILES = "`group` string, filename string, file_sig string, seq int, text string, part int"


def words(files):
    """One chunk a word."""
    return files.select("group", "filename", "file_sig", F.posexplode(F.split("text", " ")).alias("chunk_index", "text"))


def test_unchanged_files_are_skipped_and_changed_ones_replaced(spark):
    rows = [
        ("g", "same", "1", 0, "a b c", 0), ("g", "same", "1", 1, "a b c", 1), ("g", "turns", "1", 0, "old one", 0), ("g", "turns", "2", 2, "new", 1),
        ("g", "turns", "x", 1, "skipped over", 1), ("g", "back", "1", 0, "p q", 0), ("g", "back", "2", 1, "r", 1), ("g", "back", "1", 2, "p q", 2), ("h", "late", "1", 0, "z", 2),
    ]
    stream, _ = parts(spark, spark.createDataFrame(rows, FILES), 3)
    index, seen = folder() + "/index", []

    def noted(files):
        seen.append(sorted(r.filename for r in files.select("filename").collect()))
        return words(files)

    ingest.ingest_files(stream, noted, index, folder()).awaitTermination()
    assert seen == [["back", "same", "turns"], ["back", "turns"], ["back", "late"]]
    got = sorted((r.filename, r.chunk_index, r.text) for r in ingest.read_files(spark, index).collect())
    assert got == [("back", 0, "p"), ("back", 1, "q"), ("late", 0, "z"), ("same", 0, "a"), ("same", 1, "b"), ("same", 2, "c"), ("turns", 0, "new")]


def test_an_interrupted_file_goes_on_behind_its_last_chunk(spark):
    text = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([("g", "long", "1", 0, text, 0), ("g", "short", "1", 0, "one two", 0)], FILES)
    stream, _ = parts(spark, df, 1)
    index, state, calls = folder() + "/index", folder(), []

    def embed(chunks):
        at = sorted(r.chunk_index for r in chunks.filter("filename = 'long'").collect())
        calls.append(at)
        if len(calls) == 3:
            raise RuntimeError("the service is away")
        return chunks

    with pytest.raises(Exception, match="the service is away"):
        ingest.ingest_files(stream, words, index, state, embed=embed, step=3).awaitTermination()
    marks = {r.filename: (r.last_chunk, r.completed) for r in ingest.file_state(spark, index).collect()}
    assert marks == {"long": (5, False), "short": (1, True)}
    ingest.ingest_files(stream, words, index, state, embed=embed, step=3).awaitTermination()
    assert calls == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [6, 7, 8], [9]]
    got = [r.text for r in ingest.read_files(spark, index).filter("filename = 'long'").orderBy("chunk_index").collect()]
    assert got == text.split(" ") and ingest.read_files(spark, index).count() == 12


def test_ingest_upserts_over_batches_and_restarts(spark):
    df = spark.createDataFrame(
        [("f1", 0, "old", 0), ("f2", 0, "two", 0), ("f1", 0, "old", 1), ("f1", 1, "new", 1), ("f3", 0, "three", 2)],
        "filename string, chunk_index int, text string, part int",
    ).withColumn("group", F.lit("G"))
    stream, root = parts(spark, df, 3)
    index, state = folder() + "/index", folder()

    def to_chunks(batch):
        return chunking.with_ids(batch, "s")

    ingest.ingest(stream, to_chunks, index, state).awaitTermination()
    got = sorted((r.filename, r.chunk_index, r.text) for r in ingest.read_index(spark, index).collect())
    assert got == [("f1", 0, "old"), ("f1", 1, "new"), ("f2", 0, "two"), ("f3", 0, "three")]
    more = spark.createDataFrame([("f4", 0, "four", "G")], "filename string, chunk_index int, text string, `group` string")
    more.coalesce(1).write.mode("append").parquet(root)
    again = spark.readStream.schema(df.drop("part").schema).parquet(root)
    ingest.ingest(again, to_chunks, index, state).awaitTermination()
    assert ingest.read_index(spark, index).count() == 5
    target = folder() + "/compact"
    ingest.compact(spark, index, target)
    assert ingest.read_index(spark, target).count() == 5


def test_a_table_streams_as_a_file_and_as_a_folder_of_parts(spark):
    for n in (1, 3):
        root = folder()
        rows = spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
        rows.repartition(n).write.parquet(f"{root}/whole")
        if n == 1:
            os.rename(next(glob.iglob(f"{root}/whole/part-*")), f"{root}/events.parquet")
        else:
            os.rename(f"{root}/whole", f"{root}/events.parquet")
        assert sorted(r.event_id for _, r in collect(spark, streams.stream_of(spark, root, "events"), "append")) == list(range(40))


def test_chunks_of_a_table_in_parts(spark):
    root = folder()
    rows = [(i, f"text {i}", "en", "s", 7) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{root}/documents.parquet")
    got = streams.ingested_chunks(spark, root).collect()
    assert len({r.doc_id for r in got}) == 30 and sum(r.chars for r in got) == sum(len(t) for _, t, *_ in rows)


def test_a_delivery_is_one_batch_of_many_files(spark, monkeypatch):
    root, made = folder(), []
    rows = [(i, "x" * (900 * (i % 4)), "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{root}/documents.parquet")
    real = streams.scratch_path
    monkeypatch.setattr(streams, "scratch_path", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(streams, "table", lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet").repartition(4))
    got = streams.ingested_files(spark, root).collect()
    assert len(glob.glob(f"{made[0]}/part-*")) == 12
    texts = {i: "again " + t if i % 3 == 0 else t for i, t, *_ in rows}
    assert sorted((r.filename, r.chunk_index, r.since) for r in got) == sorted((str(i), k, int(i % 3 == 0)) for i, t in texts.items() for k in range(max(1, -(-len(t) // 1000))))

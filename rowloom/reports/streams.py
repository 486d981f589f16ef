"""Streaming operators, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import chunking
from rowloom.reports.registry import report, table
from rowloom.session import scratch_path
from rowloom.streaming import expiry, ingest, jobs, limits


def stream_of(spark, d, name):
    """A table as a stream of its files, be it one file or a folder of parts."""
    schema = table(spark, d, name).schema
    # a pattern, since a stream takes a plain path for a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_updates(spark, stream, label):
    """Run an update-mode stream over what is there; every batch is kept under its number."""
    out = scratch_path(spark, label)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch_path(spark, label + "-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


@report("""SELECT event_id, n <= 2 AS accepted, CASE WHEN n > 2 THEN (86400 - epoch(ts)::BIGINT % 86400)::BIGINT END AS retry_after FROM
 (SELECT event_id, date_trunc('second', ts) AS ts, row_number() OVER (PARTITION BY user_id, floor(epoch(date_trunc('second', ts)) / 86400) ORDER BY events.ts, event_id) AS n FROM events)""")
def limited_requests(spark, d):
    return limits.accepted(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 86400).select("event_id", "accepted", "retry_after")


WINDOWS = """SELECT user_id, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, least(count(*), 2) AS accepted, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2"""


@report(WINDOWS)
def window_limits(spark, d):
    out = limits.window_counts(table(spark, d, "events"), "user_id", "ts", 2, 86400)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@report(WINDOWS)
def window_limits_stream(spark, d):
    log = run_updates(spark, limits.window_counts(stream_of(spark, d, "events"), "user_id", "ts", 2, 86400), "limits")
    last = log.groupBy("user_id", "window_start").agg(F.max_by(F.struct("requests", "accepted", "rejected"), "batch").alias("r"))
    return last.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "r.*")


@report("""SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOURS""")
def expired_sessions(spark, d):
    events = table(spark, d, "events")
    return expiry.expired(events, "user_id", "ts", events.agg(F.max("ts")).scalar(), 12).select("user_id")


@report("""SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAYS AND o_orderstatus IN ('F', 'P')""")
def old_jobs(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    return expiry.older_than(o, "o_orderdate", o.agg(F.max("o_orderdate")).scalar(), 365, ["F", "P"]).select("o_orderkey")


@report("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 24 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS actions FROM s GROUP BY user_id, sid""")
def idle_sessions(spark, d):
    out = expiry.idle_sessions(table(spark, d, "events"), "user_id", "ts")
    return out.select("user_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "actions")


STATUS = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END"


def updates(events):
    return events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.expr(STATUS).alias("status"),
        F.expr("CASE WHEN event_type <> 'signup' THEN cast(floor(value * 3) as int) - 20 END").alias("progress"),
        F.expr("CASE WHEN event_type = 'error' THEN concat('code ', cast(event_id as string)) END").alias("error"),
    )


FOLD = f"""WITH u AS (SELECT user_id AS job_id, event_id AS seq, ts, {STATUS} AS status, CASE WHEN event_type <> 'signup' THEN floor(value * 3)::INT - 20 END AS p,
  CASE WHEN event_type = 'error' THEN 'code ' || event_id END AS error FROM events),
v AS (SELECT *, CASE WHEN status = 'SUCCESS' THEN 100 ELSE greatest(0, least(100, p)) END AS progress FROM u)
SELECT job_id, arg_max(status, (ts, seq)) AS status, arg_max(progress, (ts, seq)) FILTER (WHERE p IS NOT NULL OR status = 'SUCCESS') AS progress, arg_max(error, (ts, seq)) FILTER (WHERE error IS NOT NULL) AS error,
 strftime(min(ts) FILTER (WHERE status = 'RUNNING'), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts) FILTER (WHERE status IN ('SUCCESS', 'FAILED', 'CANCELLED')), '%Y-%m-%d %H:%M:%S') AS completed_at,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM v GROUP BY 1"""


def _shown(df):
    stamps = ["started_at", "completed_at", "updated_at"]
    return df.select("job_id", "status", "progress", "error", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in stamps])


@report(FOLD)
def job_states(spark, d):
    return _shown(jobs.fold(updates(table(spark, d, "events"))))


@report(FOLD)
def job_states_stream(spark, d):
    log = run_updates(spark, jobs.fold_stream(updates(stream_of(spark, d, "events"))), "jobs")
    rest = [c for c in log.columns if c not in ("job_id", "batch")]
    return _shown(log.groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("job_id", "r.*"))


@report("""SELECT md5('s::' || source || '::' || lang || '::chunk::' || doc_id || '::' || substr(sha1(text), 1, 12)) AS doc_id, length(text) AS chars FROM documents""")
def ingested_chunks(spark, d):
    def to_chunks(batch):
        rows = batch.select(F.col("source").alias("filename"), F.col("lang").alias("group"), F.col("doc_id").alias("chunk_index"), "text")
        return chunking.with_ids(rows, "s")

    index = scratch_path(spark, "index")
    ingest.ingest(stream_of(spark, d, "documents"), to_chunks, index, scratch_path(spark, "ingest-state")).awaitTermination()
    return ingest.read_index(spark, index).select("doc_id", F.length("text").cast("long").alias("chars"))


@report("""
WITH f AS (SELECT doc_id, doc_id % 3 = 0 AS changed, CASE WHEN doc_id % 3 = 0 THEN 'again ' || text ELSE text END AS text FROM documents)
SELECT doc_id::VARCHAR AS filename, i::INT AS chunk_index, sha256(text[i * 1000 + 1:(i + 1) * 1000]) AS digest, CASE WHEN changed THEN 1 ELSE 0 END::BIGINT AS since
FROM f, range(0, 1000) r(i) WHERE i * 1000 < greatest(length(text), 1)
""")
def ingested_files(spark, d):
    """All documents as files, a third of them changed in a second delivery and all delivered once more: chunks of the present versions, and when each was made."""
    docs = table(spark, d, "documents")
    root, index, state = (scratch_path(spark, n) for n in ("deliveries", "file-index", "file-state"))

    def to_chunks(batch):
        last = F.greatest(F.floor((F.length("text") - 1) / 1000), F.lit(0)).cast("int")
        cut = batch.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
        return cut.select("group", "filename", "file_sig", "chunk_index", F.substring("text", F.col("chunk_index") * 1000 + 1, F.lit(1000)).alias("text"))

    # a delivery is a folder of files of its own; each run takes up all that is new since the one before, as one batch
    for n in range(3):
        changed = (F.col("doc_id") % 3 == 0) & F.lit(n > 0)
        files = docs.select(
            F.col("lang").alias("group"), F.col("doc_id").cast("string").alias("filename"), F.when(changed, "2").otherwise("1").alias("file_sig"), F.lit(n).alias("seq"),
            F.when(changed, F.concat(F.lit("again "), "text")).otherwise(F.col("text")).alias("text"),
        )
        files.write.mode("append").parquet(root)
        stream = spark.readStream.schema(files.schema).parquet(root)
        ingest.ingest_files(stream, to_chunks, index, state, step=8).awaitTermination()
    since = ingest.file_state(spark, index).select("group", "filename", "since")
    return ingest.read_files(spark, index).join(since, ["group", "filename"]).select("filename", "chunk_index", F.sha2("text", 256).alias("digest"), "since")

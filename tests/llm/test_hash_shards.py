import collections
import os

import pytest
from pyspark.sql import functions as F

from rowloom.llm import hash_shards, queries
from rowloom.session import scratch_path
from tests.llm.common import documents, empty, odd, rows
from tests.oracle import compare, database


@pytest.mark.parametrize("limit", [hash_shards.LIMIT_BYTES, 60_000, 5_000])
def test_agrees_with_sql(spark, data, limit):
    sql = queries.SQL["op2_hash_shards"].replace("16777216", str(limit))
    assert compare(hash_shards.hash_shards(documents(spark, data), limit), database(data), sql) is None


def test_shards_fit_and_were_needed(spark, data):
    limit = 20_000
    got = hash_shards.hash_shards(documents(spark, data), limit).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.n_bytes
    for r in got:
        assert size[r.shard] == r.shard_bytes and len(r.shard) == r.depth
        assert r.oversized == (r.shard_bytes > limit) and (not r.oversized or r.shard_docs == 1)
        if r.depth:
            assert sum(n for s, n in size.items() if s.startswith(r.shard[:-1])) > limit


def test_a_hot_key_is_split_by_its_texts(spark, data):
    docs = documents(spark, data).withColumn("doc_id", F.lit(5).cast("long"))
    got = hash_shards.hash_shards(docs, 30_000).collect()
    assert len(got) == docs.count() and len({r.shard for r in got}) > 8 and not any(r.oversized for r in got)
    same = docs.withColumn("text", F.lit("x" * 1000))
    got = hash_shards.hash_shards(same, 30_000).collect()
    assert {(r.shard_docs, r.oversized) for r in got} == {(docs.count(), True)}


def test_odd_rows(spark):
    docs = odd(spark)
    got = hash_shards.hash_shards(docs, 2_000)
    want = sorted(((r.doc_id, len((r.text or "").encode())) for r in docs.collect()), key=repr)
    assert rows(got, "doc_id", "n_bytes") == want
    assert hash_shards.hash_shards(empty(spark)).count() == 0


def test_written_shards(spark, data):
    docs, path = documents(spark, data), scratch_path(spark, "shards")
    hash_shards.write_shards(docs, path, 60_000)
    back = spark.read.parquet(path)
    assert rows(back, *docs.columns) == rows(docs, *docs.columns)
    local = path.removeprefix("file:")
    if os.path.isdir(local):
        assert len([d for d in os.listdir(local) if d.startswith("__shard=")]) > 5

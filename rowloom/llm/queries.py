"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import byte_bpe, compression_quality, hash_shards, id_shards, interval_search, language_crf, line_rules, merkle_manifest, mixture_packing, substrings, variant_simhash, weighted_fingerprints, weighted_minhash
from rowloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """List a query under its name, with the SQL that states its result."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query()
def op8_line_rules(spark, folder):
    """Base measures and the line-frequency verdict of every document."""
    return line_rules.line_rules(documents(spark, folder))


@query()
def op4_substring_dedup(spark, folder):
    """Words left of every document once windows of 35 words that occur elsewhere are gone."""
    return substrings.substring_dedup(documents(spark, folder))


@query()
def op7_weighted_minhash(spark, folder):
    """The near-duplicate class of every document and how many other texts it is linked to."""
    return weighted_minhash.near_duplicates(documents(spark, folder))


@query()
def op10_id_shards(spark, folder):
    """Ids of every document, written to indexed shards and read back by key."""
    where, manifest = id_shards.write_shards(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return id_shards.read_shards(where, manifest)


@query()
def op9_byte_bpe(spark, folder):
    """Ids of every document by a rank file, and the text decoded from them, as digests."""
    return byte_bpe.digests(documents(spark, folder), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query()
def op5_mixture_packing(spark, folder):
    """Where each piece of every document lies in sequences of 2048 tokens, mixed by source."""
    return mixture_packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op1_compression_quality(spark, folder):
    """The quality score of every document by compression against good and bad text."""
    docs = documents(spark, folder)
    model = compression_quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return compression_quality.score(docs, model)


@query()
def op3_language_crf(spark, folder):
    """The language of every document from the posteriors of its words."""
    docs = documents(spark, folder)
    return language_crf.predict(docs, language_crf.fit(docs))


@query()
def op6_weighted_fingerprints(spark, folder):
    """Fingerprints of every document and its edited text, and how alike they are."""
    return weighted_fingerprints.edited_fingerprints(documents(spark, folder))


@query("""
WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h2 FROM documents),
b AS (SELECT *, lpad(bin(h), 60, '0') || lpad(bin(h2), 60, '0') AS bits FROM r),
c AS (SELECT bits, sum(n) AS n, count(*) AS m FROM b GROUP BY 1),
t AS (SELECT depth, bits[1:depth] AS shard, sum(n)::BIGINT AS bytes, sum(m)::BIGINT AS docs, sum(n) > 16777216 AND min(bits) <> max(bits) AS splits
  FROM c, range(0, 121) d(depth) GROUP BY 1, 2),
s AS (SELECT x.* FROM t x LEFT JOIN t y ON y.depth = x.depth - 1 AND y.shard = x.shard[1:x.depth - 1] WHERE NOT x.splits AND (x.depth = 0 OR y.splits))
SELECT doc_id, n::BIGINT AS n_bytes, depth::INT AS depth, shard, bytes AS shard_bytes, docs AS shard_docs, bytes > 16777216 AS oversized
FROM b JOIN s ON bits[1:depth] = shard
""")
def op2_hash_shards(spark, folder):
    """The shard of every document under a limit of 16 MiB."""
    return hash_shards.hash_shards(documents(spark, folder))


@query()
def op11_variant_simhash(spark, folder):
    """The fingerprint of every document and the component it belongs to at two bits or fewer."""
    return variant_simhash.near_duplicates(documents(spark, folder))


@query(merkle_manifest.SQL)
def op12_merkle_manifest(spark, folder):
    """Leaf, roots and proof of every document, and the root folded from it or from what tampering made of it."""
    return merkle_manifest.document_manifest(documents(spark, folder))


@query(interval_search.SQL)
def op13_interval_search(spark, folder):
    """The 20 best documents of every benchmark item."""
    return interval_search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))

"""Sharding by extendible hashing, with DataFrame functions only.

A row has 120 hash bits: 60 of its key and, so that a key that many rows share
can be split as well, 60 of its text. A shard is a prefix of these bits. A shard
over the byte limit is split on the next bit, and only such a shard, until each
fits or all its rows have equal bits.

The trie of prefixes is counted from the bottom: one aggregation sums the bytes
of fine cells, about ``FINE`` for each shard the limit calls for, all their
ancestors are summed from the cells, and the shards are the first prefixes from
the root that fit. Cells that do not fit are counted again on further bits, with
their own rows only. The table of shards grows with the bytes over the limit and
stays a table.

Defined cases: a null text has no bytes; a null key is hashed as an empty text;
equal rows have equal bits and stay together; a shard that cannot be split is
marked as oversized; an empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.handover import hand_over

LIMIT_BYTES = 16 << 20
#: cells that are counted for each shard that the limit calls for, as a power of two
FINE = 4
_HALF = 60


def _bits(text: Column) -> Column:
    """60 bits of a text's md5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text", *keep: Column) -> DataFrame:
    """``h, h2, n_bytes`` of every row and what is asked for besides."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        *keep,
        _bits(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("h"),
        _bits(body).alias("h2"),
        F.octet_length(body).cast("long").alias("n_bytes"),
    )


def _prefix(depth: int) -> tuple[Column, Column]:
    """The first ``depth`` bits, in two longs."""
    if depth <= _HALF:
        return F.shiftright("h", _HALF - depth), F.lit(0).cast("long")
    return F.col("h"), F.shiftright("h2", 2 * _HALF - depth)


def _ancestor(depth: Column) -> tuple[Column, Column]:
    """``_prefix`` at a depth that differs from row to row."""
    short = depth <= _HALF
    p = F.when(short, F.call_function("shiftright", F.col("h"), (F.lit(_HALF) - F.least(depth, F.lit(_HALF))).cast("int"))).otherwise(F.col("h"))
    q = F.when(short, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftright", F.col("h2"), (F.lit(2 * _HALF) - F.greatest(depth, F.lit(_HALF))).cast("int"))
    )
    return p, q


def _nodes(rows: DataFrame, top: int, bottom: int, limit: int) -> DataFrame:
    """Every prefix of ``top`` to ``bottom`` bits with its bytes, rows and whether it is to be split."""
    ends = [F.min(F.struct("h", "h2")).alias("lo"), F.max(F.struct("h", "h2")).alias("hi")]
    p, q = _prefix(bottom)
    cells = rows.groupBy(p.alias("p"), q.alias("q")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ends)
    depths = F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth")
    up = cells.select("bytes", "rows", "lo", "hi", F.col("lo.h").alias("h"), F.col("lo.h2").alias("h2"), depths)
    p, q = _ancestor(F.col("depth"))
    nodes = up.withColumn("p", p).withColumn("q", q).groupBy("depth", "p", "q")
    nodes = nodes.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return nodes.withColumn("splits", (F.col("bytes") > limit) & (F.col("lo") != F.col("hi")))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``depth, p, q, bytes, rows, oversized`` of every shard, from ``h, h2, n_bytes`` of every row."""
    total = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    top, bottom = 0, min(2 * _HALF, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINE)
    found, open_, shard = None, rows, ["depth", "p", "q", "bytes", "rows"]
    while True:
        nodes = hand_over(_nodes(open_, top, bottom, limit), "shard-nodes")
        whole = nodes.filter("NOT splits").select("*", "lo.h", "lo.h2")
        p, q = _ancestor(F.col("depth") - 1)
        parents = nodes.filter("splits").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("pp"), F.col("q").alias("pq"))
        shards = whole.withColumn("pp", p).withColumn("pq", q).join(parents, ["depth", "pp", "pq"], "left_semi").select(*shard)
        if top == 0:
            shards = shards.union(whole.filter("depth = 0").select(*shard))
        found = shards if found is None else found.union(shards)
        left = nodes.filter(f"splits AND depth = {bottom}").select("p", "q")
        if bottom == 2 * _HALF or not left.limit(1).count():
            break
        p, q = _prefix(bottom)
        open_ = hand_over(open_.withColumn("p", p).withColumn("q", q).join(left, ["p", "q"], "left_semi").drop("p", "q"), "open-shards")
        top, bottom = bottom, min(2 * _HALF, bottom + 8)
    return hand_over(found.withColumn("oversized", F.col("bytes") > limit), "shards")


def name(depth: Column, p: Column, q: Column) -> Column:
    """A shard's bits as text; the shard of everything has an empty name."""
    first = F.lpad(F.conv(p.cast("string"), 10, 2), F.least(depth, F.lit(_HALF)).cast("int"), "0")
    more = F.lpad(F.conv(q.cast("string"), 10, 2), (F.greatest(depth, F.lit(_HALF)) - _HALF).cast("int"), "0")
    return F.concat(F.when(depth == 0, F.lit("")).otherwise(first), F.when(depth > _HALF, more).otherwise(F.lit("")))


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` with the shard that their bits lead to; each row tries the depths that occur, of which there are few."""
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect())
    keep = [c for c in rows.columns if c not in ("h", "h2")]
    tried = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.expr("array_repeat(0, 0)")))
    p, q = _ancestor(F.col("depth"))
    placed = tried.withColumn("p", p).withColumn("q", q).join(shards, ["depth", "p", "q"])
    return placed.select(*keep, "depth", name(F.col("depth"), F.col("p"), F.col("q")).alias("shard"), "bytes", "rows", "oversized")


def hash_shards(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, depth, shard, shard_bytes, shard_docs, oversized`` of every document."""
    rows = hand_over(hashed(docs, key, text, F.col(f"`{key}`").alias("doc_id")), "hashed")
    out = assign(rows, directory(rows, limit))
    return out.select("doc_id", "n_bytes", "depth", "shard", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_docs"), "oversized")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` to ``path`` with a folder of its own for each shard; a shard is written by one task, as it fits the limit."""
    rows = hashed(docs, key, text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    placed = assign(rows, directory(rows.select("h", "h2", "n_bytes"), limit))
    placed = placed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], F.concat(F.lit("b"), "shard").alias("__shard"))
    placed.repartition("__shard").write.partitionBy("__shard").parquet(path)

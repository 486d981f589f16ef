"""SimHash near-dedup by deletion variants: fewer segments than usual, one wildcard each.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64
hashes (seed 42) of a text's shingles. Two fingerprints are linked at
``distance`` or fewer differing bits. Cut into ``distance // 2 + 1`` segments,
two linked fingerprints have a segment that differs in at most one bit. Every
segment is indexed as it is and once per bit with that bit as a wildcard, so
that such a pair has an index row in common: candidates come from equality on
index rows alone and are verified by counting differing bits.

Equal fingerprints are collapsed first, so copies cost nothing. A bucket of two
is a pair by its smallest and largest member; larger ones are joined with
themselves up to ``LIMIT`` members. All members of buckets beyond that take an
exact way that grows with their number and not with its square: each fingerprint
lists itself and its 64 neighbours at one bit, fingerprints that list the same
value are at most two bits apart, any two that are at most two bits apart list a
common value, and no value can be listed by more than 65.

Defined cases: a null text or one without words has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle; rows
are kept apart, so equal ids stay separate rows; a null id never names a
component unless all of its rows have none, and is null then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import spans
from rowloom.llm.components import components
from rowloom.llm.handover import hand_over

BITS = 64
SHINGLE = 3
SEED = 42
#: members of a bucket that are paired by a self-join; larger buckets go by neighbours
LIMIT = 64
#: shingles whose bits are counted at once
CHUNK = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank behind each, and where each word starts and ends there."""
    size = ends - starts
    first = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inside + np.repeat(first, size)] = data[inside + np.repeat(starts, size)]
    return out.tobytes(), first, first + size


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text as unsigned 64 bits."""
    data, bounds = spans.flat(texts)
    starts, ends, wb = spans.words(data, bounds)
    body, a, b = _joined(_LOWER[data], starts, ends)
    n_words = np.diff(wb)
    n = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = wb[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + shingle, wb[doc + 1]) - 1
    counts = np.zeros((len(n), BITS), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(doc), CHUNK):
        of = doc[at : at + CHUNK]
        lo, hi = a[first[at : at + CHUNK]].tolist(), b[last[at : at + CHUNK]].tolist()
        h = np.fromiter((digest(body[x:y], SEED) for x, y in zip(lo, hi)), dtype="<u8", count=len(lo))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        counts[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, text: str = "text", keep: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, print)`` of every row, the print as a long with the same 64 bits."""
    src = docs.select(F.col(f"`{keep}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                found = text_fingerprints(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, print long")


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(distance: int) -> list[tuple[int, int]]:
    """For each kind of index row the bits it keeps and its wildcard bit, 0 for a segment as it is."""
    count = distance // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        segment = (1 << hi) - (1 << lo)
        out.append((_long(segment), 0))
        out += [(_long(segment & ~(1 << i)), _long(1 << i)) for i in range(lo, hi)]
    return out


def index_rows(prints: DataFrame, distance: int) -> DataFrame:
    """``(print, slot, value, wild)``: the index rows of distinct fingerprints."""
    kinds = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(w).cast("long").alias("wild")) for m, w in masks(distance)])
    rows = prints.select("print", F.posexplode(kinds).alias("slot", "kind"))
    return rows.select("print", "slot", F.col("print").bitwiseAND(F.col("kind.mask")).alias("value"), F.col("kind.wild").alias("wild"))


def near_links(prints: DataFrame, distance: int = 2, limit: int = LIMIT) -> DataFrame:
    """``(a, b)``, ``a < b``: links that connect distinct fingerprints exactly as all pairs at ``distance`` would.

    ``prints`` has one column and is cheap to read again. Every link is a true
    pair. Members of buckets of over ``limit`` are linked through common neighbours.
    """
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    limit = max(limit, 2)
    # each row becomes 66 index rows, so that few small files would be few long tasks
    index = index_rows(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print"), distance)
    buckets = index.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
    buckets = hand_over(buckets.filter("n > 1"), "buckets")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance
    pairs = buckets.filter("n = 2").filter(near("a", "b")).select("a", "b")

    # both sides by shuffle at every size: buckets grow faster than the fingerprints, and a hot one can be split
    large = buckets.filter("n > 2").select("slot", "value", "n").hint("merge")
    members = hand_over(index.join(large, ["slot", "value"]), "members")
    few = members.filter(F.col("n") <= limit)
    left = few.select("slot", "value", "wild", F.col("print").alias("a"))
    right = few.select("slot", "value", F.col("print").alias("b"))
    met = left.join(right, ["slot", "value"]).filter(F.col("a") < F.col("b"))
    # equal segments meet in the row of the segment as it is
    met = met.filter((F.col("wild") == 0) | (F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.col("wild")) != 0))
    pairs = pairs.union(met.filter(near("a", "b")).select("a", "b"))

    flips = F.array(*[F.lit(_long(f)).cast("long") for f in [0, *[1 << i for i in range(BITS)]]])
    many = members.filter(F.col("n") > limit).select("print").distinct()
    listed = many.select("print", F.explode(flips).alias("flip"))
    listed = listed.groupBy(F.col("print").bitwiseXOR(F.col("flip")).alias("value")).agg(F.collect_list("print").alias("all"))
    listed = listed.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return pairs.union(listed.filter("a < b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", keep: str = "doc_id", distance: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: 16 hex digits, and the smallest id that links lead to."""
    found = hand_over(fingerprints(docs, text, keep, shingle), "prints")
    nodes = hand_over(found.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    linked = components(hand_over(near_links(nodes.select("print"), distance), "links")).withColumnRenamed("node", "print")
    nodes = nodes.join(linked, "print", "left").withColumn("root", F.coalesce("root", "print"))
    nodes = hand_over(nodes, "roots")
    first = hand_over(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    # one row a fingerprint and one row a component: joins whose hot side can be split
    named = hand_over(nodes.select("print", "root").join(first, "root").select("print", "component_id"), "named")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return found.join(named, "print").select("doc_id", hexed, "component_id")

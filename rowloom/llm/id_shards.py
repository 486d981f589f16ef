"""Token-id files with a minimal perfect hash index: constant-time access by document key.

A shard is one file over a range of ascending keys:

    magic and header length | header (JSON) | ids, packed little-endian |
    keys (i64), key is there (u8), first id (u64) and ids (u32) of every document |
    bit arrays of the hash levels, ones before each word | per slot: fingerprint (u32), document (u32), documents (u32)

A key is hashed by levels. Level l has twice as many bits as keys that are left;
keys that are alone on their bit stay there, the others go to the next level.
The rank of a key's bit is its slot, so n keys have the slots 0 to n - 1 and a
lookup reads a few bits, one slot and one run of ids, whatever n is. The slot
holds a fingerprint of the key, which turns other keys away with a chance of
error of 2**-32, and the first and the number of documents with that key.

Tasks write files under names of their own and only those of tasks that
succeeded are listed in the manifest, a table in the shared folder; a task that
is run again writes another file. Positions over all documents come from the
totals of the shards before.

Defined cases: a null text has no ids but the end id; documents of a null key
come first and are only reached by position; documents that share a key share
a slot, in the order of their texts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import spans, word_tokens
from rowloom.llm.handover import hand_over
from rowloom.session import scratch_path

END_ID = 1
#: bytes of ids at which a task begins another shard
SHARD_BYTES = 32 << 20
MAGIC = b"IDSHARD1"
_MAX_LEVELS = 64
_WHERE = "file string, part int, number int, first_key long, documents long, ids long"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return spans.mix(keys.astype(np.int64).view(np.uint64) ^ spans.mix(np.full(1, seed + 1, np.uint64)))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0 to n - 1 for n different keys."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], keys
        while len(left):
            if len(levels) == _MAX_LEVELS:
                raise ValueError("keys are not different")
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = (_hash(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            levels.append(bits)
            sizes.append(size)
            left = left[~alone[at]]
        return cls(levels, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 where no level has a bit for it; other keys may get any slot."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word = self.words[self.starts[level] + at // 64]
            bit = (at % 64).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[self.starts[level] + at // 64] + np.bitwise_count(lower)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out


def pack(ids: np.ndarray, keys: np.ndarray, there: np.ndarray, counts: np.ndarray) -> bytes:
    """One shard of documents in ascending key order; documents without a key come first."""
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype("<u8")
    own = np.flatnonzero(there)
    different, first, n = np.unique(keys[own], return_index=True, return_counts=True)
    table = PerfectHash.build(different)
    slot = table.slots(different)
    marks, at, many = (np.zeros(len(different), "<u4") for _ in range(3))
    marks[slot], at[slot], many[slot] = _fingerprint(different), own[first] if len(own) else 0, n
    parts = {
        "ids": ids, "keys": keys.astype("<i8"), "there": there.astype("u1"), "starts": starts, "counts": counts.astype("<u4"),
        "levels": table.words.astype("<u8"), "fingerprints": marks, "documents": at, "repeats": many,
    }
    where, offset = {}, 0
    for name, x in parts.items():
        where[name] = [offset, len(x), x.dtype.str]
        offset += x.nbytes
    header = json.dumps({"parts": where, "sizes": table.sizes}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *[x.tobytes() for x in parts.values()]])


class Shard:
    """An open shard. The index is read once; ids are read where they are asked for."""

    def __init__(self, folder_fs: fs.FileSystem, path: str):
        self.file = folder_fs.open_input_file(path)
        head = self.file.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a shard: {path}")
        size = int.from_bytes(head[8:], "little")
        header = json.loads(self.file.read_at(size, 16))
        self.parts, self.base = header["parts"], 16 + size
        for name in self.parts:
            if name not in ("ids", "levels"):
                setattr(self, name, self.part(name))
        words, levels, at = self.part("levels"), [], 0
        for n in header["sizes"]:
            levels.append(words[at : at + n // 64])
            at += n // 64
        self.table = PerfectHash(levels, header["sizes"])

    def part(self, name: str, start: int = 0, length: int | None = None) -> np.ndarray:
        offset, n, kind = self.parts[name]
        width = np.dtype(kind).itemsize
        length = n - start if length is None else length
        return np.frombuffer(self.file.read_at(length * width, self.base + offset + start * width), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of every key; (-1, 0) for keys that are not here."""
        slot = self.table.slots(keys)
        ok = slot >= 0
        ok[ok] = self.fingerprints[slot[ok]] == _fingerprint(keys[ok])
        first, n = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        first[ok], n[ok] = self.documents[slot[ok]], self.repeats[slot[ok]]
        return first, n

    def ids_of(self, document: int) -> np.ndarray:
        return self.part("ids", int(self.starts[document]), int(self.counts[document]))

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents of one key."""
        first, n = self.find(np.array([key], dtype=np.int64))
        return [self.ids_of(i) for i in range(first[0], first[0] + n[0])] if n[0] else []

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the ids of all documents in ascending key order; the folder and the manifest of its files.

    Keys are integers; what cannot be read as one is stored like a null key, first and found by position only.
    """
    folder = folder or scratch_path(docs.sparkSession, "id-shards")
    src = docs.select(F.col(f"`{key}`").try_cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    ordered = src.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = word_tokens.encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        held: list[bytes] = []
        keys: list[np.ndarray] = []
        there: list[np.ndarray] = []
        size, number = 0, 0

        def close() -> pa.RecordBatch:
            counts = np.array([len(x) for x in held], dtype=np.int64) // encoder.dtype.itemsize
            all_keys, ok = np.concatenate(keys), np.concatenate(there)
            body = pack(np.frombuffer(b"".join(held), encoder.dtype), all_keys, ok, counts)
            name = f"{task:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(body)
            first = int(all_keys[ok][0]) if ok.any() else None
            return pa.RecordBatch.from_pylist(
                [{"file": name, "part": task, "number": number, "first_key": first, "documents": len(held), "ids": int(counts.sum())}],
                schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("first_key", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]),
            )

        for batch in batches:
            for part in spans.slices(batch, "text"):
                new = [x + end for x in encoder.encode(part.column("text").to_pylist())]
                column = part.column("key")
                held += new
                keys.append(pc.fill_null(column, 0).to_numpy(zero_copy_only=False))
                there.append(pc.is_valid(column).to_numpy(zero_copy_only=False))
                size += sum(map(len, new))
                if size >= SHARD_BYTES:
                    yield close()
                    held, keys, there, size, number = [], [], [], 0, number + 1
        if held:
            yield close()

    return folder, hand_over(ordered.mapInArrow(run, _WHERE), "id-manifest")


def positioned(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: the ids of all shards before each one.

    Shards follow tasks, tasks follow the key ranges. Totals of tasks are added
    up first, one row each, then the few shards of a task.
    """
    tasks = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    tasks = tasks.select("part", F.coalesce(before, F.lit(0)).alias("task_base"))
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    out = manifest.withColumn("own", F.coalesce(F.sum("ids").over(own), F.lit(0))).join(tasks, "part")
    return out.withColumn("base", (F.col("task_base") + F.col("own")).cast("long")).drop("task_base", "own")


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files through their index.

    Each key is looked up and the run of ids it leads to is read; documents
    without a key are read by position.
    """
    shards = positioned(manifest)
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    shards = shards.select("file", "base").repartition(max(cores, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(store, f"{path}/{row['file']}")
                present = shard.there.astype(bool)
                at = np.flatnonzero(~present)
                first, n = shard.find(np.unique(shard.keys[present]))
                if len(first) and first.min() < 0:
                    raise ValueError(f"a key is missing in {row['file']}")
                at = np.concatenate([at, np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]).astype(np.int64)
                starts, counts = shard.starts[at].astype(np.int64), shard.counts[at].astype(np.int64)
                ids = shard.part("ids").astype("<u4")  # a shard is bounded
                crc = [zlib.crc32(ids[a : a + c]) for a, c in zip(starts.tolist(), counts.tolist())]
                shard.close()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.keys[at].astype(np.int64), mask=~present[at]),
                        pa.array(starts + row["base"]),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` of the asked keys: sent to the shards whose range may hold them, and read there by the index.

    Keys meet the manifest by range: the shard's task is found among the first
    keys, of which there is one row a shard; they are sent to all tasks only
    while they are few enough for Spark's own check.
    """
    ranges = manifest.filter("first_key IS NOT NULL").select("file", "first_key", "part", "number")
    after = F.lead("first_key").over(Window.orderBy("part", "number"))
    ranges = ranges.withColumn("next_key", after)
    asked = keys.select(F.col(f"`{key}`").try_cast("long").alias("key")).filter("key IS NOT NULL").distinct()
    hits = asked.join(ranges, (F.col("key") >= F.col("first_key")) & (F.col("next_key").isNull() | (F.col("key") <= F.col("next_key"))))
    hits = hits.select("file", "key").repartition("file").sortWithinPartitions("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        name, shard = None, None
        for batch in batches:
            found_keys, found_ids = [], []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if shard:
                        shard.close()
                    name, shard = row["file"], Shard(store, f"{path}/{row['file']}")
                for ids in shard.get(row["key"]):
                    found_keys.append(row["key"])
                    found_ids.append(ids.astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(found_keys, pa.int64()), pa.array(found_ids, pa.list_(pa.int64()))], names=["key", "ids"])
        if shard:
            shard.close()

    return hits.mapInArrow(run, "key long, ids array<long>")

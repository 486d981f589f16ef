"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target token shares.

Each source is a queue of the tokens of its documents in id order. In every
round, one window long, a queue earns its share of a window; it keeps what is
less than a token, or less than ``MIN_PIECE`` tokens, as a deficit for the next
round and otherwise sends all it has earned. Rounds follow each other without a
gap and are cut into windows, so that only the last window can be short.

What a queue has sent before a round depends only on the round's number, its
share and its length. So the deficits at any point, across windows and
partitions, follow from a few numbers per queue, and every document finds the
places of its own pieces: tasks need no state of other tasks. A queue that runs
dry leaves its part of the rounds to the others.

Shares default to the sources' parts of all tokens, so that all queues run dry
together. Sources with a target and the largest others, ``MAX_QUEUES`` less one,
have queues of their own. All others share the last one, which is filled in the
same way: they are dealt to about as many bins as a bin has sources, the bins
fill the queue by deficit round-robin and the sources their bin, so every source
keeps its own share. What a source leaves that runs dry goes to its bin first.
The tables of queues are the only thing sent to all tasks, without names.

Defined cases: a null text is an empty one and consists of the end id; null
sources are a source of their own; documents with equal ids follow each other
in the order of their texts; a null id is kept as it is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import spans, word_tokens
from rowloom.llm.handover import hand_over

WINDOW = 2048
END_ID = 1
MIN_PIECE = 64
MAX_QUEUES = 1024
#: parts of a token in which shares are counted
_UNIT = 16


class Mixture:
    """The queues: their lengths in tokens and what they earn in a round."""

    def __init__(self, lengths: list[int], shares: list[float], window: int = WINDOW, min_piece: int = MIN_PIECE):
        self.lengths = np.array(lengths, dtype=np.int64)
        total = float(sum(shares)) or 1.0
        earned = [max(1, round(window * s / total * (1 << _UNIT))) for s in shares]
        #: rounds between two services of a queue, and what it sends then
        self.every = np.array([-(-(min_piece << _UNIT) // e) for e in earned], dtype=np.int64)
        self.sends = np.array(earned, dtype=np.int64) * self.every
        self.window = window

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has sent before each round (row)."""
        return np.minimum(self.lengths, ((rounds[:, None] // self.every) * self.sends) >> _UNIT)

    def places(self, queue: np.ndarray, first: np.ndarray, count: np.ndarray, cut_windows: bool = True) -> tuple[np.ndarray, ...]:
        """Pieces of runs of ``count`` tokens from ``first`` of their queue: run, start in it, length and place overall."""
        sends, every = self.sends[queue], self.every[queue]
        serve = lambda x: (((x + 1) << _UNIT) - 1) // sends  # noqa: E731  the service that sends token x
        low, high = serve(first), serve(first + count - 1)
        run, step = _expand(high - low + 1)
        j = low[run] + step
        begin = (j * sends[run]) >> _UNIT
        a = np.maximum(first[run], begin)
        b = np.minimum(first[run] + count[run], ((j + 1) * sends[run]) >> _UNIT)
        rounds, where = np.unique((j + 1) * every[run] - 1, return_inverse=True)
        place = np.empty(len(a), dtype=np.int64)
        rows = max(1, (1 << 21) // len(self.lengths))
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(0, len(rounds) + rows, rows))
        for i, (x, y) in enumerate(zip(edges, edges[1:])):
            part = rounds[i * rows : (i + 1) * rows]
            before, after = self.sent(part), self.sent(part + 1)
            ahead = before.sum(axis=1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
            at = order[x:y]
            place[at] = ahead[where[at] - i * rows, queue[run[at]]]
        place += a - begin
        keep = b > a
        run, a, b, place = run[keep], a[keep], b[keep], place[keep]
        if not cut_windows:
            return run, a - first[run], b - a, place
        # cut at the ends of windows
        piece, step = _expand((place + b - a - 1) // self.window - place // self.window + 1)
        cut = (place[piece] // self.window + step) * self.window
        begin = np.maximum(place[piece], cut)
        end = np.minimum(place[piece] + (b - a)[piece], cut + self.window)
        return run[piece], a[piece] - first[run[piece]] + begin - place[piece], end - begin, begin


class Bins:
    """Many sources that fill one queue: a mixture of bins, and of the sources of every bin."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray, shares: np.ndarray, window: int, min_piece: int):
        """Sources in the order of their bins, which count from 0."""
        self.lengths, self.shares, self.window, self.min_piece = lengths, shares, window, min_piece
        self.bounds = np.searchsorted(bins, np.arange((bins[-1] if len(bins) else -1) + 2))
        total = lambda x: [x[a:b].sum() for a, b in zip(self.bounds, self.bounds[1:])]
        self.outer = self.mixture(total(lengths), total(shares))

    def mixture(self, lengths, shares) -> Mixture:
        """Of rounds in which a queue earns a least piece on average: a token here is far more than one of all tokens."""
        return Mixture(lengths, shares, max(1, min(self.window, max(1, self.min_piece) * len(lengths))), self.min_piece)

    def places(self, bin_: np.ndarray, number: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """As ``Mixture.places``, for the source with a ``number`` in its bin, and places in the common queue."""
        found = []
        for i in np.unique(bin_):
            at, (a, b) = np.flatnonzero(bin_ == i), self.bounds[i : i + 2]
            inner = self.mixture(self.lengths[a:b], self.shares[a:b])
            run, start, length, place = inner.places(number[at], first[at], count[at], False)
            found.append((at[run], start, length, place, np.full(len(run), i)))
        run, start, length, place, owner = (np.concatenate(x) for x in zip(*found))
        again, more, length, place = self.outer.places(owner, place, length, False)
        return run[again], start[again] + more, length, place


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as counted, and its number within."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def tokenized(docs: DataFrame, tokenizer: str, text: str, source: str, doc_id: str, end_id: int, kept: int) -> DataFrame:
    """``part, source, doc_id, first, count, ids`` in queue order: ids of a document, and those of its source before it in its part."""
    src = docs.select(
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
    )
    ordered = src.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_number = TaskContext.get().partitionId()
        encoder = word_tokens.encoder(tokenizer, kept)
        end = np.array([end_id], encoder.dtype).tobytes()
        sent: dict[str, int] = {}
        for batch in batches:
            for part in spans.slices(batch, "text"):
                ids = [x + end for x in encoder.encode(part.column("text").to_pylist())]
                counts = [len(x) // encoder.dtype.itemsize for x in ids]
                first = []
                for s, n in zip(part.column("source").to_pylist(), counts):
                    first.append(sent.get(s, 0))
                    sent[s] = first[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part_number] * len(part), pa.int32()), part.column("source"), part.column("doc_id"),
                        pa.array(first, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["part", "source", "doc_id", "first", "count", "ids"],
                )

    kind = src.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"part int, source string, doc_id {kind}, first long, count long, ids binary")


def queues(totals: DataFrame, max_queues: int = MAX_QUEUES, first: Iterable[str] = ()) -> tuple[list[tuple[str | None, int]], DataFrame]:
    """Names and tokens of the queues, and ``totals`` with the queue of each row and the queue's tokens before it.

    ``totals`` has a row ``(part, source, n)`` per task and source. The queue
    without a name holds all sources after those of ``first`` and the largest.
    """
    spark = totals.sparkSession
    sums = totals.groupBy("source").agg(F.sum("n").alias("n"))
    named_first = spark.createDataFrame([(s, True) for s in first], "source string, target boolean")
    sums = sums.join(F.broadcast(named_first), "source", "left")
    top = sums.orderBy(F.col("target").isNull(), F.desc("n"), "source").limit(max_queues - 1).collect()
    named = sorted((r.source, r.n) for r in top)
    rest = (totals.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in named)
    found: list[tuple[str | None, int]] = [*named, *([(None, rest)] if rest else [])]
    ids = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(named)], "source string, queue int")
    numbered = totals.join(F.broadcast(ids), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(named))))
    before = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    return found, numbered.select("part", "source", "queue", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def binned(rest: DataFrame, shares: dict[str, float], total: int) -> tuple[DataFrame, pa.Table]:
    """``(source, bin, number)`` of the sources in ``rest``, and ``bin, n, share`` in their order without names."""
    sums = rest.groupBy("source").agg(F.sum("n").alias("n"))
    bins = math.isqrt(max(0, sums.count() - 1)) + 1
    targets = rest.sparkSession.createDataFrame(list(shares.items()), "source string, share double")
    sums = sums.join(F.broadcast(targets), "source", "left").withColumn("share", F.coalesce("share", F.col("n") / F.lit(total)))
    sums = sums.withColumn("bin", F.pmod(F.xxhash64("source"), F.lit(bins)))
    within = Window.partitionBy("bin").orderBy("source")
    sums = hand_over(sums.withColumn("number", F.row_number().over(within).cast("long") - 1), "packing-bins")
    table = sums.select("bin", "number", "n", "share").toArrow().sort_by([("bin", "ascending"), ("number", "ascending")])
    return sums.select("source", "bin", "number"), table


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    shares: dict[str, float] | None = None,
    min_piece: int = MIN_PIECE,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    end_id: int = END_ID,
    with_ids: bool = False,
    kept_words: int = word_tokens.KEPT_WORDS,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece, and its packed ids if asked for.

    ``shares`` are target shares by source; a source it does not name keeps its
    part of all tokens. The number of sources is not limited. A Python worker
    keeps the ids of ``kept_words`` words, about 180 bytes each.
    """
    shares = {k: float(v) for k, v in (shares or {}).items()}
    rows = hand_over(tokenized(docs, tokenizer, text, source, doc_id, end_id, kept_words), "packing-ids")
    totals = hand_over(rows.groupBy("part", "source").agg(F.sum("count").alias("n")), "packing-totals")
    found, bases = queues(totals, first=shares)
    total = sum(n for _, n in found) or 1
    targets = [shares.get(name, n / total) for name, n in found if name is not None]
    tail, bins = len(targets), None
    bases = bases.filter(F.col("queue") < tail).select("part", "source", "queue", "base", F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("number"))
    if len(found) > tail:
        rest = totals.join(bases.select("source").distinct(), "source", "left_anti")
        numbers, table = binned(rest, shares, total)
        before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        rest = rest.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(numbers, "source")
        bases = bases.union(rest.select("part", "source", F.lit(tail).alias("queue"), "base", "bin", "number"))
        bin_, n, share = (table.column(c).to_numpy() for c in ("bin", "n", "share"))
        bins = Bins(bin_, n, share, window, min_piece)
        targets.append(float(share.sum()))
    mixture = docs.sparkSession.sparkContext.broadcast((Mixture([n for _, n in found], targets, window, min_piece), bins))
    placed = rows.join(bases, ["part", "source"])
    placed = placed.select("doc_id", "queue", "bin", "number", (F.col("base") + F.col("first")).alias("first"), "count", "ids")
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [f.split(" ")[0] for f in fields.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mix, bins), kind = mixture.value, word_tokens.encoder(tokenizer, kept_words).dtype
        for batch in batches:
            for part in spans.slices(batch, "ids"):
                queue, bin_, number, first, count = (part.column(c).to_numpy() for c in ("queue", "bin", "number", "first", "count"))
                run, length = np.arange(len(count)), count
                start = np.zeros(len(count), dtype=np.int64)
                deep = np.flatnonzero(bin_ >= 0)
                if len(deep):
                    at, more, size, place = bins.places(bin_[deep], number[deep], first[deep], count[deep])
                    flat = np.flatnonzero(bin_ < 0)
                    run, start = np.concatenate([flat, deep[at]]), np.concatenate([start[flat], more])
                    length, first = np.concatenate([count[flat], size]), np.concatenate([first[flat], place])
                again, more, length, place = mix.places(queue[run], first, length)
                doc, start = run[again], start[again] + more
                data, bounds = spans.flat(part.column("ids").cast(pa.large_binary()))
                ids = data.view(kind).astype("<u4")
                at = bounds[doc] // kind.itemsize + start
                cuts = [ids[a : a + n] for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length),
                        pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                        pa.array(count[doc]),
                        pa.array(place // window),
                        pa.array(place % window),
                        *([pa.array([c.tobytes() for c in cuts], pa.binary())] if with_ids else []),
                    ],
                    names=names,
                )

    return placed.mapInArrow(run, fields + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` from pieces with ids: the packed ids of each window, at most a window long."""
    one = F.struct("offset", "length", "ids")
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("p", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"),
    )

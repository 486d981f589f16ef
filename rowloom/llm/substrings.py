"""Substring dedup by level-wise doubling: word windows that occur more than once, found through ever longer ones.

Texts are collapsed to one each and handed over in buckets of their key, so that
no level moves them again. The levels of a window of 35 words are 9, 18 and 35
words. Every window has one anchor at each shorter level: of the runs of that
many words inside it, the one with the smallest hash, the leftmost of equals.
Equal windows have equal anchors at equal places, so a window can only be
repeated if its anchor is. A level therefore compares the anchors of what is
left, those repeated at that length alone are extended to twice the length, and
the last level compares whole windows. Only anchors and candidates are
shuffled, never all windows.

Occurrences are worked out once a level and handed over. Hot runs (a passage
that a third of all documents hold) are pre-aggregated before they meet; the
repeated hashes are handed over, one row each, so that the join that marks
their occurrences has shuffles of its own and can be split. No occurrence is
dropped.

Defined cases: a null or empty text has no words and keeps nothing; copies of
one text are each other's repetition, whole; rows are kept apart by the caller's
own row, so equal ids stay separate rows. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import spans
from rowloom.llm.handover import discard, hand_over
from rowloom.llm.keys import wide_key
from rowloom.session import scratch_path

WINDOW = 35
SMALLEST = 9


def levels(window: int = WINDOW, smallest: int = SMALLEST) -> list[int]:
    """Lengths that double up to ``window``: each is half of the next, rounded up."""
    out = [window]
    while (half := -(-out[0] // 2)) >= smallest:
        out.insert(0, half)
    return out


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = spans.flat(texts)
    starts, ends, wb = spans.words(data, bounds)
    return spans.span_hashes(data, starts, ends), wb


def _anchors(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For each window start the first position of the smallest of its ``width`` grams."""
    best, where = grams[at].copy(), at.copy()
    for j in range(1, width):
        g = grams[at + j]
        less = g < best
        best[less] = g[less]
        where[less] = at[less] + j
    return where


def _live(part: pa.RecordBatch, wb: np.ndarray, hashes: np.ndarray, done: list[int], window: int) -> np.ndarray:
    """Starts of the windows whose anchors were repeated at all levels so far."""
    at = spans.window_starts(wb, window)
    for level in done:
        marks = part.column(f"at{level}")
        flat = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.diff(marks.offsets.to_numpy()) if not marks.null_count else np.array([len(x) if x is not None else 0 for x in marks.to_pylist()])
        hit = np.zeros(len(hashes) + 1, dtype=bool)
        hit[flat + np.repeat(wb[:-1], counts)] = True
        at = at[hit[_anchors(spans.window_hashes(hashes, level), at, window - level + 1)]]
    return at


def _occurrences(texts: DataFrame, done: list[int], level: int, window: int) -> DataFrame:
    """``(key, h, at, copies)``: what is still to be compared at ``level``, anchors or whole windows."""
    schema = "key binary, h long, at int, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                hashes, wb = _hashes(part.column("text"))
                at = _live(part, wb, hashes, done, window)
                if level < window:
                    at = np.unique(_anchors(spans.window_hashes(hashes, level), at, window - level + 1))
                grams = spans.window_hashes(hashes, level)
                doc = np.searchsorted(wb, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(doc)),
                        pa.array(spans.signed(grams[at]) if len(at) else np.zeros(0, np.int64)),
                        pa.array((at - wb[doc]).astype(np.int32)),
                        part.column("copies").take(pa.array(doc)),
                    ],
                    names=["key", "h", "at", "copies"],
                )

    return texts.mapInArrow(run, schema)


def _repeated(found: DataFrame, label: str) -> DataFrame:
    """Per text the sorted places of occurrences whose hash occurs more than once."""
    found = hand_over(found, "occurrences")
    twice = found.groupBy("h").agg(F.sum("copies").alias("n")).filter(F.col("n") > 1).select("h")
    # counted and written first, so that the join has a shuffle of its own and a hot hash can be split
    twice = hand_over(twice, "repeated")
    marks = found.join(twice.hint("merge"), "h", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("at"))
    marks = hand_over(marks, label)
    discard(found, twice)
    return marks


def distinct_texts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts, one row ``(key, text, copies)`` each in buckets of ``key``, and ``docs`` with ``key`` in front.

    The key is a 128-bit hash of the text; a null text is an empty one.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    texts = src.groupBy(wide_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name, n = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the copy is read once a level: buckets keep its joins on the key from moving it
    writer = texts.write.bucketBy(n, "key").format("parquet").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "texts")).saveAsTable(name)
    rows = docs.select(
        wide_key(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    )
    return spark.table(name), rows


def repeated_starts(texts: DataFrame, window: int = WINDOW, smallest: int = SMALLEST) -> DataFrame:
    """``(key, at)``: where in each text a window starts that starts somewhere else too."""
    steps, state = levels(window, smallest), texts
    for i, level in enumerate(steps):
        marks = _repeated(_occurrences(state, steps[:i], level, window), f"repeats-{level}")
        if level == window:
            return marks
        state = state.join(marks.withColumnRenamed("at", f"at{level}"), "key")
    raise ValueError("no level")


def without_repeats(texts: DataFrame, marks: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``(key, n_words, n_removed, kept_sha256)`` of every text, and the kept text if asked for."""
    fields = "key binary, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                data, bounds = spans.flat(part.column("text"))
                starts, ends, wb = spans.words(data, bounds)
                marks_of, whole = part.column("at").to_pylist(), part.column("copies").to_pylist()
                n, removed, digests, texts_left = np.diff(wb), [], [], []
                for i, at in enumerate(marks_of):
                    if whole[i] > 1:
                        at = range(max(0, n[i] - window + 1))
                    gone = spans.covered(np.array(at if at is not None else [], dtype=np.int64), window, n[i])
                    left = np.flatnonzero(~gone) + wb[i]
                    body = data[bounds[i] : bounds[i + 1]].tobytes()
                    if len(left) == n[i]:
                        kept = b" ".join(body.split())
                    else:
                        a, b = starts[left] - bounds[i], ends[left] - bounds[i]
                        kept = b" ".join([body[x:y] for x, y in zip(a.tolist(), b.tolist())])
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts_left.append(kept.decode())
                cols = [part.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts_left, pa.string())] * with_text, names=names)

    joined = texts.join(marks, "key", "left").select("key", "text", "copies", "at")
    return joined.mapInArrow(run, fields)


def substring_dedup(docs: DataFrame, text: str = "text", keep: str = "doc_id", window: int = WINDOW, smallest: int = SMALLEST) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    texts, rows = distinct_texts(docs, text)
    result = without_repeats(texts, repeated_starts(texts, window, smallest), window)
    rows = rows.select("key", F.col("doc").getField(keep).alias("doc_id"))
    return rows.join(result, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")


def deduplicated(docs: DataFrame, text: str = "text", window: int = WINDOW, smallest: int = SMALLEST, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the kept words as text, and ``length`` (if it is a column) set to its code points.

    A text that loses no word stays as it is, its white space included; a row
    that loses all its words is left out.
    """
    texts, rows = distinct_texts(docs, text)
    result = without_repeats(texts, repeated_starts(texts, window, smallest), window, with_text=True)
    result = result.select("key", "n_words", "n_removed", F.when(F.col("n_removed") > 0, F.col("kept_text")).alias("kept_text"))
    out = rows.join(result, "key").filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    kept = F.coalesce("kept_text", F.col("doc").getField(text))
    cols = []
    for c in docs.columns:
        value = F.col("doc").getField(c)
        if c == text:
            value = kept
        elif c == length:
            value = F.when(F.col("n_removed") > 0, F.char_length(kept).cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return out.select(*cols)


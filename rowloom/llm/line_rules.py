"""Quality rules: base measures of a text and how often its lines occur across documents of a host.

A line is normalised by lower case, digits as ``0`` and single blanks, and
hashed. The documents that hold a line are counted per host. A line that more
than ``min_docs`` documents hold, and more than ``max_share`` of all documents
of the host or more than ``max_docs`` however large the host, is boilerplate and
removed, if it stands in more than ``min_docs`` different texts: a text is not
boilerplate for being copied. A document is rejected when it loses more than
``max_loss`` of its words by that, or when its base measures fail.

Defined cases: a null text is an empty one; a text without words fails the base
measures; a null host is a host of its own; equal rows are documents each; a
line without a word is no line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm import spans
from rowloom.llm.handover import hand_over
from rowloom.llm.keys import wide_key

SYMBOLS = spans._is(b"#*$%&|<>")
_DIGIT_AS_ZERO = np.arange(256, dtype=np.uint8)
_DIGIT_AS_ZERO[48:58] = 48
REPEAT_WINDOW = 5

#: a line in more documents of one host than the first, and than the share of the host or the third, is boilerplate
MIN_DOCS = 10
MAX_SHARE = 0.1
MAX_DOCS = 10_000
#: a document that loses more than this share of its words is rejected
MAX_LOSS = 0.7

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of values that occur twice or more, and of those that occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents."""
    return spans.mix(hashes ^ spans.mix(doc.astype(np.uint64) + np.uint64(1)))


def _normal_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, words and number of every normalised line; numbers count the lines of all texts, those without a word too."""
    # lower case changes lengths, so words are found anew
    texts = pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.string())
    data, bounds = spans.flat(texts)
    data = _DIGIT_AS_ZERO[data]
    starts, ends, _ = spans.words(data, bounds)
    lines, line_ends, lb = spans.runs(~spans.NEWLINE[data], bounds)
    first, last = np.searchsorted(starts, lines), np.searchsorted(starts, line_ends)
    number = np.flatnonzero(last > first)
    first, last = first[number], last[number]
    h = spans.span_hashes(spans.span_hashes(data, starts, ends), first, last)
    return h, spans.owner(lb)[number], last - first, number


def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines whose normalised hashes are in their list of ``gone`` ones; all else stays as it is."""
    h, doc, _, number = _normal_lines(texts)
    lists = gone.to_pylist()
    pairs = np.array([x for hashes in lists for x in hashes or []], dtype=np.int64).view(np.uint64)
    owners = np.repeat(np.arange(len(lists)), [len(x or []) for x in lists])
    drop = set(number[np.isin(_in_doc(h, doc), _in_doc(pairs, owners))].tolist())
    out, n = [], 0
    for text in texts.to_pylist():
        left = []
        for line in (text or "").split("\n"):
            if n not in drop or not line:
                left.append(line)
            n += line != ""
        out.append("\n".join(left))
    return pa.array(out, pa.string())


def measure(texts: pa.Array) -> dict[str, pa.Array]:
    """Base measures and distinct normalised lines of every text."""
    data, bounds = spans.flat(texts)
    starts, ends, wb = spans.words(data, bounds)
    n = np.diff(wb)
    in_word = ~spans.SPACE[data]
    points = in_word & ((data & 0xC0) != 0x80)
    out = {
        "text_hash": pa.array(spans.signed(spans.span_hashes(data, bounds[:-1], bounds[1:])), pa.int64()),
        "n_words": pa.array(n, pa.int64()),
        "word_chars": pa.array(spans.per_doc(points, bounds), pa.int64()),
        "n_symbols": pa.array(spans.per_doc(SYMBOLS[data], bounds), pa.int64()),
    }

    lines, line_ends, lb = spans.runs(~spans.NEWLINE[data], bounds)
    has = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    lb = np.concatenate([[0], np.cumsum(has)])[lb]
    lines, line_ends = lines[has], line_ends[has]
    _, later = _repeats(_in_doc(spans.span_hashes(data, lines, line_ends), spans.owner(lb)))
    out["n_dup_lines"] = pa.array(spans.per_doc(later, lb), pa.int64())

    k = REPEAT_WINDOW
    word_hashes = spans.span_hashes(data, starts, ends)
    at = spans.window_starts(wb, k)
    twice, _ = _repeats(_in_doc(spans.window_hashes(word_hashes, k)[at], spans.owner(wb)[at]))
    out["n_repeat_words"] = pa.array(spans.per_doc(spans.covered(at[twice], k, len(starts)), wb), pa.int64())

    h, doc, size, _ = _normal_lines(texts)
    order = np.lexsort((h, doc))
    h, doc, size = h[order], doc[order], size[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    sizes = np.add.reduceat(size, heads) if len(heads) else np.zeros(0, np.int64)
    at = np.searchsorted(doc[heads], np.arange(len(bounds)))
    out["line_hash"] = spans.lists(spans.signed(h[heads]), at, pa.int64())
    out["line_words"] = spans.lists(sizes, at, pa.int64())
    return out


def profile(docs: DataFrame, text: str, host: str, keep: Column) -> DataFrame:
    """``doc`` (the value of ``keep``), ``host``, the base measures and the distinct lines of every row."""
    src = docs.select(keep.alias("doc"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [src.schema["doc"], src.schema["host"], T.StructField("text_hash", T.LongType())]
        + [T.StructField(m, T.LongType()) for m in MEASURES]
        + [T.StructField("line_hash", longs), T.StructField("line_words", longs)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                got = measure(part.column("text"))
                cols = [part.column("doc"), part.column("host"), *got.values()]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "host", *got])

    return src.mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated runs of five."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(
    profiles: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, max_docs: int = MAX_DOCS,
    with_lines: bool = False,
) -> DataFrame:
    """Add ``base_failed``, ``lost_words`` and ``kept``; ``profiles`` is read once and handed over.

    ``with_lines`` adds ``gone``, the hashes of the document's lines that are boilerplate.

    One row per distinct line and document meets the counts of its host; a hot
    line is one row on the counting side, so its join partition can be split.
    """
    p = hand_over(profiles.withColumn("row", F.monotonically_increasing_id()), "line-profiles")
    lines = p.select("row", "host", "text_hash", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l"))
    lines = lines.select("row", "host", "text_hash", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    # the rows of one line and text first, so that the texts of a line are counted without a set
    common = lines.groupBy("host", "line", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    common = common.groupBy("host", "line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > min_docs)
    size = p.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    common = common.join(size, "host").filter((F.col("n") > max_share * F.col("docs")) | (F.col("n") > max_docs))
    lost = (
        lines.join(common.select("host", "line"), ["host", "line"], "left_semi")
        .groupBy("row")
        .agg(F.sum("words").alias("lost_words"), *[F.collect_list("line").alias("gone")] * with_lines)
    )
    out = p.drop("line_hash", "line_words", "text_hash").join(lost, "row", "left").drop("row")
    out = out.withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_loss * F.col("n_words")))


def line_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: str = "doc_id", **limits) -> DataFrame:
    """``doc_id``, the base measures, ``lost_words`` and the verdict ``kept`` of every document."""
    out = judge(profile(docs, text, host, F.col(f"`{keep}`")), **limits)
    return out.select(F.col("doc").alias("doc_id"), *MEASURES, "lost_words", "base_failed", "kept")


def accepted(docs: DataFrame, text: str = "text", host: str = "source", length: str | None = "n_chars", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without their boilerplate lines, with their own columns, whatever their names.

    ``length`` (if it is a column) is set to the code points of what is left; a
    text that loses no line stays as it is.
    """
    # a verdict is one of host and text: profiles carry their key, the rows themselves stay where they are until it is known
    key = wide_key(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")), F.col(f"`{text}`"))
    out = judge(profile(docs, text, host, key), with_lines=True, **limits)
    kept = out.filter("kept").groupBy(F.col("doc").alias("key")).agg(F.first("gone").alias("gone"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    src = rows.join(kept, "key").select("doc", "gone", F.when(F.col("gone").isNotNull(), F.col("doc").getField(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                left = without_lines(part.column("text"), part.column("gone"))
                left = pc.if_else(pc.is_valid(part.column("text")), left, None)
                yield pa.RecordBatch.from_arrays([part.column("doc"), left], names=["doc", "left"])

    out = src.mapInArrow(run, T.StructType([src.schema["doc"], T.StructField("left", T.StringType())]))
    cols = []
    for c in docs.columns:
        value = F.col("doc").getField(c)
        if c == text:
            value = F.coalesce("left", value)
        elif c == length:
            value = F.when(F.col("left").isNotNull(), F.char_length("left").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return out.select(*cols)

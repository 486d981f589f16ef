"""Quality classifier by compression: which of two dictionaries shortens a text more.

One zstandard dictionary is trained on blocks of good texts, one on blocks of
bad ones. A text is cut into blocks, as otherwise a long one would soon be its own
dictionary, and all of it is compressed with both. The normalised difference of
the two sizes, and how far the text compresses at all, become a probability by
a logistic calibration on labelled texts that the dictionaries have not seen.

The fit uses ``SAMPLE`` labelled documents of each label at most, those with the
smallest hash of their id; the model is two dictionaries and a few numbers.

Defined cases: a null text is an empty one and gets the score of its measures
like any other; labels other than 0 and 1 are left out, and of several labels
of an id the largest counts; without labels of both kinds every score is the
share of good labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.folds import held_out
from rowloom.llm.handover import hand_over

BLOCK = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: labelled documents of each label that the fit may use
SAMPLE = 4000
#: blocks of a document that a dictionary may learn from
BLOCKS_A_TEXT = 8


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@dataclass
class Model:
    """Dictionaries for labels 0 and 1, and the weights of the measures."""

    dictionaries: tuple[bytes, bytes] | None
    weights: list[float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The model with its dictionaries digested, for one worker."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.compressors = []
        for d in model.dictionaries or ():
            table = zstandard.ZstdCompressionDict(d)
            table.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False, level=LEVEL)
            )

    def measures(self, text: str | None) -> tuple[float, float]:
        """Difference of the compressed sizes over their larger one, and the smaller one over the size."""
        parts = blocks((text or "").encode())
        if not parts or not self.compressors:
            return 0.0, 1.0
        bad, good = (sum([len(c.compress(b)) for b in parts]) for c in self.compressors)
        return (bad - good) / max(bad, good), min(bad, good) / sum(map(len, parts))

    def scores(self, measures: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(design(measures) @ self.weights, -30, 30)))


def design(measures: np.ndarray) -> np.ndarray:
    """The terms of the calibration; compressibility enters up to where it no longer tells repetition."""
    d, c = measures[:, 0], np.minimum(measures[:, 1], 1.0)
    return np.stack([np.ones(len(d)), d, c, c * c, d * c, d * np.abs(d)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return [float(v) for v in w]


def spread(parts: list[bytes]) -> list[bytes]:
    """At most ``BLOCKS_A_TEXT`` blocks at even distances, the first and the last among them."""
    n = min(len(parts), BLOCKS_A_TEXT)
    return [parts[i * (len(parts) - 1) // max(1, n - 1)] for i in range(n)]


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> Model:
    """A model from labelled documents outside the held-out fold."""
    seen = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    seen = seen.groupBy("id").agg(F.max("y").alias("y")).filter(~held_out("id", folds, fold))
    order = [F.xxhash64("id", F.lit(7)), F.col("id")]
    chosen = seen.filter("y = 0").orderBy(*order).limit(sample).union(seen.filter("y = 1").orderBy(*order).limit(sample))
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # at most two samples of narrow rows are sent around
    rows = hand_over(src.join(F.broadcast(chosen), "id").filter("text IS NOT NULL"), "labelled-sample")
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2)) == 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, got = [], []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for b in spread(blocks(t.encode())):
                    ys.append(y)
                    got.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(got, pa.binary())], names=["y", "block"])

    learned = rows.filter("NOT calibrates").orderBy("id").mapInArrow(cut, "y int, block binary").toArrow()
    by_label: tuple[list[bytes], list[bytes]] = ([], [])
    for y, b in zip(learned.column("y").to_pylist(), learned.column("block").to_pylist()):
        by_label[y].append(b)
    if not all(by_label):
        n = [r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()]
        kinds = [r.y for r in rows.select("y").distinct().collect()]
        share = 0.5 if not n else (float(kinds[0]) if len(n) == 1 else n[1] / sum(n))
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(None, [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0, 0.0])
    model = Model((_dictionary(by_label[0]), _dictionary(by_label[1])), [0.0] * 6)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            m = np.array([scorer.measures(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(m[:, 0]), pa.array(m[:, 1])], names=["y", "d", "c"])

    seen_not = rows.filter("calibrates").mapInArrow(measure, "y int, d double, c double").toArrow()
    y = seen_not.column("y").to_numpy().astype(float)
    m = np.stack([seen_not.column("d").to_numpy(), seen_not.column("c").to_numpy()], axis=1)
    if len(set(y.tolist())) < 2:  # too few to calibrate: the sign of the difference decides
        model.weights = [0.0, 20.0, 0.0, 0.0, 0.0, 0.0]
    else:
        order = np.lexsort((y, m[:, 1], m[:, 0]))
        model.weights = _logistic(design(m[order]), y[order])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, and the size difference."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(doc_id, folds, fold).alias("held_out"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                m = np.array([scorer.measures(t) for t in part.column("text").to_pylist()]).reshape(-1, 2)
                s = scorer.scores(m)
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(m[:, 0])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "difference"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, difference double")

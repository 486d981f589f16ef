import zlib

import pytest
from pyspark.sql import functions as F

from rowloom.llm import compression_quality as cq
from tests.llm.common import empty, frame, odd


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def fitted(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = spark.read.parquet(f"{folder}/labels.parquet")
    return docs, seen, cq.fit(docs, seen)


def test_held_out_documents_are_told_apart(fitted):
    docs, seen, model = fitted
    got = cq.score(docs, model)
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = got.join(seen, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)
    out = [r for r in rows if r.held_out]
    share = max(sum(r.quality for r in out), sum(1 - r.quality for r in out)) / len(out)
    right = sum(r.predicted == r.quality for r in out) / len(out)
    assert right > 0.95 and right > share
    brier = sum((r.score - r.quality) ** 2 for r in out) / len(out)
    assert brier < 0.05


def test_held_out_labels_change_nothing(fitted, spark):
    docs, seen, model = fitted
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    turned = seen.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = cq.fit(docs.withColumn("lang", F.lit("xx")), turned)
    assert again.dictionaries == model.dictionaries and again.weights == model.weights


def test_odd_rows(fitted, spark):
    docs = odd(spark)
    got = cq.score(docs, fitted[2])
    assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert by_text[1] == by_text[2] and by_text[13] == by_text[14]
    assert cq.score(empty(spark), fitted[2]).count() == 0


def test_few_or_no_labels(spark):
    docs = frame(spark, ["good text here"] * 3 + [None, "bad ### text"])
    none = cq.fit(docs, labels(spark, []))
    assert {round(r.score, 9) for r in cq.score(docs, none).collect()} == {0.5}
    one = cq.fit(docs, labels(spark, [(i, 1, 0) for i in range(1, 6)]))
    assert min(r.score for r in cq.score(docs, one).collect()) > 0.9
    both = cq.fit(docs, labels(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 0)]))
    assert cq.score(docs, both).count() == 5
    assert cq.fit(empty(spark), labels(spark, [])).dictionaries is None


def test_dictionaries_learn_from_beginnings_and_endings():
    for n in range(40):
        got = cq.spread(list(range(n)))
        assert len(set(got)) == len(got) == min(n, 8) and got == sorted(got) and got[-1:] == list(range(n))[-1:] and got[:1] == list(range(n))[:1]
        assert all(b - a <= -(-n // 7) for a, b in zip(got, got[1:]))

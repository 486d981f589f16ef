"""Tables for the tests of the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def frame(spark: SparkSession, texts: list, sources: list | None = None, langs: list | None = None, ids: list | None = None) -> DataFrame:
    n = len(texts)
    ids = list(range(1, n + 1)) if ids is None else ids
    rows = zip(ids, texts, langs or ["en"] * n, sources or ["src"] * n, [len(t) if t is not None else None for t in texts])
    return spark.createDataFrame(list(rows), SCHEMA)


def odd(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, repeated rows, ids and texts, odd characters, and columns whose names clash."""
    rng = random.Random(5)
    words = ["the", "of", "and", "straße", "été", "niño", "Word,", "x1", "42", "don't", "###", "→"]
    long_ = " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(30_000))
    line = " ".join(f"common{i}" for i in range(60))
    texts = [
        None, "", " \n\t ", "a", "short text", "12 34 -- 5", "the the the the the the the the the the the the",
        long_, long_ + " tail", line, line + "\n" + "own words here " * 3, "lead in " + line, line, line,
        "a\x1cb c\x0bd\x0ce\xa0f", "Ünï ö̈ é\r\nİx ǅ 한글 漢字 👩‍👩‍👧", "'s 're 'tis we'll  ''d", "same id", "other text", "same id",
    ]
    ids = [*range(1, 18), 7, 7, 7]
    sources = [None, "", "a", "a", *["b"] * (len(texts) - 4)]
    langs = [None, "", "en", "de", *["en", "de"] * ((len(texts) - 4) // 2)]
    df = frame(spark, texts, sources, langs, ids)
    df = df.union(frame(spark, ["no id at all", None], [None, None], [None, None], [None, None]))
    for name in ("row", "key", "score", "kept", "doc", "h", "part", "at", "count", "queue", "n_words"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

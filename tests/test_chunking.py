"""Block-wise packing against one pass over the lines."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import chunking


def one_pass(name, group, header, lines, target, keep, cap):
    head = [f"TYPE: CSV_DATA_CHUNK | FILE: {name} | GROUP: {group}", "COLUMNS: " + ", ".join(header), "ROWS:"]
    base = sum(len(x) + 1 for x in head)
    out, chunk, tail = [], [], []

    def size(rows):
        return sum(len(line) + 1 for _, line in rows)

    def close():
        top, body = "\n".join(head), "\n".join(line for _, line in chunk)
        room = max(cap - len(top) - 1, cap // 2)
        for at in range(0, max(1, len(body)), room):  # a long line goes on in further chunks
            out.append((name, group, len(out), chunk[0][0], chunk[-1][0], f"{top}\n{body[at:at + room]}"))

    for n, line in enumerate(lines, 1):
        if chunk and base + size(chunk) + len(line) + 1 > target:
            close()
            chunk = list(tail)
        chunk.append((n, line))
        tail.append((n, line))
        while tail and size(tail) > keep:
            tail.pop(0)
        if base + size(chunk) >= cap:
            close()
            chunk = list(tail)
    if chunk:
        close()
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(5)
    out = {}
    for t in range(10):
        n = [0, 1, 319, 320, 321, 640, 700, 1000, 1500, 2][t]
        sizes = [0, 8, 9, 10, 20, 30, 60] + ([150, 250, 320, 700] if t % 2 else [])
        out[f"f{t}.csv", f"G{t % 3}"] = ["x" * r.choice(sizes) for _ in range(n)]
    return out


@pytest.mark.parametrize("block_rows", [100_000, 320, 450])
def test_blocks_pack_like_one_pass(spark, tables, block_rows, monkeypatch):
    monkeypatch.setattr(chunking, "MIN_CHARS", 10)
    rows = [(f, g, n + 1, s, ["a", "b"]) for (f, g), lines in tables.items() for n, s in enumerate(lines)]
    df = spark.createDataFrame(rows, "filename string, group string, row_no long, line string, header array<string>")
    got = chunking.chunk_lines(df, 250, 60, 320, block_rows=block_rows)
    want = [c for (f, g), lines in tables.items() for c in one_pass(f, g, ["a", "b"], lines, 250, 60, 320)]
    assert sorted(map(tuple, got.select("filename", "group", "chunk_index", "row_start", "row_end", "text").collect())) == sorted(want)


def test_default_sizes_and_wide_header(spark):
    r = random.Random(9)
    header = [f"col_{i}" for i in range(30)]
    lines = [" | ".join("v" * r.randint(0, 12) for _ in header) for _ in range(400)]
    df = spark.createDataFrame([("t.csv", "T", n + 1, s, header) for n, s in enumerate(lines)], "filename string, group string, row_no long, line string, header array<string>")
    got = chunking.chunk_lines(df).orderBy("chunk_index").select("filename", "group", "chunk_index", "row_start", "row_end", "text")
    assert list(map(tuple, got.collect())) == one_pass("t.csv", "T", header, lines, 1500, 200, 3500)


def test_every_row_is_covered(spark):
    nums = spark.range(3000).select(
        F.lit("l.csv").alias("filename"), F.lit("L").alias("group"), F.col("id").alias("row_idx"),
        F.array(F.sha1(F.col("id").cast("string"))).alias("cells"),
    )
    spans = chunking.chunk_lines(chunking.lines_of(nums, F.array(F.lit("h")))).orderBy("chunk_index").collect()
    assert spans[0].row_start == 1 and spans[-1].row_end == 3000
    assert all(b.row_start <= a.row_end + 1 and b.row_end > a.row_end for a, b in zip(spans, spans[1:]))


def test_columns_and_cells_are_whole(spark):
    wide = spark.createDataFrame([("w.csv", "W", 0, [f"v{i}" for i in range(129)] + ["z" * 5000])], "filename string, group string, row_idx long, cells array<string>")
    header = F.array(*[F.lit(f"c{i}") for i in range(130)])
    texts = [r.text for r in chunking.chunk_lines(chunking.lines_of(wide, header)).orderBy("chunk_index").collect()]
    body = "".join(t.split("ROWS:\n", 1)[1] for t in texts)
    assert body == " | ".join([f"v{i}" for i in range(129)] + ["z" * 5000]) and max(map(len, texts)) <= 3500
    (doc,) = chunking.summary_docs(wide, header).collect()
    assert "c129:1" in doc.text and "z" * 5000 in doc.text


def test_blocks_of_one_table_are_not_dealt_by_table(spark, monkeypatch):
    lines = spark.range(1, 1201).select(
        F.lit("t.csv").alias("filename"), F.lit("G").alias("group"), F.col("id").alias("row_no"),
        F.concat(F.lit("line "), F.col("id")).alias("line"), F.array(F.lit("c")).alias("header"),
    )
    plans = []
    pin = chunking.pin
    monkeypatch.setattr(chunking, "pin", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or pin(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were many
    try:
        assert chunking.chunk_lines(lines, 250, 60, 320, block_rows=320).count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    grouped = [p for p in plans if "exits(" in p or "emit(" in p]
    assert len(grouped) == 2
    for plan in grouped:
        dealt = [x for x in plan.splitlines() if "hashpartitioning" in x]
        # the shuffle that the blocks meet in, which is the one nearest to the grouping
        assert dealt and "block#" in dealt[0]

"""Chunks of table rows with overlap, table summaries, text pieces, and the chunk index.

Where a chunk starts depends on where the one before ended. That chain is
followed in blocks: every block of rows first works out, for each place a chunk
could be open at its start, the place one is open at its end. These small maps
are composed by doubling, which gives the true start of every block, and then
all blocks emit their chunks at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import naming, text
from rowloom.plans.ranking import number_rows
from rowloom.session import pin, small_side

# Fixed values.
TARGET_CHARS = 1500
MIN_CHARS = 900
MAX_CHARS = 3500
OVERLAP_CHARS = 200
SAMPLE_ROWS = 5

BLOCK_ROWS = 50_000
CHUNK_SCHEMA = "filename string, group string, block long, n int, row_start long, row_end long, text string"


class Packer:
    """Chunk boundaries over consecutive lines of known length."""

    def __init__(self, sizes: np.ndarray, base: int, target: int, overlap: int, cap: int):
        self.sums = np.concatenate([[0], np.cumsum(sizes)])
        self.base, self.target, self.overlap, self.cap = base, target, overlap, cap

    def overlap_from(self, last: int) -> int:
        """First line of the overlap kept after line ``last``; ``last + 1`` for none."""
        return int(np.searchsorted(self.sums, self.sums[last + 1] - self.overlap, side="left"))

    def _first(self, start: int, limit: int, side: str) -> int:
        """First line at which the chunk from ``start`` passes (or reaches) ``limit``."""
        return int(np.searchsorted(self.sums, self.sums[start] + limit - self.base, side=side)) - 1

    def run(self, start: int, at: int, end: int, known: dict[int, int] | None = None):
        """Chunks closed by lines ``at..end-1`` with a chunk open from ``start``; then where one is open."""
        out: list[tuple[int, int]] = []
        trail: list[int] = []
        appended = at - 1
        while True:
            flush = max(self._first(start, self.target, "right"), start + 1, appended + 1)
            full = max(self._first(start, self.cap, "left"), appended + 1, start)
            if min(flush, full) >= end:
                break
            if full < flush:
                out.append((start, full))
                start, appended = self.overlap_from(full), full
                continue
            if known is not None:
                if flush in known:
                    start = known[flush]
                    break
                trail.append(flush)
            out.append((start, flush - 1))
            start, appended = self.overlap_from(flush - 1), flush
            if self.base + self.sums[flush + 1] - self.sums[start] >= self.cap:
                out.append((start, flush))
                start = self.overlap_from(flush)
        if known is not None:
            known.update(dict.fromkeys(trail, start))
        return out, start


def lines_of(
    rows: DataFrame, header: Column, cells: str = "cells", row_idx: str = "row_idx", max_cols: int | None = None, max_cell: int | None = None
) -> DataFrame:
    """Chunk lines of table rows: ``(filename, group, row_no, line, header)``.

    A chunk shows all columns and whole cells, unless ``max_cols`` and ``max_cell`` limit them.
    """
    if max_cols is not None:
        header = F.slice(header, 1, max_cols)
    width = F.size(header)
    padded = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
    line = F.array_join(F.transform(padded, lambda c: text.display_cell(c, max_cell)), " | ")
    return rows.select(
        "filename", "group", (F.col(row_idx) + 1).alias("row_no"), F.when(width > 0, line).otherwise("").alias("line"), header.alias("header")
    )


def chunk_lines(
    lines: DataFrame, target: int = TARGET_CHARS, overlap: int = OVERLAP_CHARS, cap: int = MAX_CHARS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pack lines into chunks per table; rows are 1-based, chunks count from 0.

    A chunk closes before the line that would pass ``target`` and at ``cap``;
    the next one starts with the trailing lines that fit ``overlap``. A chunk
    whose lines are longer than ``cap`` goes on in further chunks of the same
    rows under the same heading. A block must hold at least ``cap`` rows.
    """
    target = max(min(MIN_CHARS, cap), min(target, cap))
    head = F.concat(
        F.lit("TYPE: CSV_DATA_CHUNK | FILE: "), F.col("filename"), F.lit(" | GROUP: "), F.col("group"),
        F.lit("\nCOLUMNS: "), F.array_join("header", ", "), F.lit("\nROWS:"),
    )
    placed = lines.select(
        "filename", "group", "row_no", "line", head.alias("head"), F.expr(f"(row_no - 1) div {block_rows}").alias("block")
    )
    tables = pin(placed.groupBy("filename", "group").agg(F.max("block").alias("last_block")))
    many = tables.filter("last_block > 0")

    def emit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        numbers, body, head = pdf.row_no.to_numpy(), pdf.line.tolist(), pdf["head"].iloc[0]
        first = int(np.searchsorted(numbers, pdf.first_row.iloc[0]))
        start = int(np.searchsorted(numbers, pdf.entry.iloc[0]))
        packer = Packer(np.array([len(s) + 1 for s in body]), len(head) + 1, target, overlap, cap)
        spans, left = packer.run(start, first, len(body))
        if pdf.is_last.iloc[0] and left < len(body):
            spans.append((left, len(body) - 1))
        pieces = [(a, b, t) for a, b in spans for t in _within(head, "\n".join(body[a : b + 1]), cap)]
        return pd.DataFrame(
            {
                "filename": key[0],
                "group": key[1],
                "block": key[2],
                "n": np.arange(len(pieces), dtype="int32"),
                "row_start": [numbers[a] for a, _, _ in pieces],
                "row_end": [numbers[b] for _, b, _ in pieces],
                "text": [t for _, _, t in pieces],
            }
        )

    if many.isEmpty():
        ready = placed.withColumn("first_row", F.lit(1)).withColumn("entry", F.lit(1)).withColumn("is_last", F.lit(True))
    else:
        ready = _with_entries(placed, tables, many, target, overlap, cap, block_rows)
    chunks = pin(ready.groupBy("filename", "group", "block").applyInPandas(emit, CHUNK_SCHEMA))
    numbered = number_rows(chunks, ["filename", "group"], ["block", "n"], number="__i", block=F.col("block"))
    return numbered.select(
        "filename", "group", (F.col("__i") - 1).cast("int").alias("chunk_index"), "row_start", "row_end", "text"
    )


def _within(head: str, body: str, cap: int) -> list[str]:
    """The body under its heading, in as many texts of up to ``cap`` characters as it takes; a heading over half of it counts as half."""
    room = max(cap - len(head) - 1, cap // 2, 1)
    return [f"{head}\n{body[i : i + room]}" for i in range(0, max(len(body), 1), room)]


def _with_entries(placed, tables, many, target, overlap, cap, block_rows) -> DataFrame:
    """Block rows with the lines that reach into the block and the start of the chunk open there."""
    key = ["filename", "group"]
    # a chunk open at a block's start reaches back at most this many lines, a line being one character or more
    reach = max(cap, overlap)
    if reach > block_rows:
        raise ValueError("a block must hold as many rows as a chunk has characters")
    last_rows = (F.col("row_no") - 1) % block_rows >= block_rows - reach
    rows = pin(
        placed.join(small_side(tables), key)
        .withColumn("__b", F.explode(F.when(last_rows, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
        .drop("block").withColumnRenamed("__b", "block")
        .filter("block <= last_block")
        .withColumn("first_row", F.col("block") * block_rows + 1)
    )

    def exits(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        numbers = pdf.row_no.to_numpy()
        first = int(np.searchsorted(numbers, pdf.first_row.iloc[0]))
        packer = Packer(pdf["size"].to_numpy(), int(pdf.base.iloc[0]), target, overlap, cap)
        known: dict[int, int] = {}
        near = packer.sums[first] - packer.sums[: first + 1] <= reach
        entries = [first] if k[2] == 0 else np.flatnonzero(near).tolist()
        ends = [packer.run(s, first, len(numbers), known)[1] for s in entries]
        after = int(numbers[-1]) + 1
        return pd.DataFrame(
            {
                "filename": k[0], "group": k[1], "node": k[2],
                "entry": [int(numbers[s]) for s in entries],
                "exit": [int(numbers[e]) if e < len(numbers) else after for e in ends],
            }
        )

    # no join by table here: it would deal a whole table to one task, and the grouping by block would leave it there
    sizes = rows.filter("last_block > 0").select(
        *key, "block", "row_no", "first_row", (F.length("line") + 1).alias("size"), (F.length("head") + 1).alias("base")
    )
    schema = "filename string, group string, node long, entry long, exit long"
    levels = [pin(sizes.groupBy(*key, "block").applyInPandas(exits, schema))]
    height = int(many.agg(F.max("last_block")).first()[0]).bit_length()
    for _ in range(height):
        low = levels[-1]
        left = low.filter("node % 2 = 0").select(*key, F.expr("node div 2").alias("node"), "entry", F.col("exit").alias("mid"))
        right = low.filter("node % 2 = 1").select(*key, F.expr("node div 2").alias("node"), F.col("entry").alias("mid"), "exit")
        # the last block of an odd row has no right neighbour and passes its own exits on
        joined = left.join(right, [*key, "node", "mid"], "left")
        levels.append(pin(joined.select(*key, "node", "entry", F.coalesce("exit", "mid").alias("exit"))))
    at = many.select(*key, F.lit(0).cast("long").alias("node"), F.lit(1).cast("long").alias("entry"))
    for low in reversed(levels[:-1]):
        step = at.join(
            low.select(*key, F.expr("node div 2").alias("up"), (F.col("node") % 2).alias("odd"), F.col("entry").alias("e"), "exit"),
            (at["filename"] == low["filename"]) & (at["group"] == low["group"]) & (F.col("up") == at["node"])
            & (F.col("odd") == 0) & (F.col("e") == at["entry"]),
        ).select(at["filename"], at["group"], at["node"], at["entry"], F.col("exit"))
        at = pin(
            step.select(*key, (F.col("node") * 2).alias("node"), "entry")
            .unionByName(step.select(*key, (F.col("node") * 2 + 1).alias("node"), F.col("exit").alias("entry")))
            .join(low.select(*key, "node").distinct(), [*key, "node"], "left_semi")
        )
    starts = at.select(*key, F.col("node").alias("block"), "entry")
    return (
        rows.join(starts, [*key, "block"], "left")
        .withColumn("entry", F.coalesce("entry", F.lit(1).cast("long")))
        .withColumn("is_last", F.col("block") == F.col("last_block"))
    )


def summary_docs(
    rows: DataFrame, header: Column, cells: str = "cells", row_idx: str = "row_idx",
    cap: int | None = None, max_cols: int | None = None, max_cell: int | None = None,
) -> DataFrame:
    """One summary text per table: columns, row count, filled cells per column, first rows; whole unless limits are given."""
    key = ["filename", "group"]
    base = rows.withColumn("__h", header if max_cols is None else F.slice(header, 1, max_cols)).filter(F.size("__h") > 0)
    cell = base.select(*key, F.posexplode(F.arrays_zip(F.col("__h").alias("h"), F.slice(cells, F.lit(1), F.size("__h")).alias("c"))).alias("pos", "z"))
    per_col = cell.groupBy(*key, "pos").agg(
        F.any_value("z.h").alias("column"), F.count_if(F.coalesce("z.c", F.lit("")) != "").alias("filled"), F.count(F.lit(1)).alias("rows")
    )
    cols = per_col.groupBy(*key).agg(
        F.max("rows").alias("row_count"), F.sort_array(F.collect_list(F.struct("pos", "column", "filled"))).alias("cols")
    )
    first = base.filter(F.col(row_idx) < SAMPLE_ROWS)
    samples = lines_of(first, F.col("__h"), cells, row_idx, max_cell=max_cell).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("lines")
    )
    body = F.array_join(
        F.array(
            F.concat(F.lit("TYPE: CSV_SUMMARY | FILE: "), F.col("filename"), F.lit(" | GROUP: "), F.col("group")),
            F.concat(F.lit("COLUMNS: "), F.array_join(F.transform("cols", lambda c: c["column"]), ", ")),
            F.concat(F.lit("ROW_COUNT: "), F.col("row_count").cast("string")),
            F.concat(
                F.lit("NON_EMPTY_COUNTS: "),
                F.array_join(F.transform("cols", lambda c: F.concat(c["column"], F.lit(":"), c["filled"].cast("string"))), ", "),
            ),
            F.concat(F.lit("SAMPLE_ROWS:\n"), F.array_join(F.transform("lines", lambda s: s["line"]), "\n")),
        ),
        "\n",
    )
    return cols.join(samples, key).select(*key, (body if cap is None else F.substring(body, 1, cap)).alias("text"))


def split_text(df: DataFrame, keys: Sequence[str], col: str = "text", target: int = TARGET_CHARS) -> DataFrame:
    """Pieces of long texts, cut at line ends so that no piece passes ``target`` if its lines allow.

    Short texts stay as they are; every part of a long one is trimmed.
    """
    parts = F.split(F.col(col), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, part: Column) -> Column:
        over = (F.length(acc["buf"]) + F.length(part) + 1 > target) & (acc["buf"] != "")
        line = F.concat(part, F.lit("\n"))
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(_strip(acc["buf"])))).otherwise(acc["done"]).alias("done"),
            F.when(over, line).otherwise(F.concat(acc["buf"], line)).alias("buf"),
        )

    def finish(acc: Column) -> Column:
        rest = _strip(acc["buf"])
        return F.when(rest != "", F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    long = F.aggregate(parts, start, step, finish)
    pieces = F.when(F.length(col) <= target, F.array(F.col(col))).otherwise(long)
    return df.select(*keys, F.posexplode(pieces).alias("piece", "content"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{text.SPACE}+|{text.SPACE}+\\z", "")


def with_ids(chunks: DataFrame, session: str, doc_type: str = "chunk") -> DataFrame:
    """Chunks with type and deterministic id."""
    return chunks.withColumn("doc_type", F.lit(doc_type)).withColumn(
        "doc_id",
        naming.chunk_id(F.lit(session), F.col("filename"), F.col("group"), F.lit(doc_type), F.col("chunk_index"), F.col("text")),
    )


def upsert(target: DataFrame, batch: DataFrame, version: Column, key: str = "doc_id") -> DataFrame:
    """The target with the batch written over it; of several rows of a key the one of the highest ``version``.

    Only batch keys are looked up.
    """
    rest = [c for c in batch.columns if c != key]
    latest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")
    return target.join(latest.select(key), key, "left_anti").unionByName(latest.select(*target.columns))


def delete_group(chunks: DataFrame, group: str) -> DataFrame:
    return chunks.filter(~F.col("group").eqNullSafe(group))


def count_deleted(chunks: DataFrame, group: str) -> DataFrame:
    return chunks.agg(F.count_if(F.col("group") == group).alias("deleted"))


def resume_filter(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks past the last checkpoint of their file; a checkpoint of another signature is void."""
    key = ["group", "filename", "file_sig"]
    last = state.select(*key, F.col("last_chunk").alias("__last"))
    return chunks.join(last, key, "left").filter(F.col("chunk_index") > F.coalesce("__last", F.lit(-1))).drop("__last")

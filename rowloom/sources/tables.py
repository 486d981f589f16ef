"""Delimited tables: read as strings, written by group, exported as quoted reports."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.plans.ranking import number_rows

HELD_CELLS = 200_000  # cells gathered before they are handed on
PART_ROWS = 100_000  # rows of a written part


def _with_row_no(df: DataFrame, columns: list) -> DataFrame:
    """Number the rows of every file in file order; a file split is a block."""
    placed = df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
        *columns,
    )
    return number_rows(placed, ["file"], ["__start", "__at"], number="__row", block=F.col("__start")).drop("__start", "__at")


def read_table(
    spark: SparkSession, path: str, max_rows: int | None = None, max_cols: int | None = None, multiline: bool = True
) -> DataFrame:
    """Tables of one header: every cell a string, rows padded or cut to the header.

    Adds ``file`` and the 0-based ``row_idx``. ``multiline`` allows line breaks
    in cells and reads a file in one task; turn it off for huge files.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", multiLine=multiline, escape='"')
    cols = raw.columns[:max_cols] if max_cols else raw.columns
    rows = _with_row_no(raw, [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in cols])
    rows = rows.withColumn("row_idx", F.col("__row") - 1).drop("__row")
    return rows.filter(F.col("row_idx") < max_rows) if max_rows is not None else rows


def _cells(texts: DataFrame, keys: Sequence[str], content: str, sep: str) -> DataFrame:
    """``keys, record, cells``: every record of delimited texts; cells in quotes may hold separators, quotes and line breaks."""
    kept = texts.select(*keys, F.col(content).alias("__text"))
    kinds = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            def made(src: list, numbers: list, rows: list) -> pa.RecordBatch:
                cols = [batch.column(k).take(pa.array(src, pa.int64())) for k in keys]
                cols += [pa.array(numbers, pa.int64()), pa.array(rows, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(cols, names=[*keys, "record", "cells"])

            src, numbers, rows, held = [], [], [], 0
            for at, text in enumerate(batch.column("__text")):
                for n, row in enumerate(csv.reader(io.StringIO(text.as_py() or "", newline=""), delimiter=sep)):
                    src.append(at)
                    numbers.append(n)
                    rows.append(row)
                    held += len(row) + 1
                    if held > HELD_CELLS:
                        yield made(src, numbers, rows)
                        src, numbers, rows, held = [], [], [], 0
            if src:
                yield made(src, numbers, rows)

    return kept.mapInArrow(run, f"{kinds}, record long, cells array<string>")


def _fitted(cells: str, header: str) -> Column:
    """The cells padded or cut to the header."""
    width = F.size(header)
    some = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
    return F.when(width > 0, some).otherwise(F.array().cast("array<string>"))


def parse_tables(texts: DataFrame, key: str, content: str = "content", sep: str = ",", header: bool = True) -> DataFrame:
    """Rows ``(key, row_idx, cells)`` of delimited texts, one text a row.

    With ``header`` the first record is left out and every row is padded or cut to it.
    """
    found = _cells(texts, [key], content, sep)
    if not header:
        return found.select(key, F.col("record").alias("row_idx"), "cells")
    head = found.filter("record = 0").select(key, F.size("cells").alias("__n"), F.col("cells").alias("__header"))
    body = found.filter("record > 0").join(head, key)
    return body.select(key, (F.col("record") - 1).alias("row_idx"), _fitted("cells", "__header").alias("cells"))


def read_collection(
    spark: SparkSession, path: str, max_rows: int | None = None, multiline: bool = True, max_cols: int | None = None, sep: str = ","
) -> DataFrame:
    """Many tables with headers of their own as ``(file, header, row_idx, cells)``.

    Every row is padded or cut to its file's header, or to the first
    ``max_cols`` of it. Files are read in splits, a large one by many tasks.
    With ``multiline`` cells in quotes may hold line breaks: a line belongs to
    the record before it if the quotes up to it are odd in number, which running
    sums over the splits tell. A quote inside a cell without quotes is not
    allowed then; without ``multiline`` every line is a record.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("__line"),
    )
    order, block = ["__start", "__at"], F.col("__start")
    if multiline:
        quotes = F.length("__line") - F.length(F.replace("__line", F.lit('"'), F.lit("")))
        lines = number_rows(lines.withColumn("__q", quotes), ["file"], order, number=None, sums={"__upto": F.col("__q")}, block=block)
        opens = F.when((F.col("__upto") - F.col("__q")) % 2 == 0, 1).otherwise(0)
        lines = number_rows(lines.withColumn("__opens", opens), ["file"], order, number=None, sums={"__record": F.col("__opens")}, block=block)
        parts = F.array_sort(F.collect_list(F.struct(*order, "__line")))
        joined = F.array_join(F.transform(parts, lambda p: p["__line"]), "\n")
        records = lines.groupBy("file", "__record").agg(joined.alias("__line"))
    else:
        records = number_rows(lines, ["file"], order, number="__record", block=block)
    records = records.withColumn("__line", F.regexp_replace("__line", r"\r\z", "")).filter("__line <> ''")
    found = _cells(records, ["file", "__record"], "__line", sep).drop("record")
    head = found.filter("__record = 1").select("file", (F.slice("cells", 1, max_cols) if max_cols else F.col("cells")).alias("header"))
    body = found.filter("__record > 1").join(head, "file")
    body = number_rows(body, ["file"], ["__record"], number="__n", block=F.expr(f"__record div {PART_ROWS}"))
    body = body.select("file", "header", (F.col("__n") - 1).alias("row_idx"), _fitted("cells", "header").alias("cells"))
    return body.filter(F.col("row_idx") < max_rows) if max_rows is not None else body


def csv_line(cells: Column, sep: str = ",") -> Column:
    """One line of a delimited table; cells with a separator, quote or line break are quoted."""
    odd = "[" + sep.replace("\\", "\\\\") + '"\\r\\n]'
    quoted = lambda c: F.when(F.rlike(c, F.lit(odd)), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.when((F.size(cells) == 1) & (F.get(cells, F.lit(0)) == ""), F.lit('""')).otherwise(
        F.array_join(F.transform(cells, lambda c: quoted(F.coalesce(c, F.lit("")))), sep)
    )


def ragged_lines(recs: DataFrame, header: DataFrame, keys: Sequence[str], sep: str = ",") -> DataFrame:
    """``keys, record_idx, head, line`` of records ``(keys, record_idx, fields)``: every table under its own header.

    ``header`` is ``(keys, column, position)``; a field a record lacks is empty.
    """
    own = header.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda c: c["column"]).alias("__h"))
    cells = F.transform("__h", lambda c: F.coalesce(F.try_element_at("fields", c), F.lit("")))
    return recs.join(own, list(keys)).select(*keys, "record_idx", csv_line(F.col("__h"), sep).alias("head"), csv_line(cells, sep).alias("line"))


def write_ragged(recs: DataFrame, header: DataFrame, path: str, key: str, sep: str = ",", part_rows: int = PART_ROWS) -> None:
    """Records written as delimited files, one folder a table and one file for each ``part_rows`` records, headers included.

    No column list is known to the driver, and a large table is written by many tasks.
    """
    lines = ragged_lines(recs, header, [key], sep).withColumn("part", F.expr(f"record_idx div {part_rows}"))
    heads = lines.groupBy(key, "part").agg(F.any_value("head").alias("value")).withColumn("record_idx", F.lit(-1).cast("long"))
    every = lines.select(key, "part", "record_idx", F.col("line").alias("value")).unionByName(heads)
    every = every.repartition(key, "part").sortWithinPartitions(key, "part", "record_idx").drop("record_idx")
    every.write.mode("errorifexists").partitionBy(key, "part").text(path)


def table_texts(recs: DataFrame, header: DataFrame, keys: Sequence[str], sep: str = ",") -> DataFrame:
    """``keys, content``: each table of records as one delimited text."""
    lines = ragged_lines(recs, header, keys, sep)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_idx", "line"))), lambda r: r["line"]), "\n")
    return lines.groupBy(*keys).agg(F.concat(F.any_value("head"), F.lit("\n"), body, F.lit("\n")).alias("content"))


def write_tables(df: DataFrame, path: str, by: str = "group") -> None:
    """CSV with header below one folder per group; missing cells are empty."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    (
        df.select(*cols)
        .write.mode("errorifexists")
        .partitionBy(by)
        .options(header=True, emptyValue="", escape='"')
        .csv(path)
    )


def write_report(df: DataFrame, path: str) -> None:
    """Report export: every cell quoted, quotes doubled."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    df.select(*cols).write.mode("errorifexists").options(header=True, quoteAll=True, escape='"', emptyValue='""').csv(path)

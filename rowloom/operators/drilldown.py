"""From files that differ to the rows and cells that differ, all pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators import diff
from rowloom.session import pin
from rowloom.sources import archives, markup, tables


def archive_tables(archives_: DataFrame, path: str = "path", content: str = "content", **limits) -> DataFrame:
    """The tables in archives as files ``(archive, path, filename, group, content)``.

    Delimited entries are taken as they are, markup entries become the table of
    their records; entries without records or that cannot be read are left out.
    ``limits`` are those of ``archives.expand_archives``.
    """
    entries = pin(archives.inventory(archives.expand_archives(archives_, path, content, **limits)))
    keys = ["archive", "path", "filename", "group"]
    plain = entries.filter(F.lower("filename").endswith(".csv")).select(*keys, archives.decode_text(F.col("content")).alias("content"))
    marked = entries.filter(~F.lower("filename").endswith(".csv"))
    recs = pin(markup.records(markup.flatten(marked, keys)))
    return plain.unionByName(tables.table_texts(recs, markup.header_of(recs, keys), keys))


def file_deltas(statuses: DataFrame, a: DataFrame, b: DataFrame, sep: str = ",", header: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Row deltas and counts of every pair of files that ``align.compare_files`` calls MODIFIED.

    Only the texts of such pairs are read as tables, cells in quotes included; rows are padded or cut to their header. ``pair_id`` is the JSON of
    ``group, filename, path_a, path_b``; ``options`` are those of ``diff.diff``.
    """
    pair = F.to_json(F.struct("group", "filename", "path_a", "path_b")).alias("pair")
    pairs = statuses.filter(F.col("status") == "MODIFIED").select(pair, "path_a", "path_b")

    def rows(files: DataFrame, path: str) -> DataFrame:
        found = pairs.select("pair", F.col(path).alias("logical_path")).join(files.select("logical_path", "content"), "logical_path")
        rows_ = tables.parse_tables(found.select("pair", "content"), "pair", sep=sep, header=header)
        return rows_.withColumnRenamed("pair", "pair_id")

    return diff.diff(rows(a, "path_a"), rows(b, "path_b"), **options)

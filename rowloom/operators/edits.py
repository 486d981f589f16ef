"""Batches of edits on tables of strings, all tables of a collection at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.plans.ranking import number_rows

MAX_NEW_COLUMNS = 10_000


def _unknown(patches: DataFrame, known: Sequence[str]) -> list[str]:
    names = patches.filter(F.col("column").isNotNull() & ~F.col("column").isin(*known)).select("column").distinct()
    found = [r["column"] for r in names.limit(MAX_NEW_COLUMNS + 1).collect()]
    if len(found) > MAX_NEW_COLUMNS:
        raise ValueError("the patches name more new columns than a table can hold")
    return sorted(c for c in found if c)


def patch_cells(
    df: DataFrame, patches: DataFrame, keys: Sequence[str] = (), row_idx: str = "row_idx", on_unknown: str = "add"
) -> DataFrame:
    """Apply ``patches(keys, row_idx, seq, column, value)``; the last write to a cell wins.

    Patches without row or column and those past the table's end do nothing. A
    new column is added (``on_unknown='add'``) or refused (``'error'``).
    """
    at = [*keys, row_idx]
    data = [c for c in df.columns if c not in at]
    patches = patches.filter(F.col(row_idx).isNotNull() & F.col("column").isNotNull())
    new = _unknown(patches, df.columns)
    if new and on_unknown == "error":
        raise ValueError(f"unknown columns: {', '.join(new)}")
    last = patches.groupBy(*at, "column").agg(F.max_by(F.coalesce("value", F.lit("")), "seq").alias("value"))
    per_row = last.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__p"))
    edited = df.join(per_row, at, "left")
    return edited.select(
        *at,
        *[F.coalesce(F.try_element_at("__p", F.lit(c)), F.col(c)).alias(c) for c in data],
        *[F.coalesce(F.try_element_at("__p", F.lit(c)), F.lit("")).alias(c) for c in new],
    )


def count_applied(df: DataFrame, patches: DataFrame, keys: Sequence[str] = (), row_idx: str = "row_idx") -> DataFrame:
    """How many patches hit a row."""
    hit = patches.filter(F.col("column").isNotNull()).join(df.select(*keys, row_idx), [*keys, row_idx], "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("updated"))


def patch_rows(df: DataFrame, patches: DataFrame, keys: Sequence[str] = (), row_idx: str = "row_idx", json: str = "row_data") -> DataFrame:
    """Overwrite known columns of rows from JSON objects; other names are ignored."""
    at = [*keys, row_idx]
    p = patches.select(*at, F.from_json(json, "map<string,string>").alias("__p"))
    return df.join(p, at, "left").select(
        *at, *[F.coalesce(F.try_element_at("__p", F.lit(c)), F.col(c)).alias(c) for c in df.columns if c not in at]
    )


def append_rows(df: DataFrame, rows: DataFrame, seq: str = "seq", row_idx: str = "row_idx") -> DataFrame:
    """Add rows after the last one in ``seq`` order; new columns become empty in old rows."""
    last = df.agg(F.coalesce(F.max(row_idx), F.lit(-1)).alias("n"))
    placed = number_rows(rows, [], [seq], number="__n").withColumn(row_idx, (last.scalar() + F.col("__n")).cast("long"))
    out = df.unionByName(placed.drop("__n", seq), allowMissingColumns=True)
    return out.na.fill("", subset=[c for c, t in out.dtypes if t == "string"])


def add_table(catalog: DataFrame, entry: DataFrame) -> DataFrame:
    """Catalog with new empty tables; a name that exists keeps its entry."""
    fresh = entry.join(catalog.select("filename"), "filename", "left_anti")
    return catalog.unionByName(fresh.select(*catalog.columns))


def drop_table(catalog: DataFrame, names: DataFrame) -> DataFrame:
    return catalog.join(names.select("filename"), "filename", "left_anti")

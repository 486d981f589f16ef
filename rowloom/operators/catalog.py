"""Catalog of tables: rollups, profiles, previews, sorting, unique names, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import naming
from rowloom.plans.ranking import number_rows, running_max, top_rows
from rowloom.session import pin

def _count() -> Column:
    return F.count(F.lit(1))


def build_catalog(rows: DataFrame, size: Column, cells: str = "cells", keys: Sequence[str] = ("filename", "group")) -> DataFrame:
    """Rows, columns and bytes per table from its rows."""
    return rows.groupBy(*keys).agg(
        _count().alias("rows"), F.max(F.size(cells)).alias("columns"), F.sum(size).alias("size_bytes")
    )


def group_summary(catalog: DataFrame, totals: bool = False) -> DataFrame:
    """Files, rows and bytes per group; with ``totals`` also the grand total under a null group."""
    grouped = catalog.rollup("group") if totals else catalog.groupBy("group")
    return grouped.agg(
        _count().alias("file_count"), F.sum("rows").alias("total_rows"), F.sum("size_bytes").alias("total_size")
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and non-empty count per column of one wide table."""
    filled = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in columns]
    return df.agg(_count().alias("row_count"), *filled)


def profile_rows(rows: DataFrame, keys: Sequence[str], cells: str = "cells") -> DataFrame:
    """Row count and non-empty count per column position of many tables at once."""
    long = rows.select(*keys, F.posexplode(cells).alias("pos", "cell"))
    return long.groupBy(*keys, "pos").agg(
        _count().alias("row_count"), F.count_if(F.coalesce("cell", F.lit("")) != "").alias("non_empty")
    )


def sample_rows(rows: DataFrame, keys: Sequence[str], row_idx: str = "row_idx", n: int = 5) -> DataFrame:
    return top_rows(rows, keys, [F.col(row_idx).asc()], n)


def index_groups(chunks: DataFrame) -> DataFrame:
    """Chunks per group; summaries and markers do not count."""
    return (
        chunks.filter(~F.coalesce("doc_type", F.lit("")).isin("summary", "file_marker") & F.col("group").isNotNull())
        .groupBy("group")
        .agg(_count().alias("chunk_count"))
    )


def index_stats(chunks: DataFrame) -> DataFrame:
    is_chunk = ~F.coalesce("doc_type", F.lit("")).isin("summary", "file_marker") & F.col("group").isNotNull()
    return chunks.agg(
        _count().alias("documents"),
        F.count_if(is_chunk).alias("total_chunks"),
        (_count() - F.count_if(is_chunk)).alias("total_summaries"),
        F.count_distinct(F.when(is_chunk, F.col("group"))).alias("total_groups"),
    )


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of counts, one per named condition, from one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def conversion_stats(outcomes: DataFrame) -> DataFrame:
    """Totals over conversion outcomes ``(success, skipped, rows, seconds)``."""
    ok = F.col("success") & ~F.col("skipped")
    return outcomes.agg(
        _count().alias("total_files"),
        F.count_if(ok).alias("success"),
        F.count_if(~F.col("success") & ~F.col("skipped")).alias("failed"),
        F.count_if("skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0).cast("long")).alias("total_rows"),
        F.coalesce(F.try_divide(F.sum(F.when(~F.col("skipped"), F.col("seconds"))), F.count_if(ok)), F.lit(0.0)).alias("avg_seconds"),
    )


def conversion_stats_by_group(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.filter(F.col("success") & ~F.col("skipped"))
        .groupBy("group")
        .agg(_count().alias("success"), F.sum("rows").alias("total_rows"))
    )


def status_counts(df: DataFrame, status: str, statuses: Sequence[str] | None = None) -> DataFrame:
    """Rows per status; with ``statuses`` as one row with a column each and the total."""
    if statuses is None:
        return df.groupBy(status).agg(_count().alias("n"))
    return df.agg(_count().alias("total"), *[F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses])


def estimate(groups: DataFrame, chosen: Sequence[str], name: str = "group", records: str = "record_count") -> DataFrame:
    return groups.filter(F.col(name).isin(*chosen)).agg(F.coalesce(F.sum(records), F.lit(0).cast("long")).alias("records"))


# --- filters ---------------------------------------------------------------

def filter_groups(df: DataFrame, groups: Sequence[str], col: str = "group") -> DataFrame:
    return df.filter(F.col(col).isin(*groups))


def count_skipped(df: DataFrame, groups: Sequence[str], col: str = "group") -> DataFrame:
    return df.agg(F.count_if(~F.col(col).isin(*groups)).alias("skipped"))


def where_meta(df: DataFrame, group: str | None = None, doc_type: str | None = None) -> DataFrame:
    for name, value in (("group", group), ("doc_type", doc_type)):
        if value:
            df = df.filter(F.col(name) == value)
    return df


def search_groups(df: DataFrame, text: str, name: str = "group") -> DataFrame:
    return df.filter(F.contains(F.lower(name), F.lit(text.lower()))) if text else df


# --- order and top ---------------------------------------------------------

def sort_key(df: DataFrame, col: str, direction: str = "asc") -> Column:
    """Nulls last both ways; strings without regard to case, numbers as numbers."""
    c = F.lower(col) if dict(df.dtypes)[col] == "string" else F.col(col)
    return c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()


def sort_table(df: DataFrame, col: str, direction: str = "asc", then: Sequence[str] = ()) -> DataFrame:
    """Sort by a column; ``then`` keeps the original order among equals."""
    return df.orderBy(sort_key(df, col, direction), *then)


def head_of(df: DataFrame, col: str, direction: str, n: int, then: Sequence[str] = ()) -> DataFrame:
    """First ``n`` of the sorted rows with the number shown and the total."""
    total = df.agg(_count().alias("n"))
    return (
        sort_table(df, col, direction, then)
        .limit(n)
        .withColumn("total", total.scalar())
        .withColumn("showing", F.least(F.col("total"), F.lit(n).cast("long")))
    )


def preview(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """First ``n`` rows with the row and column count of the whole table."""
    total = df.agg(_count().alias("n"))
    return (
        df.orderBy(order)
        .limit(n)
        .withColumn("total_rows", total.scalar())
        .withColumn("columns", F.lit(len(df.columns)))
    )


def latest(df: DataFrame, ts: str, n: int = 200, then: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(ts), *then).limit(n)


def owner_rows(
    df: DataFrame, owner: str, value, ts: str, n: int = 50, status: tuple[str, str] | None = None, then: Sequence[str] = ()
) -> DataFrame:
    """Newest rows of one owner, optionally of one status."""
    df = df.filter(F.col(owner) == value)
    if status:
        df = df.filter(F.col(status[0]) == status[1])
    return latest(df, ts, n, then)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of every key; each task keeps one row per key before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def dedupe_groups(files: DataFrame, path: str = "path", group: str = "group", seq: str = "seq") -> DataFrame:
    """Groups without regard to case; a file listed twice keeps its first group."""
    rest = [c for c in files.columns if c != path]
    first = files.groupBy(path).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r")).select(path, "r.*")
    return first.withColumn(group, naming.canonical_group(F.col(group)))


# --- names and row numbers -------------------------------------------------

def flat_name(path: Column, ext: str = ".csv") -> Column:
    """Path parts joined by ``__``, with the output extension."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.array_join(F.concat(folders, F.array(naming.stem(path))), "__"), F.lit(ext))


NAME_BLOCK = 100_000  # numbers of a name that one task passes over


def unique_names(files: DataFrame, path: str = "path", ext: str = ".csv") -> DataFrame:
    """Output name per file; files whose names meet get ``_1``, ``_2`` in path order.

    A number that another file has in its own name is passed over: the m-th free
    number is m plus how many taken ones have fewer than m free numbers below
    them, a running maximum over both, in blocks.
    """
    base = files.withColumn("__base", flat_name(F.col(path), ext))
    placed = number_rows(base, ["__base"], [path], number="__k")
    bare = F.regexp_replace("__base", r"\.[^.]+$", "")
    shared = base.groupBy("__base").agg(_count().alias("n")).filter("n > 1").select("__base")
    taken = (
        base.select("__base").distinct()
        .select(F.regexp_extract(bare, r"^(.*)_(\d{1,9})$", 1).alias("b"), F.regexp_extract(bare, r"^(.*)_([1-9]\d{0,8})$", 2).alias("n"))
        .filter("b <> '' and n <> ''")
        .select(F.concat("b", F.lit(ext)).alias("__base"), F.col("n").cast("long").alias("n"))
        .distinct()
        .join(shared, "__base", "left_semi")
    )
    taken = number_rows(taken, ["__base"], ["n"], number="i", block=F.expr(f"n div {NAME_BLOCK}"))
    steps = taken.select("__base", (2 * (F.col("n") - F.col("i")) + 1).alias("__o"), F.col("i").alias("__i"), *[F.lit(None).cast(t).alias(c) for c, t in files.dtypes])
    asks = placed.select("__base", (2 * (F.col("__k") - 1)).alias("__o"), F.lit(None).cast("long").alias("__i"), *files.columns)
    both = pin(steps.withColumn("__file", F.lit(False)).unionByName(asks.withColumn("__file", F.lit(True))))
    both = running_max(both, ["__base"], "__o", "__i", "__passed", F.expr(f"__o div {2 * NAME_BLOCK}")).filter("__file")
    number = F.expr("__o div 2") + F.coalesce("__passed", F.lit(0))
    name = F.when(F.col("__o") == 0, F.col("__base")).otherwise(F.concat(bare, F.lit("_"), number.cast("string"), F.lit(ext)))
    return both.withColumn("csv_name", name).select(*files.columns, "csv_name")


def delete_rows(rows: DataFrame, gone: DataFrame, keys: Sequence[str], row_idx: str = "row_idx", block_rows: int = 100_000) -> DataFrame:
    """Drop rows by index and number the rest from 0 without gaps."""
    kept = rows.join(gone.select(*keys, row_idx).distinct(), [*keys, row_idx], "left_anti")
    placed = number_rows(kept, keys, [row_idx], number="__n", block=F.expr(f"{row_idx} div {block_rows}"))
    return placed.withColumn(row_idx, F.col("__n") - 1).drop("__n")

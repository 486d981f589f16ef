"""Joins against groups, mappings and index status, and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import naming


def with_group(files: DataFrame, mapping: DataFrame, path: str = "path", filename: str = "filename") -> DataFrame:
    """Group of every file from a path mapping, inferred from its names when absent there."""
    known = mapping.select(F.col(path), F.col("group").alias("__g"))
    group = F.coalesce("__g", naming.infer_group(F.col(path), F.col(filename)))
    return files.join(known, path, "left").withColumn("group", group).drop("__g")


def _by_stem(
    files: DataFrame, stem: Column, parts, groups: DataFrame, name: Column, group: str, order: str, known: Column | None = None
) -> DataFrame:
    """``files`` with the first group whose name is one of the ``parts`` of their stem.

    ``parts`` takes the stem and the column of what is ``known`` of all groups.

    Stems are matched once each and joined back, so equal files stay rows of their own.
    """
    stems = files.select(stem.alias("__s")).filter("__s IS NOT NULL").distinct()
    stems = stems.withColumn("__k", F.lit(None) if known is None else known)
    cand = stems.select("__s", F.explode(F.array_distinct(parts(F.col("__s"), F.col("__k")))).alias("__p"))
    g = groups.select(name.alias("__p"), F.col(group).alias("matched_group"), F.col(order).alias("__o"))
    found = cand.join(g, "__p").groupBy("__s").agg(F.min_by("matched_group", "__o").alias("matched_group"))
    return files.withColumn("__s", stem).join(found, "__s").drop("__s")


def match_prefix(files: DataFrame, groups: DataFrame, filename: str = "filename", group: str = "group", order: str = "ord") -> DataFrame:
    """First group whose name is the stem or starts it before an underscore.

    The stem's prefixes are joined by equality, so no file meets every group.
    """
    def prefixes(s: Column, _: Column) -> Column:
        parts = F.split(s, "_")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))

    return _by_stem(files, F.upper(naming.stem(F.col(filename))), prefixes, groups, F.upper(group), group, order)


def match_contains(files: DataFrame, groups: DataFrame, filename: str = "filename", group: str = "group", order: str = "ord") -> DataFrame:
    """First group whose name occurs in the stem, in any case.

    Substrings of the lengths that group names have are joined by equality.
    """
    used = groups.filter(F.length(group) > 0).agg(F.array_sort(F.collect_set(F.length(group))).alias("l")).scalar()

    def cuts(s: Column, lengths: Column) -> Column:
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda at: F.substring(s, at, n))
        return F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(s)), cut))

    return _by_stem(files, F.lower(naming.stem(F.col(filename))), cuts, groups, F.lower(group), group, order, used)


def _upper_names(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.upper(col).alias("__u")).distinct()


def selectable(groups: DataFrame, auto: DataFrame, name: str = "group") -> DataFrame:
    """Groups that are not indexed automatically."""
    return groups.withColumn("__u", F.upper(name)).join(_upper_names(auto, name), "__u", "left_anti").drop("__u")


def eligible(groups: DataFrame, configured: DataFrame, name: str = "group") -> DataFrame:
    """Upper-case groups that are present and configured; UNKNOWN never is."""
    present = _upper_names(groups.filter((F.col(name) != "") & (F.col(name) != "UNKNOWN")), name)
    return present.join(configured.select(F.col(name).alias("__u")), "__u", "left_semi").select(F.col("__u").alias(name))


def group_status(groups: DataFrame, chunk_counts: DataFrame, name: str = "group") -> DataFrame:
    """Groups with index state; not indexed and 0 chunks where the index has none."""
    c = chunk_counts.select(F.col(name), F.col("chunk_count").alias("__c"))
    return groups.join(c, name, "left").select(
        *groups.columns,
        F.col("__c").isNotNull().alias("indexed"),
        F.coalesce("__c", F.lit(0).cast("long")).alias("chunk_count"),
    )


def recent_with_owner(detail: DataFrame, owner: DataFrame, on: Column, ts: str, n: int = 200, then: Sequence[str] = ()) -> DataFrame:
    return detail.join(owner, on).orderBy(F.desc(ts), *then).limit(n)


def all_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def missing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def union_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables over all their columns; what a table lacks is empty."""
    out = a.unionByName(b, allowMissingColumns=True)
    text = [c for c, t in out.dtypes if t == "string"]
    return out.na.fill("", subset=text) if text else out

"""Summary, ranking, trend and comparison analyses over any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.plans.ranking import rank_rows, top_rows, value_at

def _count() -> Column:
    return F.count(F.lit(1))


def measures(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, sum, mean, median, min, max and standard deviation of a measure."""
    keys = list(keys)
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.stddev_samp(value).alias("stddev"),
    )
    mid = value_at(df, keys, value, [0.5])
    if not keys:
        return out.withColumn("median", mid.select("q0").scalar())
    return _join_same(out, mid.withColumnRenamed("q0", "median"), keys)


def _join_same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys, where null equals null."""
    r = b.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return a.join(r, cond, "left").drop(*[f"__j{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, value: str, keys: Sequence[str] = (), at: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int | None = None) -> DataFrame:
    """Exact percentiles, or within ``1/accuracy`` from a sketch when that is given."""
    names = [f"p{round(p * 100)}" for p in at]
    if accuracy:
        q = F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in at]), accuracy)
        out = df.groupBy(*keys).agg(q.alias("__q"))
        return out.select(*keys, *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    out = value_at(df, keys, value, at)
    return out.select(*keys, *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def outliers(df: DataFrame, value: str, keys: Sequence[str] = (), z: float = 3.0) -> DataFrame:
    """Rows more than ``z`` standard deviations off the mean of their key."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    if keys:
        joined = df.join(stats, list(keys))
    else:
        one = stats.select(F.struct("__m", "__s").alias("s"))
        joined = df.withColumn("__st", one.scalar()).select("*", "__st.*").drop("__st")
    return joined.withColumn("z_score", (F.col(value) - F.col("__m")) / F.col("__s")).filter(F.abs("z_score") > z).drop("__m", "__s")


def top_and_bottom(df: DataFrame, value: str, n: int, keys: Sequence[str] = (), then: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest and ``n`` smallest rows per key, with ``side`` and ``rn``."""
    def pick(order: list[Column], side: str) -> DataFrame:
        if keys:
            out = top_rows(df, keys, order, n)
        else:
            few = df.orderBy(*order).limit(n)
            out = few.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
        return out.withColumn("side", F.lit(side))

    tail = [F.col(c) for c in then]
    return pick([F.desc(value), *tail], "top").unionByName(pick([F.asc(value), *tail], "bottom"))


def rank_and_share(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank by value and share of the key's total; a derived ``df`` should be pinned, it is read more than once."""
    ranked = rank_rows(df, keys, value)
    total = df.groupBy(*keys).agg(F.sum(value).alias("__t"))
    if keys:
        out = ranked.join(total, list(keys))
    else:
        out = ranked.withColumn("__t", total.scalar())
    return out.withColumn("share", F.col(value) / F.col("__t")).drop("__t")


def compare_groups(df: DataFrame, keys: Sequence[str], by: str, left: str, right: str, value: Column) -> DataFrame:
    """Two groups side by side with difference and percentage difference."""
    side = lambda g: F.when(F.col(by) == g, value)
    out = df.filter(F.col(by).isin(left, right)).groupBy(*keys).agg(
        F.sum(side(left)).alias("left_value"), F.sum(side(right)).alias("right_value")
    )
    diff = F.col("right_value") - F.col("left_value")
    return out.withColumn("difference", diff).withColumn("pct_difference", F.try_divide(diff, F.col("left_value")) * 100)


def by_period(df: DataFrame, ts: str, unit: str, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc(unit, ts).alias("period")).agg(value.alias("value"))


def period_change(periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change from the period before, absolute and in percent.

    Runs on totals per period; ``keys`` split the work, one calendar each.
    """
    w = Window.partitionBy(*keys).orderBy("period")
    before = F.lag("value").over(w)
    return periods.withColumn("previous", before).withColumn("change", F.col("value") - F.col("previous")).withColumn(
        "pct_change", F.try_divide(F.col("change"), F.col("previous")) * 100
    )


def turning_points(periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Peaks, troughs and direction of every period."""
    w = Window.partitionBy(*keys).orderBy("period")
    before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    return periods.withColumn(
        "turn", F.when((v > before) & (v > after), "peak").when((v < before) & (v < after), "trough").otherwise("none")
    ).withColumn("direction", F.when(v > before, "up").when(v < before, "down").when(v == before, "flat").otherwise("start"))


def slope(df: DataFrame, y: Column, x: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"))


def field_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, filled rows, share filled, a sample value; one pass and a fixed-size result."""
    aggs = []
    for i, c in enumerate(columns):
        s = F.nullif(F.col(c).cast("string"), F.lit(""))
        aggs += [F.count(s).alias(f"f{i}"), F.min(s).alias(f"s{i}")]
    one = df.agg(_count().alias("n"), *aggs)
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"f{i}").alias("filled"), F.col(f"s{i}").alias("sample_value"))
            for i, c in enumerate(columns)
        ]
    )
    return one.select("n", F.explode(entries).alias("e")).select(
        "e.field", F.col("n").alias("row_count"), "e.filled", F.try_divide(F.col("e.filled"), F.col("n")).alias("share"), "e.sample_value"
    )


def ranked_fields(inventory: DataFrame) -> DataFrame:
    """An inventory with the place of each field among the fullest and among the sparsest, ties by name."""
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    # one row a column of the table
    return inventory.withColumn("fullest", place(F.desc("filled"), F.asc("field"))).withColumn("sparsest", place(F.asc("filled"), F.asc("field")))


def group_records(df: DataFrame, group: str) -> DataFrame:
    """Records per group and their share of all."""
    counts = df.groupBy(group).agg(_count().alias("records"))
    return counts.withColumn("share", F.col("records") / counts.agg(F.sum("records")).scalar())


def summary_row(df: DataFrame, summary: dict[str, str | Column], columns: Sequence[str] | None = None) -> DataFrame:
    """One row below a table: per column a fixed text or an aggregate shown as text; empty for all other columns."""
    def shown(c: str) -> Column:
        what = summary.get(c, "")
        return (F.lit(what) if isinstance(what, str) else F.coalesce(what.cast("string"), F.lit(""))).alias(c)

    return df.agg(*[shown(c) for c in columns or df.columns])


def with_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Table per key with a Total row: sum and average."""
    label = F.when(F.grouping_id() == 1, "Total").otherwise(F.col(key).cast("string"))
    return df.rollup(key).agg(
        label.alias("label"), F.sum(value).alias("total"), F.avg(value).alias("average")
    ).drop(key)


def correlation(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(a, b).alias("correlation"))


def kpis(df: DataFrame, value: str, entity: str, approximate: bool = False) -> DataFrame:
    """Total, distinct entities, range and share filled."""
    distinct = F.approx_count_distinct(entity) if approximate else F.count_distinct(entity)
    return df.agg(
        F.sum(value).alias("total"),
        distinct.alias("entities"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.avg(F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)).alias("share_filled"),
    )


def first_and_last(df: DataFrame, entity: str, value: str, order: Sequence[str]) -> DataFrame:
    """First and last value per entity; order columns must tell rows apart."""
    at = F.struct(*order)
    return df.groupBy(entity).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))


def distribution(df: DataFrame, category: str, k: int) -> DataFrame:
    """The ``k`` most frequent categories and ``Other``, with share."""
    counts = df.groupBy(category).agg(_count().alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc(category)).limit(k).select(F.col(category).alias("__c"), F.lit(True).alias("__top"))
    total = df.agg(_count().alias("n"))
    named = counts.join(top, counts[category].eqNullSafe(F.col("__c")), "left")
    label = F.when(F.col("__top"), F.col(category).cast("string")).otherwise(F.lit("Other"))
    return (
        named.groupBy(label.alias("category"))
        .agg(F.sum("n").alias("n"))
        .withColumn("share", F.col("n") / total.scalar())
    )

"""Row numbers and running sums that no single task has to do alone.

A window over a hot key runs in one task. Here every key is cut into blocks
that follow the sort order; each block is numbered on its own, and block totals
(one row per key and block) give the offsets to add.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import pin

BLOCK = "__block"


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sorted_blocks(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by ``order`` and keep the partition number as block.

    The result is pinned: range bounds come from a sample, so a second
    evaluation could cut elsewhere.
    """
    cols = [_name(c) for c in order]
    return pin(df.repartitionByRange(*cols).withColumn(BLOCK, F.spark_partition_id().cast("long")))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    number: str | None = "rn",
    sums: dict[str, Column] | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Add a 1-based row number and running sums within ``keys`` along ``order``.

    ``order`` must be total within a key. ``block`` is an optional column
    expression that never decreases along ``order`` (for example
    ``row_idx div 50000``); without it the rows are range-partitioned first.
    With ``block`` the input is read twice, the second time for keys, block and
    summands only, so a costly one should be pinned by the caller.
    """
    sums = sums or {}
    keys = list(keys)
    cols = [_name(c) for c in order]
    if block is None:
        df = sorted_blocks(df, [F.col(k) for k in keys] + cols)
    else:
        df = df.withColumn(BLOCK, block)

    local = Window.partitionBy(*keys, BLOCK).orderBy(*cols)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    if number:
        out = out.withColumn("__n", F.row_number().over(local))
    for name, expr in sums.items():
        out = out.withColumn(f"__s_{name}", F.sum(expr).over(upto))

    totals = df.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("__count"), *[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(BLOCK).alias("__b"),
        F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"),
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    cond = F.col(BLOCK) == F.col("__b")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = out.join(offsets, cond)
    if number:
        joined = joined.withColumn(number, (F.col("__n") + F.col("__before")).cast("long"))
    for n in sums:
        joined = joined.withColumn(n, F.col(f"__s_{n}") + F.col(f"__o_{n}"))
    keep = [c for c in df.columns if c != BLOCK] + ([number] if number else []) + list(sums)
    return joined.select(*keep)


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, block: Column) -> DataFrame:
    """Add the largest ``value`` of the rows up to each one within ``keys`` along ``order``.

    ``block`` never decreases along ``order``; every block is worked through on
    its own, and the maxima of the blocks before come as one row per block.
    """
    keys = list(keys)
    df = df.withColumn(BLOCK, block)
    upto = Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, BLOCK).agg(F.max(value).alias("__top"))
    tops = tops.withColumn("__top", F.max("__top").over(before))
    out = df.withColumn("__own", F.max(value).over(upto)).join(tops, [*keys, BLOCK])
    return out.withColumn(name, F.greatest("__own", "__top")).drop(BLOCK, "__own", "__top")


def rank_rows(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank", tie: str | None = None) -> DataFrame:
    """SQL ``rank()`` by ``value`` descending within ``keys``, counted over distinct values.

    Equal values are first counted together, so a value that many rows share
    is one row in the numbering.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = number_rows(counts, keys, [F.desc_nulls_last(value)], number=None, sums={"__upto": F.col("__c")})
    placed = placed.select(*keys, value, (F.col("__upto") - F.col("__c") + 1).cast("long").alias(rank))
    r = placed.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate([*keys, value])], rank)
    cond = F.lit(True)
    for i, c in enumerate([*keys, value]):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    return df.join(r, cond).select(*df.columns, rank)


GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key along a total order.

    Up to ``GROUP_LIMIT`` rows Spark cuts every task's rows to ``n`` per key
    before it shuffles; beyond, the rows are numbered block by block.
    """
    if n > GROUP_LIMIT:
        placed = number_rows(df, keys, order, number=rank)
        return placed.filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("int"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def value_at(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles per key: columns ``q0, q1, ...`` for ``shares``.

    Distinct values are counted and placed in order by blocks, so no task
    holds the values of a whole key.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = number_rows(counts, keys, [value], number=None, sums={"__upto": F.col("__c")})
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    if keys:
        t = total.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(keys)], "__total")
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__t{i}"))
        placed = placed.join(t, cond)
    else:
        placed = placed.withColumn("__total", total.scalar())
    picks = []
    for i, p in enumerate(shares):
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        holds = lambda at: (F.col("__upto") - F.col("__c") <= at) & (at < F.col("__upto"))
        picks += [
            F.max(F.when(holds(F.floor(pos)), F.col(value))).alias(f"__lo{i}"),
            F.max(F.when(holds(F.ceil(pos)), F.col(value))).alias(f"__hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"__f{i}"),
        ]
    at = placed.groupBy(*keys).agg(*picks)
    between = [
        F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}") for i in range(len(shares))
    ]
    return at.select(*keys, *[b.cast("double").alias(f"q{i}") for i, b in enumerate(between)])

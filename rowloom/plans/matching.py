"""Greedy one-to-one matching: best score first, ties by left then right order.

A pair that is best for both its ends under that order is always part of the
greedy result, so pairs can be settled in rounds. Buckets whose pairs are few
are settled at once in bins of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.plans.ranking import number_rows
from rowloom.session import fresh, pin

GROUP_LIMIT = 1_000_000  # pairs and rows of a bucket that one task settles
BIN_ROWS = 200_000  # rows of small buckets settled together
MATCH_SCHEMA = "bucket string, id_a long, id_b long, score double"


def _settle(key, pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Greedy matching of a bin of bounded buckets, level by level of equal scores."""
    queues = {"a": defaultdict(list), "b": defaultdict(list)}
    members = members.sort_values("row_id", ascending=False)
    for side, bucket, cls, rid in zip(members.side, members.bucket, members.cls, members.row_id):
        queues[side][bucket, cls].append(rid)
    left, right = queues["a"], queues["b"]
    found = []
    pairs = pairs.sort_values(["bucket", "score"], ascending=[True, False])
    rows = zip(pairs.bucket, pairs.score, pairs.cls_a, pairs.cls_b)
    for (bucket, score), level in groupby(rows, key=lambda r: r[:2]):
        partners = defaultdict(list)
        for _, _, ca, cb in level:
            partners[ca].append(cb)
        spent = set()
        for rid, ca in sorted((rid, ca) for ca in partners for rid in left[bucket, ca]):
            free = partners[ca] = [cb for cb in partners[ca] if right[bucket, cb]]
            if free:
                cb = min(free, key=lambda c: right[bucket, c][-1]) if len(free) > 1 else free[0]
                found.append((bucket, rid, right[bucket, cb].pop(), score))
                spent.add(rid)
        if spent:
            for ca in partners:
                left[bucket, ca] = [r for r in left[bucket, ca] if r not in spent]
    return pd.DataFrame(found, columns=["bucket", "id_a", "id_b", "score"])


def _tied_groups(pairs: DataFrame) -> DataFrame:
    """``(side, bucket, cls, score, grp)`` of classes that are tied all with all.

    Left classes whose best partners are the same right classes at the same
    score, each of which has exactly these left classes as its best partners,
    meet no better pair outside. Sets are compared by their size and the
    exclusive or of their members' hashes. A single pair without a rival is the
    smallest such group.
    """
    def tops(cls: str, partner: str, side: str) -> DataFrame:
        levels = pairs.groupBy("bucket", cls, "score").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(partner)).alias("h"))
        best = levels.groupBy("bucket", cls).agg(F.max(F.struct("score", "n", "h")).alias("t"))
        return best.select(F.lit(side).alias("side"), "bucket", F.col(cls).alias("cls"), "t.score", "t.n", "t.h")

    both = pin(tops("cls_a", "cls_b", "a").unionByName(tops("cls_b", "cls_a", "b")))
    alike = both.groupBy("side", "bucket", "score", "n", "h").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cls")).alias("own"))
    one = lambda side, n, h, m, own: alike.filter(F.col("side") == side).select(
        "bucket", "score", F.col("n").alias(n), F.col("h").alias(h), F.col("m").alias(m), F.col("own").alias(own)
    )
    # the partners of one side are the members of the other, both ways
    met = one("a", "n_b", "h_b", "n_a", "h_a").join(one("b", "n_a", "h_a", "n_b", "h_b"), ["bucket", "score", "n_a", "h_a", "n_b", "h_b"])
    met = pin(met.withColumn("grp", F.xxhash64("score", "h_a", "h_b")))
    side_a = met.select(F.lit("a").alias("side"), "bucket", "score", F.col("n_b").alias("n"), F.col("h_b").alias("h"), "grp")
    side_b = met.select(F.lit("b").alias("side"), "bucket", "score", F.col("n_a").alias("n"), F.col("h_a").alias("h"), "grp")
    return both.join(side_a.unionByName(side_b), ["side", "bucket", "score", "n", "h"]).select("side", "bucket", "cls", "score", "grp")


def one_round(pairs: DataFrame, rows: DataFrame, block_rows: int, whole: bool = True) -> DataFrame:
    """Row pairs ``(bucket, id_a, id_b, score)`` that greedy matching is sure to make now.

    Of classes tied all with all the k-th free left row pairs with the k-th free
    right one, all at once. What is tied in other ways settles one row of each
    mutually best pair. ``whole`` says that ``pairs`` are all pairs of their
    classes; with the best ones only, ties are settled in the second way.
    """
    block = F.expr(f"row_id div {block_rows}")
    found = None
    if whole:
        groups = pin(_tied_groups(pairs))
        tied_rows = rows.join(groups, ["side", "bucket", "cls"])
        tied_rows = number_rows(tied_rows.select("side", "bucket", "grp", "score", "row_id"), ["side", "bucket", "grp"], ["row_id"], number="k", block=block)
        left = tied_rows.filter("side = 'a'").select("bucket", "grp", "k", "score", F.col("row_id").alias("id_a"))
        right = tied_rows.filter("side = 'b'").select("bucket", "grp", "k", F.col("row_id").alias("id_b"))
        found = left.join(right, ["bucket", "grp", "k"]).select("bucket", "id_a", "id_b", "score")
    placed = pin(number_rows(rows, ["side", "bucket", "cls"], ["row_id"], number="k", block=block))

    def heads(side: str) -> DataFrame:
        """Rows left and first row of every class of a side."""
        mine = placed.filter(F.col("side") == side)
        return mine.groupBy("bucket", F.col("cls").alias(f"cls_{side}")).agg(
            F.max("k").alias(f"left_{side}"), F.min("row_id").alias(f"head_{side}")
        )

    p = pin(pairs.join(heads("a"), ["bucket", "cls_a"]).join(heads("b"), ["bucket", "cls_b"]))
    order = F.struct("score", (-F.col("head_a")).alias("ra"), (-F.col("head_b")).alias("rb"), "cls_a", "cls_b", "left_a", "left_b")
    best = lambda cls: p.groupBy("bucket", cls).agg(F.max(order).alias("m")).select("bucket", "m.*")
    mutual = best("cls_a").join(
        best("cls_b").select("bucket", "cls_a", "cls_b"), ["bucket", "cls_a", "cls_b"], "left_semi"
    )
    if whole:
        mutual = mutual.join(groups.filter("side = 'a'").select("bucket", F.col("cls").alias("cls_a")), ["bucket", "cls_a"], "left_anti")

    def tied(mine: str, other: str) -> DataFrame:
        """Classes whose best score another pair of theirs has too."""
        top = mutual.select("bucket", mine, F.col(other).alias("chosen"), F.col("score").alias("top"))
        rival = p.join(top, ["bucket", mine]).filter((F.col(other) != F.col("chosen")) & (F.col("score") == F.col("top")))
        return rival.select("bucket", mine).distinct().withColumn(f"tied_{mine}", F.lit(True))

    # a pair with no rival of equal score settles all its copies at once
    take = F.when(F.col("tied_cls_a") | F.col("tied_cls_b"), F.lit(1)).otherwise(F.least("left_a", "left_b"))
    settled = pin(
        mutual.join(tied("cls_a", "cls_b"), ["bucket", "cls_a"], "left")
        .join(tied("cls_b", "cls_a"), ["bucket", "cls_b"], "left")
        .select("bucket", "cls_a", "cls_b", "score", take.alias("take"))
    )
    pick = lambda s: placed.filter(F.col("side") == s).select(
        "bucket", F.col("cls").alias(f"cls_{s}"), "k", F.col("row_id").alias(f"id_{s}")
    )
    mixed = (
        settled.join(pick("a"), ["bucket", "cls_a"])
        .filter(F.col("k") <= F.col("take"))
        .join(pick("b"), ["bucket", "cls_b", "k"])
        .select("bucket", "id_a", "id_b", "score")
    )
    return mixed if found is None else found.unionByName(mixed)


def bin_count(df: DataFrame, rows: int) -> int:
    """Bins for bounded groups that share a task: of bounded size, and enough to keep the cores busy."""
    return max(rows // BIN_ROWS, min(df.sparkSession.sparkContext.defaultParallelism, rows // 100), 1)


def greedy_match(
    pairs: DataFrame, classes_a: DataFrame, classes_b: DataFrame, limit: int = GROUP_LIMIT, block_rows: int = 100_000
) -> DataFrame:
    """Match rows one to one from class pairs ``(bucket, cls_a, cls_b, score)``.

    ``classes_*`` hold ``(bucket, cls, row_id)``. Buckets with at most
    ``limit`` pairs and rows are settled at once; larger ones take rounds of
    mutually best pairs until what is left of them is small enough.
    """
    pairs = pin(pairs)
    rows = (
        classes_a.select("bucket", "cls", "row_id", F.lit("a").alias("side"))
        .unionByName(classes_b.select("bucket", "cls", "row_id", F.lit("b").alias("side")))
    )
    out = None
    while True:
        # rows of classes that occur in no pair cannot match
        live = (
            pairs.select("bucket", F.col("cls_a").alias("cls"), F.lit("a").alias("side"))
            .unionByName(pairs.select("bucket", F.col("cls_b").alias("cls"), F.lit("b").alias("side")))
            .distinct()
        )
        rows = rows.join(live, ["bucket", "cls", "side"], "left_semi")
        weight = (
            pairs.select("bucket").unionByName(rows.select("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("w"))
        )
        total, n_large = weight.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count_if(F.col("w") > limit)).first()
        small_pairs, small_rows = pairs, rows
        if n_large:
            large = pin(weight.filter(F.col("w") > limit).select("bucket"))
            rows = pin(rows)
            small_pairs, small_rows = (d.join(large, "bucket", "left_anti") for d in (pairs, rows))
        bins = F.pmod(F.xxhash64("bucket"), F.lit(bin_count(pairs, total))).alias("bin")
        found = (
            small_pairs.select("*", bins).groupBy("bin")
            .cogroup(fresh(small_rows.select("*", bins)).groupBy("bin"))
            .applyInPandas(_settle, MATCH_SCHEMA)
        )
        out = found if out is None else out.unionByName(found)
        if not n_large:
            return out

        pairs, rows = (d.join(large, "bucket", "left_semi") for d in (pairs, rows))
        got = pin(one_round(pairs, rows, block_rows))
        out = out.unionByName(got)
        spent = got.select("bucket", F.lit("a").alias("side"), F.col("id_a").alias("row_id")).unionByName(
            got.select("bucket", F.lit("b").alias("side"), F.col("id_b").alias("row_id"))
        )
        rows = pin(rows.join(spent, ["bucket", "side", "row_id"], "left_anti"))
        free = lambda s: rows.filter(F.col("side") == s).select("bucket", F.col("cls").alias(f"cls_{s}")).distinct()
        pairs = pin(pairs.join(free("a"), ["bucket", "cls_a"], "left_semi").join(free("b"), ["bucket", "cls_b"], "left_semi"))

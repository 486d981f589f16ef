"""Exact similarity joins through rare-token prefixes, never through all pairs of a bucket."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import fresh, pin

EPS = 1e-9


def token_classes(rows: DataFrame, bucket: str, row_id: str, tokens: str) -> DataFrame:
    """Rows with their copy class: rows of one bucket with the same token set share it."""
    return rows.select(
        F.col(bucket).alias("bucket"),
        F.col(row_id).alias("row_id"),
        F.md5(F.array_join(F.array_sort(tokens), "\x1f")).alias("cls"),
        F.col(tokens).alias("tokens"),
    ).filter(F.size("tokens") > 0)


def jaccard_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Class pairs ``(bucket, cls_a, cls_b, score)`` of equal bucket with Jaccard >= ``threshold``.

    Both sides come from ``token_classes``. Copies are collapsed first. Tokens
    are ordered by rarity within the bucket; two sets that reach the threshold
    share a token within the first ``n - ceil(threshold * n) + 1`` of each, so
    only those prefixes are joined, and a pair counts at its first common token.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    sets = (
        left.withColumn("side", F.lit("a"))
        .unionByName(right.withColumn("side", F.lit("b")))
        .groupBy("side", "bucket", "cls")
        .agg(F.any_value("tokens").alias("tokens"))
    )
    tok = sets.select("side", "bucket", "cls", F.explode("tokens").alias("token"))
    spread = tok.groupBy("bucket", "token").agg(
        F.count(F.lit(1)).alias("df"), F.count_if(F.col("side") == "a").alias("df_a")
    )
    ranked = (
        tok.join(spread, ["bucket", "token"])
        .groupBy("side", "bucket", "cls")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token", "df_a"))).alias("t"))
        .select(
            "side",
            "bucket",
            "cls",
            F.size("t").alias("n"),
            F.transform("t", lambda s: s["token"]).alias("tokens"),
            F.slice(
                "t",
                F.lit(1),
                (F.size("t") - F.ceil(F.size("t") * threshold - EPS) + 1).cast("int"),
            ).alias("prefix"),
        )
        .withColumn("p", F.explode("prefix"))
        # a token that only one side has joins with nothing
        .filter((F.col("p.df_a") > 0) & (F.col("p.df_a") < F.col("p.df")))
        .select("side", "bucket", "cls", "n", "tokens", F.col("p.token").alias("token"))
    )
    a = ranked.filter("side = 'a'").select(
        "bucket", "token", F.col("cls").alias("cls_a"), F.col("n").alias("n_a"), F.col("tokens").alias("tok_a")
    )
    b = ranked.filter("side = 'b'").select(
        "bucket", "token", F.col("cls").alias("cls_b"), F.col("n").alias("n_b"), F.col("tokens").alias("tok_b")
    )
    fits = (F.col("n_b") >= F.col("n_a") * threshold - EPS) & (F.col("n_a") >= F.col("n_b") * threshold - EPS)
    common = F.array_intersect("tok_a", "tok_b")
    return (
        a.join(b, ["bucket", "token"])
        .filter(fits)
        .withColumn("common", common)
        .filter(F.get("common", F.lit(0)) == F.col("token"))
        .withColumn("score", F.size("common") / (F.col("n_a") + F.col("n_b") - F.size("common")))
        .filter(F.col("score") >= threshold)
        .select("bucket", "cls_a", "cls_b", "score")
    )


def term_suffixes(terms: DataFrame) -> DataFrame:
    """Terms ``(side, bucket, cls, term, tf, norm)`` with the norm share of the term and all commoner ones."""
    spread = terms.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    rest = (
        Window.partitionBy("side", "bucket", "cls")
        .orderBy(F.desc("df"), F.desc("term"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        terms.join(spread, ["bucket", "term"])
        .withColumn("suffix", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(rest)) / F.col("norm"))
        .drop("df")
    )


GRID = 32  # thresholds that a band may end at


def band_thresholds(suffixes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """``(bucket, threshold)``: how far down each bucket's next band may go with at most ``most`` candidate rows.

    ``above`` is ``(bucket, threshold)`` of the last band. A term of a class
    counts from the threshold on at which its prefix holds it; the candidates of
    a threshold are the products of both sides' counts, summed over the terms. A
    bucket that cannot take one more step within ``most`` is left out.
    """
    level = F.floor(F.col("suffix") * GRID).cast("int")
    counts = suffixes.groupBy("bucket", "term", level.alias("level")).agg(
        F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b")
    )
    # at most one row a level for each term, and for each bucket
    down = Window.partitionBy("bucket", "term").orderBy(F.desc("level"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("met", F.sum("n_a").over(upto) * F.sum("n_b").over(upto))
    counts = counts.withColumn("more", F.col("met") - F.coalesce(F.lag("met").over(down), F.lit(0)))
    levels = counts.groupBy("bucket", "level").agg(F.sum("more").alias("more"))
    down = Window.partitionBy("bucket").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = levels.withColumn("met", F.sum("more").over(down))
    # a level nobody has a row at costs what the next one up costs, so the band ends just above the first one that is too dear
    bars = levels.groupBy("bucket").agg(F.max(F.when(F.col("met") > most, F.col("level"))).alias("dear"))
    bars = bars.select("bucket", (F.coalesce(F.col("dear") + 1, F.lit(0)) / GRID).alias("threshold"))
    return bars.join(above.withColumnRenamed("threshold", "last"), "bucket").filter("threshold < last AND threshold <= 1").select("bucket", "threshold")


def cosine_pairs(suffixes: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """Class pairs of equal bucket with cosine >= ``threshold`` (> 0 when it is 0).

    If the terms beyond a class's prefix have norm below the threshold, a
    partner that shares none of the prefix cannot reach it. ``threshold`` is a
    number or a table ``(bucket, threshold)``.
    """
    if not isinstance(threshold, DataFrame):
        bars = suffixes.select("bucket").distinct().withColumn("threshold", F.lit(float(threshold)))
    else:
        bars = threshold
    suffixes = suffixes.join(bars, "bucket")
    prefix = suffixes.filter(F.col("suffix") >= F.col("threshold") - EPS)
    pick = lambda d, side: d.filter(F.col("side") == side)
    cand = (
        pick(prefix, "a").select("bucket", "term", F.col("cls").alias("cls_a"))
        .join(pick(prefix, "b").select("bucket", "term", F.col("cls").alias("cls_b")), ["bucket", "term"])
        .select("bucket", "cls_a", "cls_b")
        .distinct()
    )
    va = pick(suffixes, "a").select(
        "bucket", F.col("cls").alias("cls_a"), "term", F.col("tf").alias("tf_a"), F.col("norm").alias("norm_a"), "threshold"
    )
    vb = pick(suffixes, "b").select(
        "bucket", F.col("cls").alias("cls_b"), "term", F.col("tf").alias("tf_b"), F.col("norm").alias("norm_b")
    )
    dots = (
        cand.join(va, ["bucket", "cls_a"])
        .join(vb, ["bucket", "cls_b", "term"])
        .groupBy("bucket", "cls_a", "cls_b")
        .agg(
            F.sum(F.col("tf_a") * F.col("tf_b")).alias("dot"),
            F.max("norm_a").alias("norm_a"),
            F.max("norm_b").alias("norm_b"),
            F.max("threshold").alias("threshold"),
        )
    )
    scored = dots.withColumn("score", F.col("dot") / (F.col("norm_a") * F.col("norm_b")))
    scored = scored.filter((F.col("score") >= F.col("threshold")) & (F.col("score") > 0))
    return scored.select("bucket", "cls_a", "cls_b", "score")


KERNEL_TERMS = 1 << 20  # term rows of a block of classes


def best_partners(terms: DataFrame, heads: DataFrame, block_terms: int = KERNEL_TERMS) -> DataFrame:
    """Class pairs that hold the two best partners of every class of either side by cosine, above 0.

    ``terms`` is ``(side, bucket, cls, term, tf, norm)``, ``heads`` is ``(side,
    bucket, cls, head)``; of equal scores the partner with the smaller head is
    better. The classes of a side are dealt to blocks of about ``block_terms``
    term rows; every left block meets every right block of its bucket in a task
    of its own, which sends two rows for each of its classes. Comparisons grow
    with the product of the sides, rows with the classes times the blocks.
    """
    sizes = terms.groupBy("side", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block_terms).cast("int"))
    other = sizes.select(F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), "bucket", F.col("blocks").alias("opposite"))
    rows = terms.join(sizes.drop("n"), ["side", "bucket"]).join(other, ["side", "bucket"]).join(heads, ["side", "bucket", "cls"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("opposite") - 1)))
    mine = lambda s, i, j: rows.filter(F.col("side") == s).select("bucket", F.col(i).alias("i"), F.col(j).alias("j"), "cls", "head", "term", "tf", "norm")
    found = (
        mine("a", "own", "met").groupBy("bucket", "i", "j")
        .cogroup(fresh(mine("b", "met", "own")).groupBy("bucket", "i", "j"))
        .applyInPandas(_two_best, "bucket string, cls_a string, cls_b string, score double, head_a long, head_b long")
    )

    def best(cls: str, partner: str) -> DataFrame:
        w = Window.partitionBy("bucket", cls).orderBy(F.desc("score"), partner)
        return found.withColumn("at", F.row_number().over(w)).filter("at <= 2").select("bucket", "cls_a", "cls_b", "score")

    found = pin(found.distinct())
    return best("cls_a", "head_b").union(best("cls_b", "head_a")).distinct()


def _two_best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """For every class of either side its two best partners in the other block."""
    names = ["bucket", "cls_a", "cls_b", "score", "head_a", "head_b"]
    if not len(a) or not len(b):
        return pd.DataFrame(columns=names)
    codes, terms = pd.factorize(np.concatenate([a["term"].to_numpy(object), b["term"].to_numpy(object)]))
    code_a, code_b = codes[: len(a)], codes[len(a):]
    tf_a, tf_b = a["tf"].to_numpy(float), b["tf"].to_numpy(float)

    def classes(df: pd.DataFrame):
        """Classes in the order of their heads, and the class of each row."""
        firsts = df.drop_duplicates("cls").sort_values("head")
        place = pd.Series(np.arange(len(firsts)), index=firsts["cls"].to_numpy(object))
        return firsts, place[df["cls"].to_numpy(object)].to_numpy()

    first_a, doc_a = classes(a)
    first_b, doc_b = classes(b)
    norm_a, norm_b = first_a["norm"].to_numpy(float), first_b["norm"].to_numpy(float)
    order = np.argsort(doc_a, kind="stable")
    cuts = np.searchsorted(doc_a[order], np.arange(len(first_a) + 1))
    weight = np.zeros(len(terms))
    n_b = len(first_b)
    top = np.full((2, n_b), -1.0)
    who = np.full((2, n_b), -1)
    pairs: dict[tuple[int, int], float] = {}
    for i in range(len(first_a)):
        mine = order[cuts[i] : cuts[i + 1]]
        weight[code_a[mine]] = tf_a[mine]
        score = np.bincount(doc_b, weights=weight[code_b] * tf_b, minlength=n_b) / (norm_a[i] * norm_b)
        weight[code_a[mine]] = 0
        one = int(score.argmax())
        if score[one] > 0:
            pairs[i, one] = float(score[one])
            rest = score.copy()
            rest[one] = 0
            two = int(rest.argmax())
            if rest[two] > 0:
                pairs[i, two] = float(rest[two])
        # strictly better only: classes come in the order of their heads
        first = score > top[0]
        top[1], who[1] = np.where(first, top[0], top[1]), np.where(first, who[0], who[1])
        second = ~first & (score > top[1])
        top[0], who[0] = np.where(first, score, top[0]), np.where(first, i, who[0])
        top[1], who[1] = np.where(second, score, top[1]), np.where(second, i, who[1])
    for rank in (0, 1):
        for j in np.flatnonzero(top[rank] > 0):
            pairs[int(who[rank, j]), int(j)] = float(top[rank, j])
    at_a, at_b = np.array([i for i, _ in pairs], dtype=int), np.array([j for _, j in pairs], dtype=int)
    return pd.DataFrame({
        "bucket": key[0], "cls_a": first_a["cls"].to_numpy(object)[at_a], "cls_b": first_b["cls"].to_numpy(object)[at_b], "score": list(pairs.values()),
        "head_a": first_a["head"].to_numpy()[at_a], "head_b": first_b["head"].to_numpy()[at_b],
    }, columns=names)

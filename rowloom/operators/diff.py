"""Keyless comparison of tables: rows, then cells.

A table is a set of rows ``(pair_id, row_idx, cells)``; ``row_idx`` counts from
0 in file order. Pairs of tables are compared all at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import text
from rowloom.plans.matching import greedy_match
from rowloom.plans.ranking import number_rows, running_max, top_rows
from rowloom.plans.rising import longest_rising
from rowloom.plans.similarity import jaccard_pairs, token_classes
from rowloom.session import pin, small_side

ROW_BLOCK = 100_000


def table_rows(
    df: DataFrame, columns: Sequence[str], pair: Column | None = None, row_idx: str | None = None,
    order: Sequence[str] = (), block: Column | None = None,
) -> DataFrame:
    """Row form of a wide table; rows are numbered by ``order`` unless ``row_idx`` is given.

    ``block`` is passed to ``number_rows``.
    """
    pair = F.lit("table") if pair is None else pair
    df = df.withColumn("pair_id", pair.cast("string"))
    if row_idx is None:
        df = number_rows(df, ["pair_id"], list(order), number="__rn", block=block).withColumn("__idx", F.col("__rn") - 1)
        row_idx = "__idx"
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.select("pair_id", F.col(row_idx).cast("long").alias("row_idx"), cells.alias("cells"))


def normalised(rows: DataFrame, ignore_case: bool = False, trim_ws: bool = True) -> DataFrame:
    """Add normalised cells and the row hash."""
    norm = F.transform("cells", lambda c: text.norm_cell(c, ignore_case, trim_ws))
    return rows.withColumn("norm", norm).withColumn("hash", F.sha1(F.array_join("norm", "\x1f")))


def row_hash(cells: Column, ignore_case: bool = False, trim_ws: bool = True) -> Column:
    return F.sha1(F.array_join(F.transform(cells, lambda c: text.norm_cell(c, ignore_case, trim_ws)), "\x1f"))


def diff_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pair_id, side, row_idx, block, equal, moved`` of every row of both sides, for tables of any size.

    The k-th row of a hash on one side is equal to the k-th on the other. The
    largest set of such pairs that rises on both sides are the anchors; the
    other pairs are equal rows that moved. The rows between two anchors form a
    block; where equal rows keep their order no row has moved and the blocks are
    those of an ordered diff.
    """
    tag = lambda df, s: df.select("pair_id", F.lit(s).alias("side"), "row_idx", F.unhex("hash").alias("hash"))
    return _blocks(pin(tag(a, "a").unionByName(tag(b, "b"))))


def _anchors(pairs: DataFrame) -> DataFrame:
    """``(pair_id, row_a, row_b)`` of equal rows with ``moved``; only tables whose rows cross each other need the longest rising run."""
    seen = running_max(pairs, ["pair_id"], "row_a", "row_b", "upto", F.expr(f"row_a div {ROW_BLOCK}"))
    crossed = pin(seen.filter(F.col("upto") > F.col("row_b")).select("pair_id").distinct())
    if crossed.isEmpty():
        return pairs.withColumn("moved", F.lit(False))
    rising = longest_rising(pairs.join(crossed, "pair_id", "left_semi"), "pair_id", "row_a", "row_b", block=ROW_BLOCK)
    rest = pairs.join(crossed, "pair_id", "left_anti").withColumn("moved", F.lit(False))
    return rest.unionByName(rising.select("pair_id", "row_a", "row_b", (~F.col("rises")).alias("moved")))


def _blocks(hashes: DataFrame) -> DataFrame:
    place = F.expr(f"row_idx div {ROW_BLOCK}")
    at = lambda s: F.when(F.col("side") == s, F.col("row_idx"))
    shared = (
        hashes.filter("pair_id IS NOT NULL AND hash IS NOT NULL").groupBy("pair_id", "hash")
        .agg(
            F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"),
            F.max(at("a")).alias("row_a"), F.max(at("b")).alias("row_b"),
        )
        .filter("n_a > 0 AND n_b > 0")
    )
    # a row that occurs once a side is paired as it is counted, and its hash not needed again; copies are told apart by their number
    once = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    shared = pin(shared.select("pair_id", F.when(~once, F.col("hash")).alias("hash"), "row_a", "row_b"))
    pairs = shared.filter("hash IS NULL").select("pair_id", "row_a", "row_b")
    several = shared.filter("hash IS NOT NULL").select("pair_id", "hash")
    if not several.isEmpty():
        copies = pin(hashes.join(small_side(several), ["pair_id", "hash"]))
        copies = number_rows(copies, ["pair_id", "side", "hash"], ["row_idx"], number="k", block=place)
        side = lambda s, name: copies.filter(F.col("side") == s).select("pair_id", "hash", "k", F.col("row_idx").alias(name))
        pairs = pin(pairs.unionByName(side("a", "row_a").join(side("b", "row_b"), ["pair_id", "hash", "k"]).select("pair_id", "row_a", "row_b")))
    anchors = _anchors(pairs)
    marks = anchors.select("pair_id", F.lit("a").alias("side"), F.col("row_a").alias("row_idx"), "moved").unionByName(
        anchors.select("pair_id", F.lit("b").alias("side"), F.col("row_b").alias("row_idx"), "moved")
    )
    marked = hashes.select("pair_id", "side", "row_idx").join(marks, ["pair_id", "side", "row_idx"], "left")
    marked = pin(
        marked.select(
            "pair_id", "side", "row_idx", F.col("moved").isNotNull().alias("equal"), F.coalesce("moved", F.lit(False)).alias("moved")
        )
    )
    rises = (F.col("equal") & ~F.col("moved")).cast("long")
    placed = number_rows(marked, ["pair_id", "side"], ["row_idx"], number=None, sums={"block": rises}, block=place)
    return placed.select("pair_id", "side", "row_idx", F.col("block").cast("long").alias("block"), "equal", "moved")


def pair_positional(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pair the k-th left with the k-th right row of a block."""
    def ordinal(df: DataFrame, name: str) -> DataFrame:
        return number_rows(
            df.select("pair_id", "block", "row_idx"), ["pair_id", "block"], ["row_idx"], number="k",
            block=F.expr(f"row_idx div {ROW_BLOCK}"),
        ).withColumnRenamed("row_idx", name)

    return ordinal(a, "row_a").join(ordinal(b, "row_b"), ["pair_id", "block", "k"]).select("pair_id", "row_a", "row_b")


def pair_similar(a: DataFrame, b: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Greedy one-to-one pairs of a block by Jaccard of row tokens, from ``threshold`` up."""
    def classes(df: DataFrame) -> DataFrame:
        return token_classes(
            df.select(
                F.concat_ws("\x1f", F.col("block").cast("string"), "pair_id").alias("bk"),
                "row_idx",
                text.token_set(F.array_join("norm", "\x1f")).alias("toks"),
            ),
            "bk", "row_idx", "toks",
        )

    ca, cb = classes(a), classes(b)
    found = greedy_match(jaccard_pairs(ca, cb, threshold), ca, cb)
    return found.select(
        F.substring_index("bucket", "\x1f", -1).alias("pair_id"), F.col("id_a").alias("row_a"), F.col("id_b").alias("row_b"), "score"
    )


def changed_cells(a: Column, b: Column) -> Column:
    """``array<struct<i, old, new>>`` of the positions whose normalised cells differ."""
    last = F.greatest(F.size(a), F.size(b)) - 1
    cells = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("i"), F.coalesce(F.get(a, i), F.lit("")).alias("old"), F.coalesce(F.get(b, i), F.lit("")).alias("new")
        ),
    )
    return F.when(last < 0, F.array().cast("array<struct<i:int,old:string,new:string>>")).otherwise(
        F.filter(cells, lambda s: s["old"] != s["new"])
    )


def _full_width(norm: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(i, F.coalesce(F.get(norm, i), F.lit(""))))


def diff(
    a: DataFrame,
    b: DataFrame,
    similarity_pairing: bool = True,
    threshold: float = 0.65,
    ignore_case: bool = False,
    trim_ws: bool = True,
    width: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Row deltas and per-pair counts of two row tables.

    Returns ``deltas(pair_id, kind, row_a, row_b, changed_cols, old_vals,
    new_vals)`` and ``stats(pair_id, equal, modified, removed, added,
    pad_only)``. ``pad_only`` counts rows that pair up but differ only in how
    many empty cells close them. Unequal rows pair up within their block; in a
    pair of tables with moved rows, what is left over by similarity pairing is
    paired once more over the whole tables.
    """
    tag = lambda df, s: normalised(df, ignore_case, trim_ws).select("pair_id", F.lit(s).alias("side"), "row_idx", "norm", F.unhex("hash").alias("hash"))
    both = pin(tag(a, "a").unionByName(tag(b, "b")))
    blocks = pin(_blocks(both.select("pair_id", "side", "row_idx", "hash")))
    open_rows = pin(both.drop("hash").join(blocks.filter(~F.col("equal")).drop("equal", "moved"), ["pair_id", "side", "row_idx"]))
    la, lb = (open_rows.filter(F.col("side") == s).drop("side") for s in ("a", "b"))
    pairs = pair_similar(la, lb, threshold).drop("score") if similarity_pairing else pair_positional(la, lb)
    pairs = pin(pairs)
    moved = blocks.filter("moved").select("pair_id").distinct()
    if similarity_pairing and moved.limit(1).count():
        free = lambda df, mine: (
            df.join(moved, "pair_id", "left_semi")
            .join(pairs.select("pair_id", F.col(mine).alias("row_idx")), ["pair_id", "row_idx"], "left_anti")
            .withColumn("block", F.lit(-1).cast("long"))
        )
        pairs = pin(pairs.unionByName(pair_similar(free(la, "row_a"), free(lb, "row_b"), threshold).drop("score")))

    if width is None:
        w = both.groupBy("pair_id").agg(F.max(F.size("norm")).alias("width"))
        widen = lambda df: df.join(w, "pair_id")
    else:
        widen = lambda df: df.withColumn("width", F.lit(width))

    both = (
        pairs.join(la.select("pair_id", F.col("row_idx").alias("row_a"), F.col("norm").alias("norm_a")), ["pair_id", "row_a"])
        .join(lb.select("pair_id", F.col("row_idx").alias("row_b"), F.col("norm").alias("norm_b")), ["pair_id", "row_b"])
        .withColumn("ch", changed_cells(F.col("norm_a"), F.col("norm_b")))
    )
    modified = both.select(
        "pair_id",
        F.when(F.size("ch") > 0, "MODIFIED").otherwise("PAD_ONLY").alias("kind"),
        "row_a",
        "row_b",
        F.col("ch.i").alias("changed_cols"),
        F.map_from_entries(F.transform("ch", lambda s: F.struct(s["i"], s["old"]))).alias("old_vals"),
        F.map_from_entries(F.transform("ch", lambda s: F.struct(s["i"], s["new"]))).alias("new_vals"),
    )
    nothing = F.create_map().cast("map<int,string>")

    def lone(df: DataFrame, mine: str, kind: str) -> DataFrame:
        free = df.withColumnRenamed("row_idx", mine).join(pairs.select("pair_id", mine), ["pair_id", mine], "left_anti")
        full = F.map_from_entries(_full_width(F.col("norm"), F.col("width")))
        removed = kind == "REMOVED"
        return widen(free).select(
            "pair_id",
            F.lit(kind).alias("kind"),
            (F.col(mine) if removed else F.lit(None).cast("long")).alias("row_a"),
            (F.lit(None).cast("long") if removed else F.col(mine)).alias("row_b"),
            F.sequence(F.lit(0), F.col("width") - 1).alias("changed_cols"),
            (full if removed else nothing).alias("old_vals"),
            (nothing if removed else full).alias("new_vals"),
        )

    every = modified.unionByName(lone(la, "row_a", "REMOVED")).unionByName(lone(lb, "row_b", "ADDED"))
    every = pin(every)
    n = lambda k: F.count_if(F.col("kind") == k)
    kinds = every.select("pair_id", "kind").unionByName(
        blocks.filter("equal and side = 'a'").select("pair_id", F.lit("EQUAL").alias("kind"))
    )
    stats = kinds.groupBy("pair_id").agg(
        n("EQUAL").alias("equal"),
        n("MODIFIED").alias("modified"),
        n("REMOVED").alias("removed"),
        n("ADDED").alias("added"),
        n("PAD_ONLY").alias("pad_only"),
    )
    return every.filter("kind <> 'PAD_ONLY'"), stats


def first_deltas(deltas: DataFrame, n: int = 5000) -> DataFrame:
    """The first ``n`` deltas of every pair, with ``truncated`` where there are more."""
    at = F.coalesce("row_a", "row_b")
    kept = top_rows(deltas, ["pair_id"], [at.asc(), F.col("row_a").isNull().asc(), F.col("row_b").asc()], n)
    more = deltas.groupBy("pair_id").agg((F.count(F.lit(1)) > n).alias("truncated"))
    return kept.join(more, "pair_id")


def side_frames(deltas: DataFrame, a: DataFrame, b: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The deltas of each side with the whole source row spread over ``columns``."""
    def frame(rows: DataFrame, mine: str, kinds: tuple[str, str]) -> DataFrame:
        src = rows.select("pair_id", F.col("row_idx").alias(mine), "cells")
        return (
            deltas.filter(F.col("kind").isin(*kinds))
            .join(src, ["pair_id", mine])
            .select(
                "pair_id", "kind", "row_a", "row_b", "changed_cols",
                *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)],
            )
        )

    return frame(a, "row_a", ("MODIFIED", "REMOVED")), frame(b, "row_b", ("MODIFIED", "ADDED"))


def one_sided(rows: DataFrame, side: str, columns: Sequence[str]) -> DataFrame:
    """Every row of a table that only one side has, as ADDED or REMOVED."""
    kind, mine, other = ("REMOVED", "row_a", "row_b") if side == "a" else ("ADDED", "row_b", "row_a")
    return rows.select(
        "pair_id",
        F.lit(kind).alias("kind"),
        F.col("row_idx").alias(mine),
        F.lit(None).cast("long").alias(other),
        *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)],
    )


def cell_changes(deltas: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long report: one line per changed cell with its column name, old and new value."""
    names = F.array(*[F.lit(c) for c in columns])
    return deltas.select("pair_id", "kind", "row_a", "row_b", "old_vals", "new_vals", F.explode("changed_cols").alias("i")).select(
        "pair_id",
        "kind",
        "row_a",
        "row_b",
        F.coalesce(F.get(names, F.col("i")), F.concat(F.lit("COL_"), F.col("i"))).alias("column"),
        F.try_element_at("old_vals", F.col("i")).alias("old_value"),
        F.try_element_at("new_vals", F.col("i")).alias("new_value"),
    )

"""The longest rising run of points, for keys of any size.

Of points ``(key, x, y)`` with distinct ``x`` and distinct ``y`` within a key,
the largest set that rises in both. Three steps, none of which has to see a
whole key:

* Neighbours in ``x`` that are neighbours in ``y`` too form a run. Whatever lies
  outside a run compares alike with all of it, so a run is taken whole or not at
  all, and a table in which a few blocks moved is a handful of weighted runs.
* The runs of a key are cut into blocks along ``x`` and strips along ``y`` of at
  most ``CELL`` runs each. A cell, block times strip, needs the runs before it in
  its block, those before it in its strip, and the best of all cells below it on
  both axes: the weights of the rising sets that end there. Cells on one diagonal
  do not depend on each other and are worked out at the same time, each with a
  staircase of pile tops. A key with at most ``CELL`` runs is one cell.
* From the heaviest end the chain is walked back cell by cell.

Of equal weights the set whose last run comes first is taken.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.plans.ranking import number_rows
from rowloom.session import fresh, pin

CELL = 1 << 17
BLOCK = 100_000

_DONE = "key string, i long, j long, a long, b long, f long, pred long, pi long, pj long"
_WALK = "key string, b long, pred long, i long, j long"


def longest_rising(points: DataFrame, key: str, x: str, y: str, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``points`` reduced to ``key, x, y`` with ``rises``: whether the point is in the largest rising set of its key.

    ``x`` and ``y`` are row positions; blocks of ``block`` of them are sorted at once.
    """
    pts = points.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"))
    pts = number_rows(pts, ["key"], ["y"], number="at", block=F.expr(f"y div {block}")).withColumn("blk", F.expr(f"x div {block}"))
    along = Window.partitionBy("key", "blk").orderBy("x")
    pts = pts.withColumn("opens", F.coalesce((F.col("at") != F.lag("at").over(along) + 1).cast("long"), F.lit(1).cast("long")))
    pts = pin(pts.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    runs = pin(pts.groupBy("key", "blk", "run").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.count(F.lit(1)).alias("w")))
    kept = heaviest_chain(runs.select("key", "a", "b", "w"), cell, block)
    kept = runs.join(kept, ["key", "b"]).select("key", "blk", "run", F.lit(True).alias("rises"))
    out = pts.join(kept, ["key", "blk", "run"], "left")
    return out.select(F.col("key").alias(key), F.col("x").alias(x), F.col("y").alias(y), F.coalesce("rises", F.lit(False)).alias("rises"))


def heaviest_chain(items: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``(key, b)`` of the items ``(key, a, b, w)`` of each key that rise in ``a`` and ``b`` and weigh most together.

    ``items`` are cheap to read again; ``a`` and ``b`` are distinct within a key.
    """
    most = items.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    side = -(-most // cell)
    if side > 1:
        for axis, name in (("a", "i"), ("b", "j")):
            items = number_rows(items, ["key"], [axis], number="n", block=F.expr(f"{axis} div {block}"))
            items = items.withColumn(name, F.expr(f"(n - 1) div {cell}")).drop("n")
        items = pin(items)
    else:
        items = items.withColumn("i", F.lit(0).cast("long")).withColumn("j", F.lit(0).cast("long"))
    done = tops = corner = None
    for diagonal in range(max(1, 2 * side - 1)):
        now = items.filter(F.col("i") + F.col("j") == diagonal)
        if done is None:
            before = items.sparkSession.createDataFrame([], "key string, i long, j long, kind string, at long, f long, b long, pi long, pj long")
        else:
            corner = _corner(corner, tops, diagonal, side)
            before = _before(done, corner, diagonal)
        found = now.groupBy("key", "i", "j").cogroup(fresh(before).groupBy("key", "i", "j")).applyInPandas(_cell, _DONE)
        found = pin(found)
        done = found if done is None else done.unionByName(found)
        if side > 1:
            new = found.groupBy("key", "i", "j").agg(F.max(_order()).alias("m")).select("key", "i", "j", "m.f", "m.b", (-F.col("m.back")).alias("a"))
            tops = pin(new if tops is None else tops.unionByName(new))
    ends = done.groupBy("key").agg(F.max(F.struct("f", (-F.col("a")).alias("back"), "b", "i", "j")).alias("m"))
    at = ends.select("key", "m.i", "m.j", F.col("m.b").alias("goal"))
    kept = None
    while True:
        met = done.join(fresh(at), ["key", "i", "j"]).select("key", "i", "j", "b", "pred", "pi", "pj", "goal")
        walked = met.groupBy("key").applyInPandas(_walk, _WALK)
        if side <= 1:
            return walked.select("key", "b")
        walked = pin(walked)
        kept = walked.select("key", "b") if kept is None else kept.unionByName(walked.select("key", "b"))
        at = walked.filter("pred >= 0").select("key", "i", "j", F.col("pred").alias("goal"))
        if at.isEmpty():
            return kept


def _order():
    """Heavier first, then the end that comes first."""
    return F.struct("f", (-F.col("a")).alias("back"), "b")


def _corner(corner: DataFrame | None, tops: DataFrame, diagonal: int, side: int) -> DataFrame:
    """The best item of all cells below each cell of a diagonal on both axes, from the diagonals before."""
    cols = ["key", "i", "j", "f", "b", "a", "pi", "pj"]
    parts = [
        tops.filter(F.col("i") + F.col("j") == diagonal - 2)
        .select("key", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "f", "b", "a", F.col("i").alias("pi"), F.col("j").alias("pj"))
    ]
    if corner is not None:
        parts += [corner.withColumn("i", F.col("i") + 1).select(*cols), corner.withColumn("j", F.col("j") + 1).select(*cols)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.filter((F.col("i") < side) & (F.col("j") < side))
    best = every.groupBy("key", "i", "j").agg(F.max(F.struct("f", (-F.col("a")).alias("back"), "b", "pi", "pj")).alias("m"))
    return pin(best.select("key", "i", "j", "m.f", "m.b", (-F.col("m.back")).alias("a"), "m.pi", "m.pj"))


def _before(done: DataFrame, corner: DataFrame, diagonal: int) -> DataFrame:
    """What every cell of a diagonal has to know: earlier items of its strip and of its block, and its corner."""
    one = lambda i, j, kind, at: done.select(
        "key", i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), F.col(at).alias("at"), "f", "b", F.col("i").alias("pi"), F.col("j").alias("pj")
    )
    strip = one(F.lit(diagonal) - F.col("j"), F.col("j"), "strip", "b")
    block = one(F.col("i"), F.lit(diagonal) - F.col("i"), "block", "a")
    low = corner.select("key", "i", "j", F.lit("corner").alias("kind"), F.lit(-1).cast("long").alias("at"), "f", "b", "pi", "pj")
    every = strip.unionByName(block).unionByName(low)
    return every.select("key", F.col("i").cast("long"), F.col("j").cast("long"), "kind", "at", "f", "b", "pi", "pj")


def _cell(key: tuple, items: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """Weight and predecessor of the heaviest rising set that ends at each item of a cell."""
    items = items.sort_values("a")
    a, b, w = (items[c].to_numpy(np.int64) for c in ("a", "b", "w"))
    f, pred = np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64)
    pi, pj = np.full(len(a), -1, np.int64), np.full(len(a), -1, np.int64)
    for kind, place in (("corner", a), ("strip", b), ("block", a)):
        rows = before[before["kind"] == kind].sort_values("at")
        if not len(rows):
            continue
        weights = rows["f"].to_numpy(np.int64)
        best = np.maximum.accumulate(weights)
        first = np.maximum.accumulate(np.where(np.diff(best, prepend=0) > 0, np.arange(len(best)), 0))
        at = np.searchsorted(rows["at"].to_numpy(np.int64), place) - 1
        better = (at >= 0) & (best[at] > f)
        src = first[at[better]]
        f[better] = best[at[better]]
        pred[better], pi[better], pj[better] = (rows[c].to_numpy(np.int64)[src] for c in ("b", "pi", "pj"))
    # pile tops: ends in rising order of y with rising weights
    tops: list[int] = []
    weights_: list[int] = []
    ends: list[int] = []
    own = np.full(len(a), -1, np.int64)
    out = f.tolist()
    for t, (y, weight) in enumerate(zip(b.tolist(), w.tolist())):
        k = bisect_left(tops, y)
        if k and weights_[k - 1] > out[t]:
            out[t] = weights_[k - 1]
            own[t] = ends[k - 1]
        total = out[t] = out[t] + weight
        stop = k
        while stop < len(tops) and weights_[stop] <= total:
            stop += 1
        if k and weights_[k - 1] >= total:
            continue
        tops[k:stop], weights_[k:stop], ends[k:stop] = [y], [total], [t]
    mine = own >= 0
    pred[mine] = b[own[mine]]
    pi[mine], pj[mine] = key[1], key[2]
    return pd.DataFrame({"key": key[0], "i": key[1], "j": key[2], "a": a, "b": b, "f": out, "pred": pred, "pi": pi, "pj": pj})


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The items of a cell on the way back from a goal, the last one with the cell it leads to."""
    i, j, at = int(rows["i"].iloc[0]), int(rows["j"].iloc[0]), int(rows["goal"].iloc[0])
    by = dict(zip(rows["b"].tolist(), zip(rows["pred"].tolist(), rows["pi"].tolist(), rows["pj"].tolist())))
    seen, leaves = [], (-1, -1, -1)
    while at >= 0:
        seen.append(at)
        pred, pi, pj = by[at]
        if (pi, pj) != (i, j):
            leaves = (pred, pi, pj)
            break
        at = pred
    n = len(seen) - 1
    return pd.DataFrame({"key": key[0], "b": seen, "pred": [-1] * n + [leaves[0]], "i": [-1] * n + [leaves[1]], "j": [-1] * n + [leaves[2]]})

"""The longest rising run against a plain quadratic search."""

import random
from bisect import bisect_left

import pytest

from rowloom.plans import rising


def length(ys):
    tops = []
    for y in ys:
        k = bisect_left(tops, y)
        tops[k : k + 1] = [y]
    return len(tops)


def check(spark, tables, cell, block=7):
    rows = [(k, x, y) for k, ys in tables.items() for x, y in enumerate(ys)]
    got = rising.longest_rising(spark.createDataFrame(rows, "pair string, x long, y long"), "pair", "x", "y", cell, block).collect()
    assert len(got) == len(rows)
    for k, ys in tables.items():
        kept = [r.y for r in sorted((r for r in got if r.pair == k), key=lambda r: r.x) if r.rises]
        assert all(a < b for a, b in zip(kept, kept[1:]))
        assert len(kept) == length(ys), k
    return got


@pytest.mark.parametrize("cell", [13, 1 << 17])
def test_as_long_as_the_longest(spark, cell):
    """One cell and grids of many give sets of the same size, keys of different sizes side by side."""
    rng = random.Random(cell)
    shuffled = lambda n: rng.sample(range(n), n)
    tables = {"mixed": shuffled(60), "falling": list(range(20, 0, -1)), "rising": list(range(40)), "one": [5], "two": [9, 3]}
    blocks = [list(range(i, i + 6)) for i in range(0, 60, 6)]
    rng.shuffle(blocks)
    tables["blocks"] = [y for b in blocks for y in b]
    check(spark, tables, cell)


@pytest.mark.parametrize("cell", [10, 1 << 17])
def test_moved_head_tail_and_halves(spark, cell):
    n = 30
    tables = {"head": [*range(1, n), 0], "tail": [n - 1, *range(n - 1)], "halves": [*range(n // 2, n), *range(n // 2)]}
    tables = {k: [ys.index(i) for i in range(n)] for k, ys in tables.items()}
    got = check(spark, tables, cell)
    moved = {k: [r.x for r in sorted(got, key=lambda r: r.x) if r.pair == k and not r.rises] for k in tables}
    assert moved["head"] == [0] and moved["tail"] == [n - 1]
    assert moved["halves"] == list(range(n // 2, n)), "of equal halves the first stays"


def test_no_points(spark):
    df = spark.createDataFrame([], "pair string, x long, y long")
    assert rising.longest_rising(df, "pair", "x", "y").count() == 0

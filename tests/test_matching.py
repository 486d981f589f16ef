"""One-to-one matching against brute force, on the settled-at-once and the round-by-round way."""

import random

import pytest

from rowloom.plans import matching
from rowloom.plans.matching import greedy_match
from rowloom.plans.similarity import jaccard_pairs, token_classes


def make(n, seed, copies):
    r = random.Random(seed)
    rows = [(f"b{r.randint(0, 3)}", i, sorted({r.choice("abcdefgh") for _ in range(r.randint(1, 7))})) for i in range(n)]
    return rows + [("b0", n + i, ["a", "b", "c", "d"]) for i in range(copies)]


def brute(a, b, threshold):
    out = []
    for bucket in {r[0] for r in a}:
        pairs = []
        for _, i, x in (r for r in a if r[0] == bucket):
            for _, j, y in (r for r in b if r[0] == bucket):
                s = len(set(x) & set(y)) / len(set(x) | set(y))
                if s >= threshold:
                    pairs.append((-s, i, j))
        used_a, used_b = set(), set()
        for s, i, j in sorted(pairs):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((bucket, i, j, -s))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 60])
@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_greedy_equals_brute_force(spark, limit, threshold):
    a, b = make(90, 1, 40), make(110, 2, 25)
    schema = "b string, i long, t array<string>"
    ca, cb = (token_classes(spark.createDataFrame(x, schema), "b", "i", "t") for x in (a, b))
    got = greedy_match(jaccard_pairs(ca, cb, threshold), ca, cb, limit=limit)
    assert sorted(map(tuple, got.collect())) == brute(a, b, threshold)


def scored(spark, pairs, rows_a, rows_b):
    """Class pairs with given scores, and rows of the classes."""
    p = spark.createDataFrame([("b", x, y, s) for x, y, s in pairs], "bucket string, cls_a string, cls_b string, score double")
    ca, cb = (spark.createDataFrame([("b", c, i) for c, i in r], "bucket string, cls string, row_id long") for r in (rows_a, rows_b))
    score = {(x, y): s for x, y, s in pairs}
    every = sorted((-score[x, y], i, j) for x, i in rows_a for y, j in rows_b if (x, y) in score)
    used_a, used_b, want = set(), set(), []
    for s, i, j in every:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.append((i, j, -s))
    return p, ca, cb, sorted(want)


def test_levels_tied_all_with_all_take_one_round(spark, monkeypatch):
    """Many classes at one score settle k-th with k-th in a single round."""
    r = random.Random(3)
    n = 120
    ids = r.sample(range(1000), 3 * n)
    rows_a = [(f"x{i % n}", ids[i]) for i in range(n + 40)]
    rows_b = [(f"y{i % n}", ids[-1 - i]) for i in range(n + 7)]
    p, ca, cb, want = scored(spark, [(f"x{i}", f"y{j}", 0.75) for i in range(n) for j in range(n)], rows_a, rows_b)
    rounds, inner = [], matching.one_round
    monkeypatch.setattr(matching, "one_round", lambda *a, **k: rounds.append(1) or inner(*a, **k))
    got = greedy_match(p, ca, cb, limit=50)
    assert sorted((x.id_a, x.id_b, x.score) for x in got.collect()) == want
    assert len(rounds) <= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_ties_equal_brute_force(spark, seed):
    """Ties all with all, partial ties, copies, and partners that others want more, round by round."""
    r = random.Random(seed)
    xs, ys = [f"x{i}" for i in range(9)], [f"y{i}" for i in range(8)]
    pairs = [(x, y, r.choice([0.7, 0.8, 0.8, 0.9])) for x in xs for y in ys if r.random() < 0.6]
    ids = r.sample(range(100), 60)
    rows_a, rows_b = [(r.choice(xs), i) for i in ids[:30]], [(r.choice(ys), i) for i in ids[30:]]
    p, ca, cb, want = scored(spark, pairs, rows_a, rows_b)
    got = greedy_match(p, ca, cb, limit=8)
    assert sorted((x.id_a, x.id_b, x.score) for x in got.collect()) == want


def test_prefix_join_finds_every_pair(spark):
    a, b = make(60, 5, 0), make(60, 6, 0)
    schema = "b string, i long, t array<string>"
    ca, cb = (token_classes(spark.createDataFrame(x, schema), "b", "i", "t") for x in (a, b))
    got = {tuple(r) for r in jaccard_pairs(ca, cb, 0.4).collect()}
    names = {}
    for side, frame in (("a", ca), ("b", cb)):
        for r in frame.collect():
            names[side, r.row_id] = r.cls
    want = set()
    for g, i, x in a:
        for h, j, y in b:
            s = len(set(x) & set(y)) / len(set(x) | set(y))
            if g == h and s >= 0.4:
                want.add((g, names["a", i], names["b", j], s))
    assert got == want

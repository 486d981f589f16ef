"""Keyless diff: hand cases, difflib itself, and properties."""

import bisect
import difflib
import random


from rowloom.operators import diff

SCHEMA = "pair_id string, row_idx long, cells array<string>"


def rows(spark, tables):
    return spark.createDataFrame([(p, i, c) for p, t in tables.items() for i, c in enumerate(t)], SCHEMA)


def counts(spark, a, b, **kw):
    s = diff.diff(rows(spark, {"p": a}), rows(spark, {"p": b}), **kw)[1].collect()[0]
    return s.equal, s.modified, s.removed, s.added, s.pad_only


def test_known_cases(spark):
    people = [["John", "25", "NYC"], ["Jane", "25", "LA"], ["Bob", "30", "Chicago"]]
    moved = [["John", "25", "NYC"], ["Jane", "26", "LA"], ["Bob", "30", "Boston"]]
    assert counts(spark, people, moved) == (1, 0, 2, 2, 0)
    assert counts(spark, people, moved, similarity_pairing=False) == (1, 2, 0, 0, 0)
    a = [["1", "John", "25"], ["2", "Jane", "30"]]
    b = [["1", "John", "26"], ["2", "Jane", "30"], ["3", "Bob", "22"]]
    assert counts(spark, a, b) == (1, 0, 1, 2, 0)


def test_cells_padding_case_and_width(spark):
    a = rows(spark, {"p": [["Ann  Lee", "x"], ["long common words stay here", "1"]]})
    b = rows(spark, {"p": [["ann lee ", "x", ""], ["long common words stay here", "2", "new"]]})
    deltas, stats = diff.diff(a, b, ignore_case=True)
    s = stats.collect()[0]
    assert (s.equal, s.modified, s.removed, s.added, s.pad_only) == (0, 1, 0, 0, 1)
    d = deltas.collect()[0]
    assert (d.changed_cols, d.old_vals, d.new_vals) == ([1, 2], {1: "1", 2: ""}, {1: "2", 2: "new"})
    report = {(r.column, r.old_value, r.new_value) for r in diff.cell_changes(deltas, ["a", "b"]).collect()}
    assert report == {("b", "1", "2"), ("COL_2", "", "new")}


def test_table_against_itself_is_equal(spark):
    t = [[str(i % 5), "copy"] for i in range(40)]
    assert counts(spark, t, t) == (40, 0, 0, 0, 0)


def reference_counts(a, b, threshold=0.65):
    """Counts by difflib and plain loops."""
    import re

    ja, jb = ["\x1f".join(r) for r in a], ["\x1f".join(r) for r in b]
    tokens = [[set(re.findall(r"[A-Za-z0-9_./\-]{2,64}", s.lower())) for s in j] for j in (ja, jb)]
    n = {"equal": 0, "modified": 0, "removed": 0, "added": 0}
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=ja, b=jb, autojunk=False).get_opcodes():
        if tag == "equal":
            n["equal"] += i2 - i1
            continue
        pairs = []
        for i in range(i1, i2):
            for j in range(j1, j2):
                x, y = tokens[0][i], tokens[1][j]
                s = len(x & y) / len(x | y) if x and y else 0
                if s >= threshold:
                    pairs.append((-s, i, j))
        used_a, used_b = set(), set()
        for _, i, j in sorted(pairs):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
        n["modified"] += len(used_a)
        n["removed"] += i2 - i1 - len(used_a)
        n["added"] += j2 - j1 - len(used_b)
    return tuple(n.values())


def test_rows_that_keep_their_order_diff_as_in_difflib(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    left, right = {}, {}
    for p in range(25):
        a = [[f"id{i}"] + [r.choice(words) for _ in range(4)] for i in range(r.randint(0, 30))]
        b = [list(x) for x in a if r.random() > 0.15]
        for row in b:
            if r.random() < 0.3:
                row[1 + r.randrange(4)] = r.choice(words)
        left[f"p{p}"], right[f"p{p}"] = a, b
    _, stats = diff.diff(rows(spark, left), rows(spark, right))
    got = {s.pair_id: (s.equal, s.modified, s.removed, s.added) for s in stats.collect()}
    want = {p: reference_counts(left[p], right[p]) for p in left if left[p] or right[p]}
    assert got == want


def test_moved_rows_are_equal_and_changed_ones_pair_up(spark):
    t = [[f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}", f"f{i}"] for i in range(11)]
    u = [list(x) for x in [*t[4:], *t[:4]]]
    u[1][2] = "new"
    (s,) = diff.diff(rows(spark, {"p": t}), rows(spark, {"p": u}))[1].collect()
    assert (s.equal, s.modified, s.removed, s.added) == (10, 1, 0, 0)
    u = [list(x) for x in reversed(t)]
    u[3][0] = "new"
    (s,) = diff.diff(rows(spark, {"p": t}), rows(spark, {"p": u}))[1].collect()
    assert (s.equal, s.modified, s.removed, s.added) == (10, 1, 0, 0)


def test_anchors_are_a_longest_rising_run_over_block_cuts(spark, monkeypatch):
    monkeypatch.setattr(diff, "ROW_BLOCK", 4)
    r = random.Random(9)
    a, b = list(range(60)), list(range(60))
    r.shuffle(b)
    left, right = rows(spark, {"p": [[f"r{i}"] for i in a]}), rows(spark, {"p": [[f"r{i}"] for i in b]})
    got = {(x.side, x.row_idx): (x.block, x.moved) for x in diff.diff_blocks(diff.normalised(left), diff.normalised(right)).collect()}
    stay = [i for i in a if not got["a", i][1]]
    assert [i for i in b if not got["b", b.index(i)][1]] == stay
    tops = []
    for i in a:
        k = bisect.bisect_left(tops, b.index(i))
        tops[k : k + 1] = [b.index(i)]
    assert len(stay) == len(tops)
    for side, order in (("a", a), ("b", b)):
        block = 0
        for at, i in enumerate(order):
            block += i in stay
            assert got[side, at] == (block, i not in stay)


def test_rows_that_occur_once_are_paired_without_a_join(spark, monkeypatch):
    a = [["same", str(i)] for i in range(5)] + [["copy"], ["copy"], ["old"]]
    b = [["same", str(i)] for i in range(5)] + [["copy"], ["new"]]
    seen = []
    numbered = diff.number_rows
    monkeypatch.setattr(diff, "number_rows", lambda df, keys, *x, **kw: (seen.append((keys, df.count())), numbered(df, keys, *x, **kw))[1])
    assert counts(spark, a, b) == (6, 0, 2, 1, 0)
    assert [n for keys, n in seen if "hash" in keys] == [3]
    seen.clear()
    assert counts(spark, a[:5], b[:5]) == (5, 0, 0, 0, 0)
    assert not [n for keys, n in seen if "hash" in keys]
    mixed = [(None, 0, ["x"]), ("p", 0, ["x"]), ("p", 1, None)]
    frame = spark.createDataFrame(mixed, SCHEMA)
    assert [(r.pair_id, r.equal) for r in diff.diff(frame, frame)[1].filter("equal > 0").collect()] == [("p", 1)]


def test_head_moved_to_the_end(spark):
    """One row has moved, the others stay anchors, so that changed rows meet in their own blocks."""
    t = [[f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}"] for i in range(13)]
    u = [["n0", "n1", "n2", "n3", "n4"], *[list(x) for x in t[1:]], list(t[0])]
    u[4][2], u[8][0] = "new", "new"
    left, right = rows(spark, {"p": t}), rows(spark, {"p": u})
    blocks = diff.diff_blocks(diff.normalised(left), diff.normalised(right)).filter("moved").collect()
    assert sorted((x.side, x.row_idx) for x in blocks) == [("a", 0), ("b", 13)]
    for pairing in (True, False):
        (s,) = diff.diff(left, right, similarity_pairing=pairing)[1].collect()
        assert (s.equal, s.modified, s.removed, s.added) == (11, 2, 0, 1)


def test_uneven_copies_pair_in_order(spark):
    a = diff.normalised(rows(spark, {"p": [["x"]] * 5 + [["y"]]}))
    b = diff.normalised(rows(spark, {"p": [["x"]] * 3 + [["y"]] * 2}))
    got = diff.diff_blocks(a, b).filter("not equal").collect()
    assert sorted((r.side, r.row_idx) for r in got) == [("a", 3), ("a", 4), ("b", 4)]

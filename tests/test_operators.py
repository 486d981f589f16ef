"""Edits, names, numbering and small cases of the rest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rowloom import session
from rowloom.functions import display, naming, text
from rowloom.operators import align, catalog, dialogue, edits, lookups
from rowloom.plans.ranking import number_rows, rank_rows, top_rows


def test_patch_then_inverse_is_identity(spark):
    df = spark.range(20).select(F.col("id").alias("row_idx"), F.concat(F.lit("v"), "id").alias("a"), F.lit("b").alias("b"))
    fwd = spark.range(5).select((F.col("id") * 3).alias("row_idx"), F.lit(1).alias("seq"), F.lit("a").alias("column"), F.lit("x").alias("value"))
    back = df.join(fwd.select("row_idx"), "row_idx").select("row_idx", F.lit(1).alias("seq"), F.lit("a").alias("column"), F.col("a").alias("value"))
    once = edits.patch_cells(df, fwd)
    assert once.filter("a = 'x'").count() == 5
    assert sorted(edits.patch_cells(once, back).collect()) == sorted(df.collect())


def test_unknown_columns(spark):
    df = spark.createDataFrame([(0, "a")], "row_idx long, c string")
    p = spark.createDataFrame([(0, 1, "new", "v"), (None, 2, "c", "x"), (9, 3, "c", "x"), (0, 4, None, "x")], "row_idx long, seq int, `column` string, value string")
    assert [tuple(r) for r in edits.patch_cells(df, p).collect()] == [(0, "a", "v")]
    with pytest.raises(ValueError):
        edits.patch_cells(df, p, on_unknown="error")


def test_number_rows_with_hot_key(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randint(0, 5)}", i, r.randint(0, 9)) for i in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v int")
    want, seen, sums = {}, {}, {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        seen[k] = seen.get(k, 0) + 1
        sums[k] = sums.get(k, 0) + v
        want[i] = (seen[k], sums[k])
    for block in (None, F.expr("i div 100")):
        got = number_rows(df, ["k"], ["i"], sums={"s": F.col("v")}, block=block).collect()
        assert {x.i: (x.rn, x.s) for x in got} == want


def test_rank_counts_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 3), ("a", None), ("b", 1)], "k string, v int")
    got = sorted((r.k, -1 if r.v is None else r.v, r["rank"]) for r in rank_rows(df, ["k"], "v").collect())
    assert got == [("a", -1, 4), ("a", 3, 3), ("a", 5, 1), ("a", 5, 1), ("b", 1, 1)]


def test_exact_quantiles(spark):
    import numpy as np

    from rowloom.operators import analysis

    r = random.Random(7)
    rows = [(r.choice("ab"), r.choice([r.randint(0, 9), None, r.randint(0, 1000)])) for _ in range(500)] + [("c", 4), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {x.k: (x.p10, x.p50, x.p75) for x in analysis.quantiles(df, "v", ["k"], [0.1, 0.5, 0.75]).collect()}
    for k in "abc":
        assert np.allclose(got[k], np.percentile([v for c, v in rows if c == k and v is not None], [10, 50, 75]))
    assert analysis.measures(df, "v").first()["median"] == np.median([v for _, v in rows if v is not None])


def test_top_rows_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    got = top_rows(df, ["k"], [F.desc("id")], 1500)
    assert got.count() == 3000 and got.agg(F.min("id")).first()[0] == 2000


def test_output_names_never_meet(spark):
    paths = ["a.xml", "a.XML", "a.Xml", "a_1.xml", "a_3.xml", "d/a.xml", "d__a.xml", "d/e/f.xml"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.csv_name for r in catalog.unique_names(df).collect()}
    assert len(set(got.values())) == len(paths)
    assert got["a_1.xml"] == "a_1.csv" and got["d/e/f.xml"] == "d__e__f.csv"
    assert {got[p] for p in ("a.xml", "a.XML", "a.Xml")} == {"a.csv", "a_2.csv", "a_4.csv"}


def test_free_numbers_pass_over_taken_ones(spark, monkeypatch):
    """Many files of one name beside many numbers that others have, over several blocks."""
    monkeypatch.setattr(catalog, "NAME_BLOCK", 7)
    r = random.Random(12)
    taken = {n for n in range(1, 400) if r.random() < 0.4}
    paths = ["/".join(["a", *p, "x"]) + f".{e}" for p, e in [((), f"e{i:03d}") for i in range(150)]]
    paths += [f"a__x_{n}.xml" for n in taken]
    got = {x.path: x.csv_name for x in catalog.unique_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    free = (n for n in range(1, 10_000) if n not in taken)
    want = {p: "a__x.csv" if i == 0 else f"a__x_{next(free)}.csv" for i, p in enumerate(sorted(p for p in paths if p.startswith("a/")))}
    assert {p: n for p, n in got.items() if p in want} == want
    assert len(set(got.values())) == len(paths)


def test_stamps_and_sources(spark):
    rows = [(1, 0, "user", "q", "t0", None), (1, 1, "assistant", "a", "t1", ["x.csv", None])]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ts string, files array<string>")
    (r,) = dialogue.transcript(c, "md", "now", ts="ts", sources="files").collect()
    assert r.transcript.endswith("## User (t0)\n\nq\n\n---\n\n## Assistant (t1)\n\na\n\n**Sources:**\n- x.csv\n- unknown\n\n---\n")
    (r,) = dialogue.transcript(c, "json", ts="ts", sources="files").collect()
    assert json.loads(r.transcript)[1] == {"role": "assistant", "content": "a", "timestamp": "t1", "sources": ["x.csv", None]}


def test_history_is_the_tail(spark):
    df = spark.range(120).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    assert sorted(r.turn for r in dialogue.last_turns(df).collect()) == list(range(70, 120))


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.norm_cell(F.lit("\x00 a  \t b\x1f "))) == "a b"
    assert get(text.norm_cell(F.lit(" A  b "), trim_ws=False)) == " A  b "
    assert get(display.byte_size(F.lit(1280))) == "1.2 KB" and get(display.byte_size(F.lit(0))) == "0.0 B"
    assert get(display.currency(F.lit(-1234.5))) == "-$1,234.50" and get(display.currency(F.lit(None).cast("double"))) == "—"
    assert get(display.grouped_number(F.lit(1234567.25))) == "1,234,567.25"
    assert get(display.label(F.lit("unit_pRice"))) == "Unit PRice"
    assert get(naming.group_from_archive(F.lit("7_BATCH (1).zip"))) is None
    assert get(naming.group_from_archive(F.lit("1_book.zip"))) == "BOOK"
    assert get(naming.safe_path(F.lit("..\\/./"))) == "file"
    assert get(naming.output_path(F.lit("/x/../y/a.XML"))) == "x/y/a.csv"
    assert get(naming.group_from_path(F.lit("s/output/ab_c.csv"))) == "AB"
    assert get(naming.group_from_path(F.lit("s/K/ab_c.csv"))) == "K"


def test_equal_files_stay_rows_of_their_own(spark):
    files = spark.createDataFrame([("AB_one.csv",), ("AB_one.csv",), ("nil.csv",), (None,)], "filename string")
    groups = spark.createDataFrame([("AB", 1), ("one", 2)], "group string, ord int")
    assert [r.matched_group for r in lookups.match_prefix(files, groups).collect()] == ["AB", "AB"]
    assert [r.matched_group for r in lookups.match_contains(files, groups).collect()] == ["AB", "AB"]


def test_fingerprint_of_a_table_longer_than_four_levels(spark):
    rows = spark.range(40).select(F.lit("t").alias("k"), F.col("id").alias("i"))
    assert align.table_fingerprint(rows, "k", "i", F.col("i").cast("string"), fan_out=2).count() == 1


def test_transcripts_hold_all_turns(spark):
    c = spark.range(1500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    (r,) = dialogue.transcript(c).collect()
    assert r.transcript.count("USER") == 1500
    (r,) = dialogue.transcript(c, n=3).collect()
    assert r.transcript.count("USER") == 3


def test_the_package_is_zipped_for_workers(monkeypatch):
    import zipfile

    class Context:
        master, sent = "spark://somewhere", []

        def addPyFile(self, path):
            self.sent.append(path)

    class Session:
        sparkContext = Context()

    session.ship(Session())
    session.ship(Session())
    (path,) = Session.sparkContext.sent
    assert "rowloom/operators/diff.py" in zipfile.ZipFile(path).namelist()

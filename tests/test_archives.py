"""Archives, scans, tables on disk."""

import csv
import io
import os
import random
import tempfile
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from rowloom.functions import naming
from rowloom.sources import archives, markup, tables


def zipped(entries, deflate=False):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED) as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return buf.getvalue()


def expand(spark, named, **kw):
    df = spark.createDataFrame(list(named.items()), "path string, content binary")
    return archives.expand_archives(df, **kw)


def test_nested_archives_and_groups(spark):
    inner = {"F/in1.zip": zipped({"G/b.xml": "<b/>", "c.txt": "x"}), "F/2_BATCH.zip": zipped({"d.xml": "<d/>"})}
    blob = zipped({"a.xml": "<a/>", "_h/e.xml": "1", ".s/f.xml": "1"} | inner)
    got = archives.inventory(expand(spark, {"p/AR_X.zip": blob, "q/All_20260113_055727.zip": blob}))
    rows = {(r.archive, r.path): r.group for r in got.collect()}
    assert rows == {
        ("p/AR_X.zip", "a.xml"): "AR_X",
        ("p/AR_X.zip", "_nested_1_in1/G/b.xml"): "AR_X",
        ("p/AR_X.zip", "_nested_1_2_BATCH/d.xml"): "AR_X",
        ("q/All_20260113_055727.zip", "a.xml"): "ROOT",
        ("q/All_20260113_055727.zip", "_nested_1_in1/G/b.xml"): "F",
        ("q/All_20260113_055727.zip", "_nested_1_2_BATCH/d.xml"): "ROOT",
    }


def test_limits(spark):
    deep = zipped({"x.xml": "1"})
    for _ in range(4):
        deep = zipped({"in.zip": deep})
    assert expand(spark, {"d.zip": deep}).count() == 1
    (r,) = expand(spark, {"d.zip": deep}, max_depth=4).collect()
    assert r.error == "nested deeper than 4" and r.path.endswith("in.zip") and r.content is None
    bomb = zipped({"z.xml": "0" * 1_000_000, "ok.xml": "abc"}, deflate=True)
    assert [(r.path, r.error) for r in expand(spark, {"b.zip": bomb}, max_ratio=200).collect()] == [("z.xml", "packed more than 200 to 1"), ("ok.xml", None)]
    assert sorted(r.path for r in expand(spark, {"b.zip": bomb}).collect()) == ["ok.xml", "z.xml"]
    broken = zipped({"in.zip": b"no archive", "ok.xml": "abc"})
    assert {(r.path, r.error is None) for r in expand(spark, {"n.zip": broken}).collect()} == {("in.zip", False), ("ok.xml", True)}
    sizes = zipped({"1.xml": "x" * 60, "2.xml": "x" * 60, "3.xml": "x"})
    assert [r.path for r in expand(spark, {"s.zip": sizes}, max_bytes=100).collect()] == ["1.xml"]


def test_bad_archive_is_a_row(spark):
    got = expand(spark, {"bad.zip": b"nothing"}).collect()
    assert len(got) == 1 and got[0].path is None and got[0].error


def test_scan(spark):
    root = tempfile.mkdtemp(prefix="rowloom-scan-")
    for rel in ("a.xml", "sub/B.XML", "sub/c.txt", ".git/d.xml", "_tmp/e.xml"):
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write("<a/>")
    got = {(r.path, r.filename, r.size) for r in archives.scan_files(spark, root).collect()}
    assert got == {("a.xml", "a.xml", 4), ("sub/B.XML", "B.XML", 4)}


def test_entries_unpacked_apart_are_those_of_whole_archives(spark):
    """Nested archives, folders, hidden ones, limits and broken archives give the same rows either way."""
    deep = zipped({"x/one.xml": "<a/>" * 50, "two.CSV": "a,b\n", "skip.txt": "-", ".h/hid.xml": "-"}, deflate=True)
    mid = zipped({"F/deep.zip": deep, "G/bad.zip": b"no archive", "m.xml": "m"}, deflate=True)
    named = {"p/all.zip": zipped({"top.xml": "t", "n/mid.zip": mid, "n/deep.ZIP": deep, "z.csv": "z"}), "q/broken.zip": b"PK broken", "q/empty.zip": zipped({})}
    df = spark.createDataFrame(list(named.items()), "path string, content binary")

    def rows(found):
        return sorted(
            [(r.archive, r.entry_no, r.path, r.filename, r.zip_chain, r.size, r.compressed_size, bytes(r.content) if r.content is not None else None, bool(r.error)) for r in found.collect()], key=repr
        )

    for limits in ({}, {"max_depth": 2}, {"max_ratio": 5.0}):
        assert rows(archives.spread_archives(df, **limits)) == rows(archives.expand_archives(df, **limits))
    assert rows(archives.spread_archives(df.limit(0))) == []
    # a damaged entry is an error of its own
    blob = bytearray(zipped({"a.xml": "text one", "b.xml": "text two"}))
    blob[blob.index(b"text one")] ^= 1
    got = archives.spread_archives(spark.createDataFrame([("d.zip", bytes(blob))], "path string, content binary")).collect()
    assert sorted((r.path, r.error is None) for r in got) == [("a.xml", False), ("b.xml", True)]


def test_decode(spark):
    blobs = ["café".encode(), "café".encode("latin-1"), b"\xef\xbb\xbfhead", b""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary")
    got = [r.t for r in df.orderBy("i").select(archives.decode_text(F.col("b")).alias("t")).collect()]
    assert got == ["café", "café", "head", ""]


def test_collection_with_ragged_rows_and_line_breaks(spark):
    root = tempfile.mkdtemp(prefix="rowloom-csv-")
    with open(f"{root}/a.csv", "w") as f:
        f.write('x,y,z\n1,"two ""q""\nlines",3\n4\n5,6,7,8\n,,\n')
    with open(f"{root}/b.csv", "w") as f:
        f.write("only\nv\n")
    got = tables.read_collection(spark, root).collect()
    rows = {(r.file[-5:], r.row_idx): list(r.cells) for r in got}
    assert rows == {
        ("a.csv", 0): ["1", 'two "q"\nlines', "3"],
        ("a.csv", 1): ["4", "", ""],
        ("a.csv", 2): ["5", "6", "7"],
        ("a.csv", 3): ["", "", ""],
        ("b.csv", 0): ["v"],
    }
    one = tables.read_table(spark, f"{root}/a.csv", max_rows=2, max_cols=2).orderBy("row_idx").collect()
    assert [(r.x, r.y) for r in one] == [("1", 'two "q"\nlines'), ("4", "")]


def test_wide_tables_are_whole_or_cut(spark):
    root = tempfile.mkdtemp(prefix="rowloom-wide-")
    with open(f"{root}/w.csv", "w") as f:
        f.write(",".join(f"c{i}" for i in range(300)) + "\n" + ",".join(str(i) for i in range(300)) + "\n")
    (whole,) = tables.read_collection(spark, root).collect()
    assert list(whole.cells) == [str(i) for i in range(300)] and whole.header[299] == "c299"
    got = tables.read_collection(spark, root, max_cols=2).collect()
    assert [(list(r.header), list(r.cells)) for r in got] == [(["c0", "c1"], ["0", "1"])]


def test_quoted_lines_over_many_splits(spark):
    """A file cut anywhere, within quoted cells too, gives the records that one reader sees."""
    root, r = tempfile.mkdtemp(prefix="rowloom-split-"), random.Random(6)
    pieces = ["a", "b,c", 'say ""x""', "line\nbreak", "", "\n\n", "tail ü"]
    rows = [[str(i), r.choice(pieces).replace('""', '"'), "".join(r.choice(pieces) for _ in range(3)).replace('""', '"')] for i in range(400)]
    with open(f"{root}/big.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["n", "one", "two"], *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = tables.read_collection(spark, root)
        got = df.orderBy("row_idx").collect()
        assert spark.read.option("lineSep", "\n").text(root).select(F.spark_partition_id()).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [list(x.cells) for x in got] == rows


def test_lines_are_those_of_a_csv_writer(spark):
    rows = [["a", "b"], ["x,y", 'q"q'], ["", ""], ["l\nb", "c\rd"], ["plain", ""]]
    df = spark.createDataFrame([(x,) for x in [*rows, [""], ["one"]]], "c array<string>")
    got = [r.l for r in df.select(tables.csv_line(F.col("c")).alias("l")).collect()]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\x00").writerows([*rows, [""], ["one"]])
    assert got == out.getvalue().split("\x00")[:-1]


def test_ragged_tables_in_parts(spark):
    """Every table under its own header, cut in parts that each have it."""
    recs = [("t", i, {"a": str(i), **({"b,x": "1"} if i % 3 == 1 else {})}) for i in range(7)] + [("u", 0, {"z": 'say "hi"'})]
    order = {"t": ["a", "b,x"], "u": ["z"]}
    df = spark.createDataFrame([(k, i, [c for c in order[k] if c in f], f) for k, i, f in recs], "k string, record_idx long, field_order array<string>, fields map<string,string>")
    root = tempfile.mkdtemp(prefix="rowloom-ragged-") + "/out"
    tables.write_ragged(df, markup.header_of(df, ["k"]), root, "k", part_rows=3)
    assert sorted(os.listdir(f"{root}/k=t")) == ["part=0", "part=1", "part=2"]
    got = tables.read_collection(spark, root).collect()
    assert sorted(list(r.cells) for r in got if "k=t" in r.file) == [[str(i), "1" if i % 3 == 1 else ""] for i in range(7)]
    assert {tuple(r.header) for r in got if "k=t" in r.file} == {("a", "b,x")}
    assert [list(r.cells) for r in got if "k=u" in r.file] == [['say "hi"']]
    text = {r.k: r.content for r in tables.table_texts(df, markup.header_of(df, ["k"]), ["k"]).collect()}
    assert text["u"] == 'z\n"say ""hi"""\n' and text["t"].startswith('a,"b,x"\n0,\n1,1\n')


def test_group_rules(spark):
    cases = [
        ("JOURNAL/a_001.xml", "a_001.xml", "JOURNAL"),
        ("BOOK/b.xml", "b.xml", "BOOK"),
        ("DISS/x/d.xml", "d.xml", "DISS"),
        ("other_1.xml", "other_1.xml", "OTHER"),
        ("12/ab_1.xml", "ab_1.xml", "AB"),
        ("9.xml", "9.xml", "EXTRAS"),
    ]
    df = spark.createDataFrame(cases, "p string, f string, g string")
    assert df.filter(naming.infer_group(F.col("p"), F.col("f")) != F.col("g")).count() == 0


def test_small_entries_are_handed_on_by_their_number(monkeypatch):
    monkeypatch.setattr(archives, "BATCH_ROWS", 10)
    expand = archives._expander("path", "content", (".xml",), None, None, None)
    blob = zipped({f"{i}.xml": "x" for i in range(7)})
    made = list(expand(iter([pd.DataFrame({"path": [f"{i}.zip" for i in range(9)], "content": [blob] * 9})])))
    assert [len(x) for x in made] == [10] * 6 + [3]


def test_small_entries_are_unpacked_together(spark, monkeypatch):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], archives.LISTED).schema)
    packed = lambda i: zlib.compress(b"x" * i)[2:-4]
    rows = [
        dict(archive="a", depth=1, place=[i], path=f"{i}.xml", chain=["a"], kind="file", size=i, compressed_size=1, method=8, crc=zlib.crc32(b"x" * (i + (i == 5))), data=packed(i), error=None)
        for i in range(50)
    ]
    rows[7]["data"] = b"no stream"
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    (out,) = archives._unpack(iter([batch]))
    got = out.to_pylist()
    assert [r["kind"] for r in got] == ["error" if i in (5, 7) else "file" for i in range(50)]
    assert all(r["data"] == (None if i in (5, 7) else b"x" * i) for i, r in enumerate(got)) and got[5]["error"] and got[7]["error"]
    monkeypatch.setattr(archives, "BATCH_BYTES", 100)
    assert sum((b.to_pylist() for b in archives._unpack(iter([batch]))), []) == got

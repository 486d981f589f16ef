"""Flattening rules on small documents."""

import random
import tempfile

from rowloom.reports import convert
from rowloom.sources import markup


def fields(spark, doc, **kw):
    df = spark.createDataFrame([("d", doc)], "path string, content string")
    rows = markup.flatten(df, ["path"], **kw).collect()
    recs = sorted((r for r in rows if r.record_idx is not None), key=lambda r: r.record_idx)
    return [[(k, r.fields[k]) for k in r.field_order] for r in recs], [r for r in rows if r.record_idx is None][0]


def test_siblings_count_from_the_last(spark):
    doc = "<r><head/><body><p><n>a</n></p><p><n>b</n></p><p><n>c</n></p></body></r>"
    recs, done = fields(spark, doc)
    assert recs == [[("p[3].n", "a"), ("p[2].n", "b"), ("p.n", "c")]]  # the empty head gives no record
    assert (done.rows, done.columns, done.error) == (1, 3, None)


def test_repeated_child_makes_the_records_and_loses_its_attributes(spark):
    recs, _ = fields(spark, '<r><x>1</x><rec id="7"><k u="v">t</k></rec><rec><k>s</k></rec></r>')
    assert recs == [[("k@u", "v"), ("k", "t")], [("k", "s")]]
    recs, _ = fields(spark, '<r><rec id="7"><k>t</k></rec><rec/></r>', include_root=True)
    assert recs == [[("rec@id", "7"), ("rec.k", "t")], [("rec", "")]]


def test_namespaces_go_from_elements_only(spark):
    recs, _ = fields(spark, '<r xmlns="urn:x"><a><t xml:lang="en">hi</t></a></r>')
    assert recs == [[("t@{http://www.w3.org/XML/1998/namespace}lang", "en"), ("t", "hi")]]


def test_text_beside_children_is_dropped_and_values_are_whole_unless_cut(spark):
    recs, _ = fields(spark, f"<r><a>lost<b>{'y' * 400}</b>lost</a></r>", max_len=300)
    assert recs == [[("b", "y" * 300)]]
    recs, _ = fields(spark, f"<r><a><b>{'y' * 400}</b></a></r>")
    assert recs == [[("b", "y" * 400)]]


def test_explicit_tag_and_fallbacks(spark):
    assert fields(spark, "<r><a><z>1</z></a><b><a><z>2</z></a></b></r>", record_tag="a")[0] == [[("z", "1")], [("z", "2")]]
    assert fields(spark, "<r><a>1</a></r>", record_tag="none")[0] == [[("a", "1")]]
    assert fields(spark, "<root><x><title>t</title><author>u</author><year>1</year></x></root>")[0] == [
        [("title", "t"), ("author", "u"), ("year", "1")]
    ]


def test_bad_documents_are_reported(spark):
    for doc in ("<r><a></r>", "", None, "<leaf/>"):
        recs, done = fields(spark, doc)
        assert recs == [] and done.rows == 0 and done.error == "No records found in XML"


def test_deep_documents(spark):
    doc = "<r><a>" + "<d>" * 3000 + "x" + "</d>" * 3000 + "</a></r>"
    recs, _ = fields(spark, doc, max_len=5)
    assert len(recs) == 1 and recs[0][0][1] == "x"


def test_wide_table_keeps_first_seen_order(spark):
    df = spark.createDataFrame([("d", "<r><x><b>1</b></x><x><a>2</a><b>3</b></x></r>")], "path string, content string")
    recs = markup.records(markup.flatten(df, ["path"]))
    header = [r.column for r in markup.header_of(recs, ["path"]).orderBy("position").collect()]
    assert header == ["b", "a"]
    wide = markup.to_wide(recs, header, ["path"]).orderBy("record_idx").collect()
    assert [(r.b, r.a) for r in wide] == [("1", ""), ("3", "2")]


def test_nested_records_of_one_tag_render_by_name(spark):
    doc = "<r><rec><t>outer text that is long enough</t><rec><t>inner text that is long enough</t></rec></rec></r>"
    df = spark.createDataFrame([("d", doc)], "path string, content string")
    got = markup.record_text(df, ["path"], "rec", min_chars=5).orderBy("record_idx").collect()
    assert [r.content for r in got] == ["rec | t | inner text that is long enough", "rec | t | outer text that is long enough | rec"]


def test_deep_and_many_records_render(spark):
    deep = "<r><rec>" + "<d>" * 3000 + "x" + "</d>" * 3000 + "</rec><rec>y</rec></r>"
    many = "<r>" + "<rec>z</rec>" * 6000 + "</r>"
    df = spark.createDataFrame([("deep", deep), ("many", many)], "path string, content string")
    got = {(r.path, r.record_idx): r.content for r in markup.record_text(df, ["path"], "rec").collect()}
    assert got["deep", 0] == " | ".join(["rec", *["d"] * 3000, "x"]) and got["deep", 1] == "rec | y"
    assert sum(p == "many" for p, _ in got) == 6000
    xml = {(r.path, r.record_idx): r.content for r in markup.record_xml(df, ["path"]).collect()}
    assert xml["deep", 0] == "<rec>" + "<d>" * 3000 + "x" + "</d>" * 3000 + "</rec>"
    assert xml["deep", 1] == "<rec>y</rec>" and sum(p == "many" for p, _ in xml) == 6000


def test_comments_and_texts_behind_them(spark):
    doc = "<r><rec k=' v '>a<!--no-->b<t>c</t>d<?p q?>e</rec></r>"
    df = spark.createDataFrame([("d", doc)], "path string, content string")
    got = [r.content for r in markup.record_text(df, ["path"], "rec").collect()]
    assert got == ["rec | k=v | a | b | t | c | d | e"]


def test_the_tag_is_guessed_from_the_whole_document(spark):
    doc = "<r><head>" + "<small/>" * 1200 + "</head>" + "<record/>" * 5000 + "</r>"
    df = spark.createDataFrame([("d", doc)], "path string, content string")
    assert [r.record_tag for r in markup.guess_record_tag(markup.elements(df, ["path"]), ["path"]).collect()] == ["record"]


def test_large_documents_are_read_in_splits(spark):
    """A file cut anywhere gives the records of the whole document, name spaces, empty records and odd attributes included."""
    r = random.Random(8)
    body = "".join(
        r.choice([f"<d:rec id='{i}' q=\"a>b\"><x>v{i}</x><x>é{i}</x></d:rec>", f"<d:rec k='{i}'/>", "<skip>\n</skip>", f"<d:rec><y><z>t {i}</z></y></d:rec>", "</g><g n='1'>", "<d:record>no</d:record>"])
        for i in range(300)
    )
    doc = f"<?xml version='1.0'?>\n<!-- c --><all xmlns:d='urn:d' xmlns=\"urn:x\"><g>{body}</g></all>"
    root = tempfile.mkdtemp(prefix="rowloom-big-")
    for name, text in (("a", doc), ("b", doc.replace("v1", "w1")), ("none", "<all/>")):
        with open(f"{root}/{name}.xml", "w") as f:
            f.write(text)
    docs = spark.createDataFrame([(n, t) for n, t in (("a", doc), ("b", doc.replace("v1", "w1")))], "path string, content string")
    want = {(x.path, x.record_idx): (x.field_order, x.fields) for x in markup.records(markup.flatten(docs, ["path"], record_tag="rec")).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = {(x.file[-5], x.record_idx): (x.field_order, x.fields) for x in markup.read_records(spark, root, "d:rec").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(want) > 200


def test_tasks_of_documents_hold_a_bounded_number(spark, monkeypatch):
    root = tempfile.mkdtemp()
    spark.range(3000).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "'F' AS o_orderstatus", "1.5D AS o_totalprice", "'1-URGENT' AS o_orderpriority").write.parquet(f"{root}/orders.parquet")
    monkeypatch.setattr(convert, "TASK_ROWS", 100)
    assert convert.order_docs(spark, root).rdd.getNumPartitions() == convert.list_docs(spark, root).rdd.getNumPartitions() == 30
    assert convert.wide_records(spark, root).count() == 6000

"""Comparison of file collections and of tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from rowloom.functions import text
from rowloom.operators import align, diff, drilldown
from rowloom.plans.ranking import number_rows
from rowloom.reports.registry import report, table, texts
from rowloom.session import dealt, pin
from rowloom.sources import tables

COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


# --- two extracts of one table ---------------------------------------------

def customers(spark, d):
    return table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))


def orders_alike(spark, d):
    """Orders under the column names of the customer table, for the same comparison on ten times the rows."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("c_custkey"),
        F.concat(F.lit("Order#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("c_name"),
        F.col("o_custkey").alias("c_nationkey"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
    )


def left_rows(a, pair=None):
    return diff.table_rows(a.withColumn("ord", F.col("c_custkey")), COLUMNS, pair, order=["ord"], block=F.expr("ord div 100000"))


def right_rows(a, pair=None):
    """The same table with rows dropped, changed, padded and added."""
    key = F.col("c_custkey")
    kept = a.filter(key % 23 != 5).select(
        (key * 2).alias("ord"),
        "c_custkey",
        F.when(key % 41 == 7, F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("# ")), F.lit(" "))).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(key % 17 == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).cast("decimal(18,2)").alias("c_acctbal"),
        F.when(key % 29 == 11, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    new = a.filter(key % 31 == 30).select(
        (key * 2 + 1).alias("ord"), "c_custkey", F.concat(F.lit("New "), "c_name").alias("c_name"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    return diff.table_rows(kept.unionByName(new), COLUMNS, pair, order=["ord"], block=F.expr("ord div 100000"))


DIFF = r"""
WITH RECURSIVE
c AS (SELECT {source}),
ra AS (SELECT {pair} AS pair_id, k AS ord, [k::VARCHAR, nm, nk::VARCHAR, bal::VARCHAR, seg] AS cells FROM c),
rb AS (SELECT {pair} AS pair_id, k * 2 AS ord, [k::VARCHAR, CASE WHEN k % 41 = 7 THEN '  ' || replace(nm, '#', '# ') || ' ' ELSE nm END, nk::VARCHAR,
         (CASE WHEN k % 17 = 3 THEN bal + 1 ELSE bal END)::DECIMAL(18,2)::VARCHAR, CASE WHEN k % 29 = 11 THEN lower(seg) ELSE seg END] AS cells FROM c WHERE k % 23 <> 5
       UNION ALL SELECT {pair}, k * 2 + 1, [k::VARCHAR, 'New ' || nm, nk::VARCHAR, bal::VARCHAR, seg] FROM c WHERE k % 31 = 30),
n AS (SELECT pair_id, side, row_number() OVER (PARTITION BY pair_id, side ORDER BY ord) - 1 AS idx,
        list_transform(cells, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS cells
      FROM (SELECT 'a' AS side, * FROM ra UNION ALL SELECT 'b', * FROM rb)),
h AS (SELECT *, sha1(array_to_string(cells, chr(31))) AS hash, list_distinct(regexp_extract_all(lower(array_to_string(cells, chr(31))), '[A-Za-z0-9_./\-]{{2,64}}')) AS toks,
        row_number() OVER (PARTITION BY pair_id, side, array_to_string(cells, chr(31)) ORDER BY idx) AS occ FROM n),
eq AS (SELECT a.pair_id, a.idx AS ia, b.idx AS ib FROM h a JOIN h b ON a.pair_id = b.pair_id AND a.hash = b.hash AND a.occ = b.occ AND a.side = 'a' AND b.side = 'b'),
m AS (SELECT h.*, EXISTS (SELECT 1 FROM eq WHERE eq.pair_id = h.pair_id AND (CASE WHEN h.side = 'a' THEN eq.ia ELSE eq.ib END) = h.idx) AS same FROM h),
g AS (SELECT *, sum(same::INT) OVER (PARTITION BY pair_id, side ORDER BY idx) AS blk FROM m),
oa AS (SELECT * FROM g WHERE side = 'a' AND NOT same), ob AS (SELECT * FROM g WHERE side = 'b' AND NOT same),
sim AS (SELECT a.pair_id, a.idx AS ia, b.idx AS ib, a.cells AS ca, b.cells AS cb,
          len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))::DOUBLE AS s,
          row_number() OVER (PARTITION BY a.pair_id, a.blk ORDER BY len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))::DOUBLE DESC, a.idx, b.idx) AS rk,
          a.pair_id || ':' || a.blk AS bk
        FROM oa a JOIN ob b ON a.pair_id = b.pair_id AND a.blk = b.blk
        WHERE len(a.toks) > 0 AND len(b.toks) > 0 AND len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))::DOUBLE >= 0.65),
gr AS (SELECT bk, 0::BIGINT AS rk, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::BIGINT AS ia, NULL::BIGINT AS ib FROM sim GROUP BY bk
       UNION ALL
       SELECT g.bk, s.rk, CASE WHEN list_contains(g.ua, s.ia) OR list_contains(g.ub, s.ib) THEN g.ua ELSE list_append(g.ua, s.ia) END,
         CASE WHEN list_contains(g.ua, s.ia) OR list_contains(g.ub, s.ib) THEN g.ub ELSE list_append(g.ub, s.ib) END,
         CASE WHEN list_contains(g.ua, s.ia) OR list_contains(g.ub, s.ib) THEN NULL ELSE s.ia END, s.ib
       FROM gr g JOIN sim s ON s.bk = g.bk AND s.rk = g.rk + 1),
pr AS (SELECT s.* FROM gr JOIN sim s ON s.bk = gr.bk AND s.rk = gr.rk WHERE gr.ia IS NOT NULL),
d AS (SELECT pair_id, 'MODIFIED' AS kind, ia AS row_a, ib AS row_b, ca, cb FROM pr WHERE ca <> cb
      UNION ALL SELECT pair_id, 'REMOVED', idx, NULL, cells, NULL FROM oa WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.pair_id = oa.pair_id AND pr.ia = oa.idx)
      UNION ALL SELECT pair_id, 'ADDED', NULL, idx, NULL, cells FROM ob WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.pair_id = ob.pair_id AND pr.ib = ob.idx))
"""
CUSTOMERS = "c_custkey k, c_name nm, c_nationkey nk, c_acctbal::DECIMAL(18,2) bal, c_mktsegment seg FROM customer"
ORDERS = "o_orderkey k, 'Order#' || lpad(o_orderkey::VARCHAR, 9, '0') nm, o_custkey nk, o_totalprice::DECIMAL(18,2) bal, o_orderpriority seg FROM orders"
WHOLE = DIFF.format(pair="'table'", source=CUSTOMERS)
BY_NATION = DIFF.format(pair="nk::VARCHAR", source=CUSTOMERS)
ROWS = """SELECT pair_id, kind, row_a, row_b,
  array_to_string(list_filter([CASE WHEN ca[i] IS DISTINCT FROM cb[i] THEN i - 1 END for i in range(1, 6)], lambda x: x IS NOT NULL), ',') AS changed,
  coalesce(array_to_string(list_filter([CASE WHEN ca[i] IS DISTINCT FROM cb[i] THEN ca[i] END for i in range(1, 6)], lambda x: x IS NOT NULL), '|'), '') AS old_values,
  coalesce(array_to_string(list_filter([CASE WHEN ca[i] IS DISTINCT FROM cb[i] THEN cb[i] END for i in range(1, 6)], lambda x: x IS NOT NULL), '|'), '') AS new_values FROM d"""


def _flat(deltas):
    pick = lambda m: F.array_join(F.filter(F.transform("changed_cols", lambda i: F.try_element_at(m, i)), lambda x: x.isNotNull()), "|")
    return deltas.select(
        "pair_id", "kind", "row_a", "row_b", F.array_join(F.transform("changed_cols", lambda i: i.cast("string")), ",").alias("changed"),
        pick(F.col("old_vals")).alias("old_values"), pick(F.col("new_vals")).alias("new_values"),
    )


@report(WHOLE + ROWS)
def table_changes(spark, d):
    deltas, _ = diff.diff(left_rows(customers(spark, d)), right_rows(customers(spark, d)), width=5)
    return _flat(deltas)


@report("""
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
b AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN i % 50 < 20 THEN 1 ELSE 0 END, i) - 1 AS j FROM c WHERE i % 17 <> 3)
SELECT CASE WHEN b.i IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS kind, c.i AS row_a, b.j AS row_b FROM c LEFT JOIN b USING (i) WHERE b.i IS NULL OR c.i % 10 = 7
""")
def moved_rows(spark, d):
    """Two blocks of rows of every fifty moved to the end, cells changed and rows removed."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("bal"))
    c = number_rows(c, [], ["c_custkey"], number="n").withColumn("i", F.col("n") - 1)
    cells = ["c_custkey", "c_name", "c_mktsegment", "bal", "again", "more"]
    c = c.withColumn("again", F.concat(F.lit("K"), F.col("c_custkey") * 7)).withColumn("more", F.concat(F.lit("M"), F.col("c_custkey") * 11))
    left = diff.table_rows(c, cells, row_idx="i")
    right = c.filter("i % 17 <> 3").withColumn("at", F.when(F.col("i") % 50 < 20, 1).otherwise(0))
    right = right.withColumn("bal", F.when(F.col("i") % 10 == 7, F.lit("none")).otherwise(F.col("bal").cast("string")))
    right = diff.table_rows(right, cells, order=["at", "i"])
    return diff.diff(left, right)[0].select("kind", "row_a", "row_b")


REORDERED = """
WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
x AS (SELECT *, i % 17 = 3 AND i NOT IN (0, n - 1) AS changed FROM c),
b AS (SELECT *, row_number() OVER (ORDER BY {place}, i) - 1 AS j FROM x)
SELECT 'MODIFIED' AS kind, i AS row_a, j AS row_b FROM b WHERE changed
UNION ALL SELECT 'MOVED', i, NULL FROM b WHERE NOT changed AND {moved}
UNION ALL SELECT 'MOVED', NULL, j FROM b WHERE NOT changed AND {moved}"""


def _reordered(spark, d, place, similar):
    """The customers against themselves in another order with changed cells: changes, and the rows on each side that moved."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("bal"))
    c = number_rows(c, [], ["c_custkey"], number="rn").withColumn("i", F.col("rn") - 1).withColumn("n", F.lit(c.count()))
    c = c.withColumn("again", F.concat(F.lit("K"), F.col("c_custkey") * 7)).withColumn("more", F.concat(F.lit("M"), F.col("c_custkey") * 11))
    cells = ["c_custkey", "c_name", "c_mktsegment", "bal", "again", "more"]
    changed = (F.col("i") % 17 == 3) & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    right = c.withColumn("bal", F.when(changed, F.lit("none")).otherwise(F.col("bal"))).withColumn("at", F.expr(place))
    left, right = diff.table_rows(c, cells, row_idx="i"), diff.table_rows(right, cells, order=["at", "i"])
    moved = diff.diff_blocks(diff.normalised(left), diff.normalised(right)).filter("moved")
    mine = lambda s: F.when(F.col("side") == s, F.col("row_idx"))
    moved = moved.select(F.lit("MOVED").alias("kind"), mine("a").alias("row_a"), mine("b").alias("row_b"))
    return diff.diff(left, right, similarity_pairing=similar)[0].select("kind", "row_a", "row_b").unionByName(moved)


HEAD, TAIL, HALVES = "CASE WHEN i = 0 THEN 1 ELSE 0 END", "CASE WHEN i = n - 1 THEN 0 ELSE 1 END", "CASE WHEN i < n div 2 THEN 1 ELSE 0 END"


@report(REORDERED.format(place=HEAD, moved="i = 0"))
def moved_head(spark, d):
    """The first row moved to the end: it alone has moved."""
    return _reordered(spark, d, HEAD, True)


@report(REORDERED.format(place=HEAD, moved="i = 0"))
def moved_head_positional(spark, d):
    return _reordered(spark, d, HEAD, False)


@report(REORDERED.format(place=TAIL, moved="i = n - 1"))
def moved_tail(spark, d):
    """The last row moved to the front."""
    return _reordered(spark, d, TAIL, False)


@report(REORDERED.format(place=HALVES.replace("div", "//"), moved="""(i >= n // 2) =
  ((SELECT count(*) FROM x WHERE NOT changed AND i < n // 2) >= (SELECT count(*) FROM x WHERE NOT changed AND i >= n // 2))"""))
def swapped_halves(spark, d):
    """The halves swapped: the one with fewer equal rows has moved."""
    return _reordered(spark, d, HALVES, True)


@report(BY_NATION + ROWS)
def table_changes_ordered(spark, d):
    pair = F.col("c_nationkey")
    deltas, _ = diff.diff(left_rows(customers(spark, d), pair), right_rows(customers(spark, d), pair), width=5)
    return _flat(deltas)


def nation_files(rows, side):
    """One delimited text per nation from its rows."""
    line = tables.csv_line(F.col("cells"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("l")))), lambda r: r["l"]), "\n")
    files = rows.groupBy("pair_id").agg(F.concat(F.lit(",".join(COLUMNS) + "\n"), body).alias("content"), F.count(F.lit(1)).alias("rows"))
    name = F.concat("pair_id", F.lit(".csv"))
    return files.select(
        F.col("pair_id").cast("long").alias("artifact_id"), F.concat(F.lit(f"{side}/"), name).alias("logical_path"), name.alias("filename"),
        F.lit("N").alias("group"), "rows", F.lit(5).alias("cols"), "content", align.fingerprint(F.col("content")).alias("sha256"),
    )


@report(BY_NATION + "SELECT pair_id, kind, row_a, row_b FROM d")
def file_deltas(spark, d):
    """Two folders of nation files: compared as files, then those that differ row by row."""
    pair = F.col("c_nationkey")
    a, b = (nation_files(f(customers(spark, d), pair), s) for f, s in ((left_rows, "left"), (right_rows, "right")))
    deltas, _ = drilldown.file_deltas(align.compare_files(a, b), a, b)
    name = F.get_json_object("pair_id", "$.filename")
    return deltas.select(F.substring_index(name, ".", 1).alias("pair_id"), "kind", "row_a", "row_b")


BRANCHES = DIFF.format(pair="nk::VARCHAR", source=CUSTOMERS.replace("c_name nm", "c_name || ', \"Branch\"' || chr(10) || c_nationkey nm"))


def branches(spark, d):
    """Customers whose names hold a separator, quotes and a line break."""
    return customers(spark, d).withColumn("c_name", F.concat("c_name", F.lit(', "Branch"\n'), F.col("c_nationkey").cast("string")))


@report(BRANCHES + "SELECT pair_id, kind, row_a, row_b FROM d")
def quoted_file_deltas(spark, d):
    """Nation files with quoted separators, quotes and line breaks, compared as files and then row by row."""
    pair = F.col("c_nationkey")
    a, b = (nation_files(f(branches(spark, d), pair), s) for f, s in ((left_rows, "left"), (right_rows, "right")))
    deltas, _ = drilldown.file_deltas(align.compare_files(a, b), a, b)
    name = F.get_json_object("pair_id", "$.filename")
    return deltas.select(F.substring_index(name, ".", 1).alias("pair_id"), "kind", "row_a", "row_b")


def _zipped(batches):
    """One archive per row of files, each under its name."""
    for pdf in batches:
        blobs = []
        for names, texts_ in zip(pdf["names"], pdf["texts"]):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                for n, t in zip(names, texts_):
                    z.writestr(n, t)
            blobs.append(buf.getvalue())
        yield pd.DataFrame({"path": pdf["path"], "content": blobs})


def nation_archives(rows, side):
    """An archive for each nation with its table as a delimited and as a markup file."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    fields = [F.concat(F.lit(f"<{c}>"), escaped(F.get("cells", F.lit(i))), F.lit(f"</{c}>")) for i, c in enumerate(COLUMNS)]
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", c.alias("l")))), lambda r: r["l"]), "\n")
    plain = F.concat(F.lit(",".join(COLUMNS) + "\n"), ordered(tables.csv_line(F.col("cells"))))
    marked = F.concat(F.lit("<list>"), ordered(F.concat(F.lit("<row>"), *fields, F.lit("</row>"))), F.lit("</list>"))
    files = rows.groupBy("pair_id").agg(F.array(plain, marked).alias("texts"))
    names = F.array(F.concat(F.lit("tables/"), "pair_id", F.lit(".csv")), F.concat(F.lit("records/"), "pair_id", F.lit(".xml")))
    files = files.select(F.concat(F.lit(f"{side}/N_"), "pair_id", F.lit(".zip")).alias("path"), names.alias("names"), "texts")
    return files.mapInPandas(_zipped, "path string, content binary")


@report(BY_NATION + "SELECT pair_id || e AS filename, kind, row_a, row_b FROM d, (VALUES ('.csv'), ('.xml')) x(e)")
def archive_deltas(spark, d):
    """Two folders of archives: opened, markup turned into tables, compared as files, and those that differ row by row."""
    pair = F.col("c_nationkey")
    sides_ = []
    for f, s in ((left_rows, "left"), (right_rows, "right")):
        files = drilldown.archive_tables(nation_archives(f(customers(spark, d), pair), s))
        path = F.concat_ws("/", F.lit(s), "archive", "path")
        number = F.regexp_extract("filename", "^([0-9]+)", 1).cast("long") * 2 + F.when(F.col("filename").endswith("xml"), 1).otherwise(0)
        sides_.append(pin(align.artifacts(files.withColumn("id", number), "id", path, "content", F.col("group"))))
    deltas, _ = drilldown.file_deltas(align.compare_files(*sides_), *sides_)
    return deltas.select(F.get_json_object("pair_id", "$.filename").alias("filename"), "kind", "row_a", "row_b")


@report(BY_NATION + """
SELECT pair_id, (SELECT count(*) FROM eq WHERE eq.pair_id = x.pair_id) AS equal, (SELECT count(*) FROM d WHERE d.pair_id = x.pair_id AND kind = 'MODIFIED') AS modified,
 (SELECT count(*) FROM d WHERE d.pair_id = x.pair_id AND kind = 'REMOVED') AS removed, (SELECT count(*) FROM d WHERE d.pair_id = x.pair_id AND kind = 'ADDED') AS added,
 (SELECT count(*) FROM pr WHERE pr.pair_id = x.pair_id AND ca = cb) AS pad_only FROM (SELECT DISTINCT pair_id FROM h) x
""")
def change_counts(spark, d):
    pair = F.col("c_nationkey")
    return diff.diff(left_rows(customers(spark, d), pair), right_rows(customers(spark, d), pair), width=5)[1]


@report(DIFF.format(pair="'table'", source=ORDERS) + """
SELECT (SELECT count(*) FROM eq) AS equal, (SELECT count(*) FROM d WHERE kind = 'MODIFIED') AS modified, (SELECT count(*) FROM d WHERE kind = 'REMOVED') AS removed,
 (SELECT count(*) FROM d WHERE kind = 'ADDED') AS added, (SELECT count(*) FROM pr WHERE ca = cb) AS pad_only""")
def order_change_counts(spark, d):
    a = orders_alike(spark, d)
    return diff.diff(left_rows(a), right_rows(a), width=5)[1].drop("pair_id")


@report(WHOLE + """, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(row_a, row_b), row_a IS NULL, row_b) AS rn, count(*) OVER (PARTITION BY pair_id) AS n FROM d)
SELECT pair_id, kind, row_a, row_b, rn, n > 40 AS truncated FROM r WHERE rn <= 40""")
def first_changes(spark, d):
    deltas, _ = diff.diff(left_rows(customers(spark, d)), right_rows(customers(spark, d)), width=5)
    out = diff.first_deltas(deltas, 40).select("pair_id", "kind", "row_a", "row_b", F.col("rn").cast("long").alias("rn"), "truncated")
    return out


@report(WHOLE + """
, pos AS (SELECT pair_id, k, a.idx AS ia, b.idx AS ib, a.cells AS ca, b.cells AS cb FROM
  (SELECT *, row_number() OVER (PARTITION BY pair_id, blk ORDER BY idx) AS k FROM oa) a JOIN (SELECT *, row_number() OVER (PARTITION BY pair_id, blk ORDER BY idx) AS k FROM ob) b USING (pair_id, blk, k))
SELECT (SELECT count(*) FROM eq) AS equal, (SELECT count(*) FROM pos WHERE ca <> cb) AS modified, (SELECT count(*) FROM oa) - (SELECT count(*) FROM pos) AS removed,
  (SELECT count(*) FROM ob) - (SELECT count(*) FROM pos) AS added""")
def positional_counts(spark, d):
    _, stats = diff.diff(left_rows(customers(spark, d)), right_rows(customers(spark, d)), similarity_pairing=False, width=5)
    return stats.select("equal", "modified", "removed", "added")


@report(WHOLE + """
SELECT pair_id, kind, row_a, row_b, ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'][i] AS "column", ca[i] AS old_value, cb[i] AS new_value
FROM d, range(1, 6) t(i) WHERE ca[i] IS DISTINCT FROM cb[i]""")
def cell_report(spark, d):
    deltas, _ = diff.diff(left_rows(customers(spark, d)), right_rows(customers(spark, d)), width=5)
    return diff.cell_changes(deltas, COLUMNS)


@report(WHOLE + """
SELECT 'a' AS side, kind, row_a, row_b, ra.cells[2] AS c_name, ra.cells[4] AS c_acctbal FROM d JOIN ra ON ra.ord = d.row_a WHERE kind <> 'ADDED'
UNION ALL SELECT 'b', kind, row_a, row_b, rb.cells[2], rb.cells[4] FROM d JOIN (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS idx FROM rb) rb ON rb.idx = d.row_b WHERE kind <> 'REMOVED'""")
def side_by_side(spark, d):
    a, b = left_rows(customers(spark, d)), right_rows(customers(spark, d))
    deltas, _ = diff.diff(a, b, width=5)
    fa, fb = diff.side_frames(deltas, a, b, COLUMNS)
    cols = ["kind", "row_a", "row_b", "c_name", "c_acctbal"]
    return fa.select(F.lit("a").alias("side"), *cols).unionByName(fb.select(F.lit("b").alias("side"), *cols))


@report("SELECT s_nationkey::VARCHAR AS pair_id, 'REMOVED' AS kind, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS row_a, s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def removed_tables(spark, d):
    rows = diff.table_rows(table(spark, d, "supplier"), ["s_suppkey", "s_name"], F.col("s_nationkey"), order=["s_suppkey"])
    return diff.one_sided(rows, "a", ["s_suppkey", "s_name"]).drop("row_b")


@report(r"""
WITH n AS (SELECT c_custkey, sha1(concat_ws(chr(31), c_custkey::VARCHAR, c_name, c_mktsegment)) AS row_hash,
  list_distinct(regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[A-Za-z0-9_./\-]{2,64}')) AS x,
  list_distinct(regexp_extract_all(lower(c_mktsegment || ' customer ' || c_nationkey), '[A-Za-z0-9_./\-]{2,64}')) AS y FROM customer)
SELECT c_custkey, row_hash, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 6) AS similarity FROM n""")
def row_hashes(spark, d):
    x = text.token_set(F.concat_ws(" ", "c_name", "c_mktsegment"))
    y = text.token_set(F.concat(F.col("c_mktsegment"), F.lit(" customer "), F.col("c_nationkey").cast("string")))
    cells = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.concat(F.col("c_mktsegment"), F.lit("  ")))
    return table(spark, d, "customer").select(
        "c_custkey", diff.row_hash(cells).alias("row_hash"), F.round(text.jaccard(x, y), 6).alias("similarity")
    )


# --- collections of files ---------------------------------------------------

def sides(spark, d):
    docs = texts(spark, d)
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"), F.concat("source", F.lit(".csv")))
    both = align.artifacts(docs, "doc_id", path, "text", F.col("lang")).withColumn("side", F.col("artifact_id") % 2)
    return both.filter("side = 0").drop("side"), both.filter("side = 1").drop("side")


FILES = r"""
WITH RECURSIVE
f AS (SELECT doc_id, doc_id % 2 AS side, lang AS grp, source || '.csv' AS fn, lang || '/' || doc_id || '/' || source || '.csv' AS path, text, sha256(text) AS sha,
        len(string_split(text, chr(10))) - 1 AS rws, len(string_split(string_split(text, chr(10))[1], ','))::INT AS cls FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY side, grp, fn, sha ORDER BY doc_id) AS occ FROM f),
ex AS (SELECT a.doc_id AS ia, b.doc_id AS ib FROM o a JOIN o b ON a.side = 0 AND b.side = 1 AND a.grp = b.grp AND a.fn = b.fn AND a.sha = b.sha AND a.occ = b.occ),
ra AS (SELECT * FROM f WHERE side = 0 AND doc_id NOT IN (SELECT ia FROM ex)), rb AS (SELECT * FROM f WHERE side = 1 AND doc_id NOT IN (SELECT ib FROM ex)),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_./\-]{2,64}')) AS term FROM f) GROUP BY 1, 2),
nm AS (SELECT doc_id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM t GROUP BY 1),
pp AS (SELECT a.doc_id AS ia, b.doc_id AS ib, a.grp || '/' || a.fn AS bk FROM ra a JOIN rb b ON a.grp = b.grp AND a.fn = b.fn),
dt AS (SELECT pp.ia, pp.ib, sum(x.tf * y.tf)::DOUBLE AS dot FROM pp JOIN t x ON x.doc_id = pp.ia JOIN t y ON y.doc_id = pp.ib AND y.term = x.term GROUP BY 1, 2),
sm AS (SELECT pp.bk, pp.ia, pp.ib, coalesce(dt.dot / (na.norm * nb.norm), 0) AS s FROM pp LEFT JOIN dt ON dt.ia = pp.ia AND dt.ib = pp.ib
       LEFT JOIN nm na ON na.doc_id = pp.ia LEFT JOIN nm nb ON nb.doc_id = pp.ib),
rk AS (SELECT *, row_number() OVER (PARTITION BY bk ORDER BY s DESC, ia, ib) AS rk FROM sm),
gr AS (SELECT bk, 0::BIGINT AS rk, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::BIGINT AS ia, NULL::BIGINT AS ib FROM rk GROUP BY bk
       UNION ALL SELECT g.bk, r.rk, CASE WHEN list_contains(g.ua, r.ia) OR list_contains(g.ub, r.ib) THEN g.ua ELSE list_append(g.ua, r.ia) END,
         CASE WHEN list_contains(g.ua, r.ia) OR list_contains(g.ub, r.ib) THEN g.ub ELSE list_append(g.ub, r.ib) END,
         CASE WHEN list_contains(g.ua, r.ia) OR list_contains(g.ub, r.ib) THEN NULL ELSE r.ia END, r.ib
       FROM gr g JOIN rk r ON r.bk = g.bk AND r.rk = g.rk + 1),
pr AS (SELECT ia, ib, 1.0::DOUBLE AS s FROM ex UNION ALL SELECT r.ia, r.ib, r.s FROM gr JOIN rk r ON r.bk = gr.bk AND r.rk = gr.rk WHERE gr.ia IS NOT NULL)
"""


@report(FILES + """
SELECT a.grp AS "group", a.fn AS filename, CASE WHEN a.sha = b.sha THEN 'SAME' ELSE 'MODIFIED' END AS status, round(CASE WHEN a.sha = b.sha THEN 1.0 ELSE s END, 6) AS similarity,
  a.rws AS rows_a, b.rws AS rows_b, a.cls AS cols_a, b.cls AS cols_b, a.path AS path_a, b.path AS path_b FROM pr JOIN f a ON a.doc_id = ia JOIN f b ON b.doc_id = ib
UNION ALL SELECT grp, fn, 'REMOVED', 0.0, rws, 0, cls, 0, path, '' FROM ra WHERE doc_id NOT IN (SELECT ia FROM pr)
UNION ALL SELECT grp, fn, 'ADDED', 0.0, 0, rws, 0, cls, '', path FROM rb WHERE doc_id NOT IN (SELECT ib FROM pr)""")
def file_changes(spark, d):
    out = align.compare_files(*sides(spark, d))
    return out.withColumn("similarity", F.round("similarity", 6)).drop("sha_a", "sha_b", "message")


@report("""
WITH k AS (SELECT source, text, doc_id % 2 AS side, row_number() OVER (PARTITION BY doc_id % 2, lang, sha256(text) ORDER BY doc_id) AS n, lang, doc_id FROM documents)
SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM k a JOIN k b ON a.side = 0 AND b.side = 1 AND a.lang = b.lang AND sha256(a.text) = sha256(b.text) AND a.n = b.n""")
def identical_files(spark, d):
    a, b = sides(spark, d)
    return align.match_exact(a.withColumn("bucket", F.col("group")), b.withColumn("bucket", F.col("group"))).select("id_a", "id_b")


@report("""
SELECT lang AS "group", source || '.csv' AS filename, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_a, count(*) FILTER (WHERE doc_id % 2 = 1) AS n_b FROM documents GROUP BY 1, 2""")
def aligned_keys(spark, d):
    return align.align(*sides(spark, d))


@report("""
WITH a AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), b AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
x AS (SELECT 'folder' AS kind, lang || '/' || source AS name, count(*) AS n, 0 AS m FROM a GROUP BY 2 UNION ALL SELECT 'folder', lang || '/' || source, 0, count(*) FROM b GROUP BY 2
  UNION ALL SELECT 'group', lang, count(*), 0 FROM a GROUP BY 2 UNION ALL SELECT 'group', lang, 0, count(*) FROM b GROUP BY 2)
SELECT kind, name, sum(n)::BIGINT AS count_a, sum(m)::BIGINT AS count_b, (sum(m) - sum(n))::BIGINT AS delta FROM x GROUP BY 1, 2 HAVING sum(n) <> sum(m)""")
def structure_changes(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("group"), F.concat_ws("/", "lang", "source", "doc_id").alias("logical_path")
    )
    ids = table(spark, d, "labels").select("doc_id")
    a, b = docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti")
    folders = align.folder_changes(a, b).withColumnRenamed("folder", "name").withColumn("kind", F.lit("folder"))
    groups = align.group_changes(a, b).withColumnRenamed("group", "name").withColumn("kind", F.lit("group"))
    return folders.unionByName(groups)


@report("""
SELECT o_orderkey AS key, 'REMOVED' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT p_partkey + 100000000, 'ADDED' FROM part""")
def unmatched_keys(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    extra = table(spark, d, "part").select((F.col("p_partkey") + 100_000_000).alias("key"))
    a, b = dealt("key", a, b.unionByName(extra))
    return align.unmatched(a, b.distinct(), "key")


@report("""SELECT doc_id, sha256(text) AS sha256, len(string_split(text, chr(10))) - 1 AS rows, source || '__' || substr(sha1(lang || '/' || source || '.csv'), 1, 16) AS stub FROM documents""")
def file_artifacts(spark, d):
    path = F.concat("lang", F.lit("/"), "source", F.lit(".csv"))
    return align.artifacts(texts(spark, d), "doc_id", path, "text").select(F.col("artifact_id").alias("doc_id"), "sha256", "rows", "stub")


@report("""
WITH l AS (SELECT c_nationkey AS k, c_custkey // 64 AS b, sha256(c_name || c_mktsegment) AS h, c_custkey AS i FROM customer),
l1 AS (SELECT k, b, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l GROUP BY k, b), l2 AS (SELECT k, b // 64 AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM l1 GROUP BY k, b // 64),
l3 AS (SELECT k, b // 64 AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM l2 GROUP BY k, b // 64)
SELECT k AS c_nationkey, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM l3 GROUP BY k""")
def table_fingerprints(spark, d):
    return align.table_fingerprint(table(spark, d, "customer"), "c_nationkey", "c_custkey", F.concat("c_name", "c_mktsegment"), fan_out=64)


TERMS = r"WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_./\-]{2,64}')) AS term FROM documents) GROUP BY 1, 2)"


@report(TERMS + " SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, round(sqrt(sum(tf * tf)::DOUBLE), 6) AS norm FROM t GROUP BY doc_id")
def term_vectors(spark, d):
    terms = align.term_counts(texts(spark, d), "doc_id", "text")
    sums = terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))
    return sums.join(align.vector_norms(terms, "doc_id"), "doc_id").withColumn("norm", F.round("norm", 6))


@report(TERMS + """, p AS (SELECT doc_id AS id_a, doc_id + 1 AS id_b FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), n AS (SELECT doc_id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM t GROUP BY 1),
 dt AS (SELECT p.id_a, p.id_b, sum(x.tf * y.tf)::DOUBLE AS dot FROM p JOIN t x ON x.doc_id = id_a JOIN t y ON y.doc_id = id_b AND y.term = x.term GROUP BY 1, 2)
SELECT p.id_a, p.id_b, round(coalesce(dot / (a.norm * b.norm), 0), 6) AS similarity FROM p LEFT JOIN dt ON dt.id_a = p.id_a AND dt.id_b = p.id_b LEFT JOIN n a ON a.doc_id = p.id_a LEFT JOIN n b ON b.doc_id = p.id_b""")
def neighbour_cosines(spark, d):
    docs = texts(spark, d)
    ids = docs.select(F.col("doc_id").alias("id_a"), (F.col("doc_id") + 1).alias("id_b"))
    pairs = ids.join(docs.select(F.col("doc_id").alias("id_b")), "id_b", "left_semi")
    return align.cosine(align.term_counts(docs, "doc_id", "text"), pairs, "doc_id").withColumn("similarity", F.round("similarity", 6))


# --- reports on a list of changes -------------------------------------------

CHANGES = """WITH x AS (SELECT o_orderkey, o_orderpriority AS "group", 'F' || o_custkey || '.csv' AS filename,
 CASE WHEN o_orderstatus = 'F' THEN 'SAME' WHEN o_orderstatus = 'P' THEN 'ADDED' WHEN o_custkey % 2 = 0 THEN 'MODIFIED' ELSE 'REMOVED' END AS status FROM orders)"""


def changes(spark, d):
    status = F.expr("CASE WHEN o_orderstatus = 'F' THEN 'SAME' WHEN o_orderstatus = 'P' THEN 'ADDED' WHEN o_custkey % 2 = 0 THEN 'MODIFIED' ELSE 'REMOVED' END")
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("group"), F.concat(F.lit("F"), "o_custkey", F.lit(".csv")).alias("filename"), status.alias("status")
    )


N = "count(*) FILTER (WHERE status = '{}') AS {}"
COUNTS = ", ".join(N.format(s, s.lower()) for s in ("SAME", "MODIFIED", "ADDED", "REMOVED"))


@report(CHANGES + f" SELECT {COUNTS}, count(*) AS total_files, round(count(*) FILTER (WHERE status = 'SAME') / count(*)::DOUBLE * 100, 6) AS overall_similarity FROM x")
def change_summary(spark, d):
    return align.compare_summary(changes(spark, d)).withColumn("overall_similarity", F.round("overall_similarity", 6))


@report(CHANGES + """ SELECT 2 * count(*) FILTER (WHERE status IN ('SAME', 'MODIFIED')) + count(*) FILTER (WHERE status IN ('ADDED', 'REMOVED')) AS total_files,
 count(*) FILTER (WHERE status IN ('SAME', 'MODIFIED')) AS matched_files, round(count(*) FILTER (WHERE status = 'SAME') / count(*)::DOUBLE, 6) AS average_similarity FROM x""")
def session_summary(spark, d):
    return align.session_summary(changes(spark, d)).withColumn("average_similarity", F.round("average_similarity", 6))


@report(CHANGES + f' SELECT "group" AS name, {COUNTS}, count(*) AS total FROM x GROUP BY 1')
def status_matrix(spark, d):
    return align.status_by_group(changes(spark, d))


@report(CHANGES + """ SELECT o_orderkey, status FROM x WHERE status IN ('ADDED', 'REMOVED') AND status IN ('ADDED', 'MODIFIED') AND (contains(lower("group"), 'f1') OR contains(lower(filename), 'f1'))""")
def filtered_changes(spark, d):
    return align.filter_changes(changes(spark, d), "ADDED_REMOVED", ["ADDED", "MODIFIED"], "F1").select("o_orderkey", "status")


@report(CHANGES + """ SELECT "group" || '/' || filename AS path, filename AS name, false AS is_folder, 1 AS depth, status, "group" || ' > ' || lower(filename) AS path_order FROM x
 UNION ALL SELECT DISTINCT "group", "group", true, 0, NULL, "group" FROM x""")
def change_tree(spark, d):
    return align.folder_tree(changes(spark, d)).withColumn("path_order", F.replace("path_order", F.lit("\x00"), F.lit(" > ")))

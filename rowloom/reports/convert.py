"""Sources, archives, markup and names."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from rowloom.functions import display, naming, text
from rowloom.operators import catalog, lookups
from rowloom.reports.registry import report, table, texts
from rowloom.session import scratch_path, spread
from rowloom.sources import archives, markup, tables

# Expressions that read the same in both SQL dialects.
ORDER_DOC = """concat('<batch id="', cast(o_custkey as string), '"><order key="', cast(o_orderkey as string), '" pri="', o_orderpriority,
 '"><status>', o_orderstatus, '</status><note>first</note><note>', cast(o_custkey as string), '</note><total cur="USD">',
 cast(cast(o_totalprice as decimal(18,2)) as string), '</total><empty/></order><order key="-', cast(o_orderkey as string),
 '"><status>x</status></order></batch>')"""
LIST_DOC = """concat('<list>', repeat('<item><v>1</v></item>', cast(4 + o_custkey % 5 as int)), repeat('<row/>', cast(4 + o_orderkey % 7 as int)), '</list>')"""
TASK_ROWS = 50_000  # documents or archives of a task


def order_docs(spark, d):
    return spread(table(spark, d, "orders"), TASK_ROWS).select("o_orderkey", F.expr(ORDER_DOC).alias("content"))


def list_docs(spark, d):
    return spread(table(spark, d, "orders"), TASK_ROWS).select("o_orderkey", F.expr(LIST_DOC).alias("content"))


@report("""
WITH e AS (SELECT doc_id, n_chars AS size, 1 + n_chars // (1 + doc_id % 300) AS packed FROM documents),
k AS (SELECT * FROM e WHERE size / packed <= 200),
r AS (SELECT doc_id, size, row_number() OVER (ORDER BY doc_id) AS n, sum(size) OVER (ORDER BY doc_id) AS s FROM k)
SELECT doc_id, size FROM r WHERE s <= 1000000 AND n <= 20000
""")
def archive_budget(spark, d):
    entries = table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").alias("size"), F.expr("1 + n_chars div (1 + doc_id % 300)").alias("packed")
    )
    kept = archives.budget(entries, "doc_id", "size", "packed", max_bytes=1_000_000, max_files=20_000, max_ratio=200, block=F.expr("doc_id div 1000"))
    return kept.select("doc_id", "size")


@report("""
WITH f AS (SELECT lang AS "group", source || '_' || doc_id AS filename, n_chars || ':' || doc_id AS file_sig, doc_id FROM documents),
s AS (SELECT f."group", f.filename, f.file_sig || (CASE WHEN toxic = 1 THEN 'x' ELSE '' END) AS file_sig, quality = 1 AS completed
      FROM f JOIN labels USING (doc_id))
SELECT doc_id, filename FROM f WHERE NOT EXISTS (
  SELECT 1 FROM s WHERE s.completed AND s."group" = f."group" AND s.filename = f.filename AND s.file_sig = f.file_sig)
""")
def unchanged_files(spark, d):
    files = table(spark, d, "documents").select(
        F.col("lang").alias("group"),
        F.concat_ws("_", "source", "doc_id").alias("filename"),
        F.concat_ws(":", "n_chars", "doc_id").alias("file_sig"),
        "doc_id",
    )
    state = files.join(table(spark, d, "labels"), "doc_id").select(
        "group", "filename",
        F.concat("file_sig", F.when(F.col("toxic") == 1, "x").otherwise("")).alias("file_sig"),
        (F.col("quality") == 1).alias("completed"),
    )
    return archives.unchanged_filter(files, state).select("doc_id", "filename")


@report("SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM documents")
def decoded_texts(spark, d):
    docs = texts(spark, d)
    coded = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "ISO-8859-1")).otherwise(
        F.encode(F.concat(F.lit("\ufeff"), F.col("text")), "UTF-8")
    )
    t = archives.decode_text(coded)
    return docs.select("doc_id", F.sha2(t, 256).alias("digest"), F.length(t).cast("long").alias("chars"))


@report("""
SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_type, p_size::VARCHAR AS p_size,
       p_retailprice::DECIMAL(18,2)::VARCHAR AS p_retailprice, p_brand FROM part
""")
def csv_round_trip(spark, d):
    out = scratch_path(spark, "tables")
    part = table(spark, d, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18,2)"))
    tables.write_tables(part, out, by="p_brand")
    return tables.read_table(spark, out, multiline=False).drop("file", "row_idx")


@report("""
WITH c AS (SELECT c_nationkey AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, c_custkey AS k, 'x, ' || c_name AS a, '"' || c_mktsegment || '"' AS b FROM customer),
h AS (SELECT t, min(CASE WHEN k % 3 = 0 THEN n END) AS na, min(CASE WHEN k % 5 = 0 THEN n END) AS nb FROM c GROUP BY t),
o AS (SELECT t, list_filter(CASE WHEN nb < na OR na IS NULL THEN ['id', CASE WHEN nb IS NOT NULL THEN 'b' END, CASE WHEN na IS NOT NULL THEN 'a' END]
  ELSE ['id', CASE WHEN na IS NOT NULL THEN 'a' END, CASE WHEN nb IS NOT NULL THEN 'b' END] END, lambda x: x IS NOT NULL) AS hd FROM h)
SELECT t::VARCHAR AS nation, array_to_string(hd, '|') AS header, array_to_string([CASE x WHEN 'id' THEN k::VARCHAR WHEN 'a' THEN CASE WHEN k % 3 = 0 THEN a ELSE '' END
  ELSE CASE WHEN k % 5 = 0 THEN b ELSE '' END END FOR x IN hd], '|') AS cells FROM c JOIN o USING (t)
""")
def converted_tables(spark, d):
    """One markup document a nation, its ragged records written as a table under its own header, in parts, and read back."""
    recs = markup.records(markup.flatten(nation_docs(spark, d), ["nation"]))
    out = scratch_path(spark, "converted")
    tables.write_ragged(recs, markup.header_of(recs, ["nation"]), out, "nation", part_rows=50)
    got = tables.read_collection(spark, out)
    return got.select(F.regexp_extract("file", "nation=([0-9]+)/", 1).alias("nation"), F.array_join("header", "|").alias("header"), F.array_join("cells", "|").alias("cells"))


@report("""
SELECT c_nationkey::VARCHAR AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS record_idx, c_custkey::VARCHAR AS id,
  CASE WHEN c_custkey % 3 = 0 THEN 'x, ' || c_name ELSE '' END AS a, CASE WHEN c_custkey % 5 = 0 THEN '"' || c_mktsegment || '"' ELSE '' END AS b FROM customer
""")
def split_documents(spark, d):
    """The documents of all nations as files, their records read in splits behind each closing tag."""
    out = scratch_path(spark, "documents")
    nation_docs(spark, d).write.partitionBy("nation").text(out)
    recs = markup.read_records(spark, out, "r").withColumn("nation", F.regexp_extract("file", "nation=([0-9]+)/", 1))
    return markup.to_wide(recs, ["id", "a", "b"], ["nation"])


def nation_docs(spark, d):
    """One markup document a nation with a record for each customer."""
    k = F.col("c_custkey")
    record = F.concat(
        F.lit("<r><id>"), k.cast("string"), F.lit("</id>"),
        F.when(k % 3 == 0, F.concat(F.lit("<a>x, "), "c_name", F.lit("</a>"))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit('<b>"'), "c_mktsegment", F.lit('"</b>'))).otherwise(""), F.lit("</r>"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", record.alias("r")))), lambda x: x["r"]), "")
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("nation")).agg(F.concat(F.lit("<list>"), body, F.lit("</list>")).alias("content"))


@report("""
SELECT '"' || c_custkey || '","' || replace(c_name || ' "' || c_mktsegment || '"', '"', '""') || '",""' AS line FROM customer
""")
def quoted_report(spark, d):
    out = scratch_path(spark, "report")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('"')).alias("label"), F.lit(None).cast("string").alias("note")
    )
    tables.write_report(rows, out)
    return spark.read.text(out).select(F.col("value").alias("line")).filter(~F.col("line").startswith('"c_custkey"'))


@report("""
SELECT count(*) AS rows, 4 AS columns, sum(c_custkey)::BIGINT AS keys, max(c_custkey || '|' || c_name || '|' || c_nationkey || '|') AS last_line
FROM customer
""")
def table_collection(spark, d):
    out = scratch_path(spark, "collection")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit("").alias("note"), "c_mktsegment")
    tables.write_tables(rows, out, by="c_mktsegment")
    got = tables.read_collection(spark, out, multiline=False)
    return got.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("header")).alias("columns"),
        F.sum(F.get("cells", F.lit(0)).cast("long")).alias("keys"),
        F.max(F.array_join("cells", "|")).alias("last_line"),
    )


def _pack(batches):
    """Archives with a nested batch archive and a numbered one in a folder."""
    def zipped(entries):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
        return buf.getvalue()

    for pdf in batches:
        yield pd.DataFrame(
            {
                "path": pdf.path,
                "content": [
                    zipped(
                        [
                            ("a.xml", t),
                            ("inner/2_BATCH.zip", zipped([("b.XML", t + "b"), ("skip.txt", "-")])),
                            ("data/12_sub.zip", zipped([("G/c.xml", t + "cc"), ("_hidden/h.xml", "-")])),
                        ]
                    )
                    for t in pdf.name
                ],
            }
        )


ENTRIES = """
WITH z AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey % 5 = 0 THEN 'All_20260113_055727.zip' ELSE c_mktsegment || '_' || c_nationkey || '.zip' END AS zip FROM customer),
g AS (SELECT *, CASE WHEN zip LIKE 'All%' THEN NULL ELSE upper(replace(zip, '.zip', '')) END AS own FROM z)
SELECT c_custkey || '/' || zip AS archive, 'a.xml' AS path, coalesce(own, 'ROOT') AS "group", zip AS chain, length(c_name)::BIGINT AS size FROM g
UNION ALL
SELECT c_custkey || '/' || zip, '_nested_1_2_BATCH/b.XML', coalesce(own, 'ROOT'), zip || '>inner>2_BATCH.zip', length(c_name)::BIGINT + 1 FROM g
UNION ALL
SELECT c_custkey || '/' || zip, '_nested_1_12_sub/G/c.xml', coalesce(own, 'SUB'), zip || '>data>12_sub.zip>G', length(c_name)::BIGINT + 2 FROM g
"""


def packed_customers(spark, d):
    name = F.when(F.col("c_nationkey") % 5 == 0, F.lit("All_20260113_055727.zip")).otherwise(
        F.concat("c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".zip"))
    )
    src = spread(table(spark, d, "customer"), TASK_ROWS).select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("/"), name).alias("path"), F.col("c_name").alias("name")
    )
    return src.mapInPandas(_pack, "path string, content binary")


def _shown(entries):
    return archives.inventory(entries).select("archive", "path", "group", F.array_join("zip_chain", ">").alias("chain"), "size")


@report(ENTRIES)
def archive_entries(spark, d):
    return _shown(archives.expand_archives(packed_customers(spark, d)))


@report(ENTRIES)
def spread_entries(spark, d):
    """The same archives, each entry unpacked in a task of its own, nested archives in a second round."""
    return _shown(archives.spread_archives(packed_customers(spark, d)))


@report(f"""
WITH o AS (SELECT * FROM orders)
SELECT o_orderkey, 0::BIGINT AS record_idx, 'AUTO:order' AS record_tag, f.field, f.value FROM o, LATERAL (VALUES
  ('status', o_orderstatus), ('note[2]', 'first'), ('note', o_custkey::VARCHAR), ('total@cur', 'USD'),
  ('total', o_totalprice::DECIMAL(18,2)::VARCHAR), ('empty', '')) f(field, value)
UNION ALL SELECT o_orderkey, 1, 'AUTO:order', 'status', 'x' FROM o
""")
def flat_records(spark, d):
    recs = markup.records(markup.flatten(order_docs(spark, d), ["o_orderkey"]))
    return recs.select("o_orderkey", "record_idx", "record_tag", F.explode("fields").alias("field", "value"))


@report("""
SELECT o_orderkey, f.col AS "column", f.position FROM orders, (VALUES
  ('status', 1), ('note[2]', 2), ('note', 3), ('total@cur', 4), ('total', 5), ('empty', 6)) f(col, position)
""")
def record_headers(spark, d):
    recs = markup.records(markup.flatten(order_docs(spark, d), ["o_orderkey"]))
    return markup.header_of(recs, ["o_orderkey"])


@report("""
SELECT o_orderkey, 0::BIGINT AS record_idx, o_orderstatus AS status, 'first' AS "note[2]", o_custkey::VARCHAR AS note,
       o_totalprice::DECIMAL(18,2)::VARCHAR AS total FROM orders
UNION ALL SELECT o_orderkey, 1, 'x', '', '', '' FROM orders
""")
def wide_records(spark, d):
    recs = markup.records(markup.flatten(order_docs(spark, d), ["o_orderkey"]))
    return markup.to_wide(recs, ["status", "note[2]", "note", "total"], ["o_orderkey"])


def _outcomes(spark, d):
    docs = order_docs(spark, d).select(F.concat(F.lit("order/"), "o_orderkey").alias("path"), F.lit("ORDER").alias("group"), "content")
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("page/"), "page_id").alias("path"), F.lit("PAGE").alias("group"), F.col("html").alias("content")
    )
    labels = table(spark, d, "labels").select(
        F.concat(F.lit("label/"), "doc_id").alias("path"), F.lit("LABEL").alias("group"), F.lit("<a/>").alias("content")
    )
    inventory = docs.unionByName(pages).unionByName(labels)
    done = markup.outcomes(markup.convert(inventory, ["ORDER", "PAGE"]))
    skipped = inventory.filter(~F.col("group").isin("ORDER", "PAGE")).select(
        "path", "group", F.lit(0).cast("long").alias("rows"), F.lit(0).alias("columns"),
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("success"), F.lit(True).alias("skipped"),
    )
    return done.withColumn("skipped", F.lit(False)).unionByName(skipped)


@report("""
SELECT 'order/' || o_orderkey AS path, 'ORDER' AS "group", true AS success, 2::BIGINT AS rows, 6 AS columns, NULL::VARCHAR AS error FROM orders
UNION ALL SELECT 'page/' || page_id, 'PAGE', false, 0, 0, 'No records found in XML' FROM pages
""")
def conversion_outcomes(spark, d):
    return _outcomes(spark, d).filter(~F.col("skipped")).select("path", "group", "success", "rows", "columns", "error")


@report("""
SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM labels) AS total_files,
       (SELECT count(*) FROM orders) AS success, (SELECT count(*) FROM pages) AS failed, (SELECT count(*) FROM labels) AS skipped,
       2 * (SELECT count(*) FROM orders) AS total_rows,
       round(((SELECT count(*) FROM orders) * 0.5 + (SELECT count(*) FROM pages) * 0.5) / (SELECT count(*) FROM orders), 6)::DOUBLE AS avg_seconds
""")
def conversion_totals(spark, d):
    out = catalog.conversion_stats(_outcomes(spark, d).withColumn("seconds", F.lit(0.5)))
    return out.withColumn("avg_seconds", F.round("avg_seconds", 6))


@report("""SELECT 'ORDER' AS "group", count(*) AS success, 2 * count(*) AS total_rows FROM orders""")
def conversion_by_group(spark, d):
    return catalog.conversion_stats_by_group(_outcomes(spark, d))


@report("""
WITH c AS (SELECT o_orderkey, 4 + o_custkey % 5 AS items, 4 + o_orderkey % 7 AS rws FROM orders)
SELECT o_orderkey, CASE WHEN items > 5 AND (items >= rws OR rws <= 5) THEN 'item' ELSE 'row' END AS record_tag
FROM c WHERE items > 5 OR rws > 5
""")
def guessed_record_tags(spark, d):
    return markup.guess_record_tag(markup.elements(list_docs(spark, d), ["o_orderkey"]), ["o_orderkey"])


@report("""
SELECT o_orderkey, CASE WHEN 4 + o_custkey % 5 >= 4 + o_orderkey % 7 THEN 'item' ELSE 'row' END AS record_tag FROM orders
""")
def top_child_tags(spark, d):
    return markup.top_child_tag(markup.elements(list_docs(spark, d), ["o_orderkey"]), ["o_orderkey"])


@report("""
SELECT t.tag, sum(t.n)::BIGINT AS n FROM orders, LATERAL (VALUES ('list', 1), ('item', 4 + o_custkey % 5), ('v', 4 + o_custkey % 5),
 ('row', 4 + o_orderkey % 7)) t(tag, n) GROUP BY t.tag
""")
def element_counts(spark, d):
    return markup.tag_counts(markup.elements(list_docs(spark, d), ["o_orderkey"]), [])


@report("""
SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag
""")
def page_tags(spark, d):
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)))
    return markup.tag_counts(table(spark, d, "pages").select(tags.alias("t")).select(F.lower("t").alias("tag")), [])


@report("""
SELECT * FROM (SELECT o_orderkey, 0::BIGINT AS record_idx, 'order' AS record_tag, 'order | key=' || o_orderkey || ' | pri=' || o_orderpriority || ' | status | ' || o_orderstatus ||
 ' | note | first | note | ' || o_custkey || ' | total | cur=USD | ' || o_totalprice::DECIMAL(18,2) || ' | empty' AS content FROM orders)
WHERE length(content) > 50
""")
def record_texts(spark, d):
    return markup.record_text(order_docs(spark, d), ["o_orderkey"], "order", min_chars=50)


@report("""
SELECT o_orderkey, 0::BIGINT AS record_idx, 'AUTO:order' AS record_tag, '<order key="' || o_orderkey || '" pri="' || o_orderpriority || '"><status>' || o_orderstatus ||
 '</status><note>first</note><note>' || o_custkey || '</note><total cur="USD">' || o_totalprice::DECIMAL(18,2) || '</total><empty /></order>' AS content FROM orders
UNION ALL SELECT o_orderkey, 1, 'AUTO:order', '<order key="-' || o_orderkey || '"><status>x</status></order>' FROM orders
""")
def record_markup(spark, d):
    return markup.record_xml(order_docs(spark, d), ["o_orderkey"])


FILE_PATH = """CASE doc_id % 4 WHEN 0 THEN concat(source, '/', lang, '__', cast(n as string), '.xml')
 WHEN 1 THEN concat(source, '__', lang, '/', cast(n as string), '.xml') WHEN 2 THEN concat(source, '/', lang, '/', cast(n as string), '.xml')
 ELSE concat(source, '/', lang, '/', cast(n as string), '.XML') END"""


@report(f"""
WITH p AS (SELECT doc_id, {FILE_PATH} AS path FROM (SELECT *, doc_id // 4 % 7 AS n FROM documents)),
u AS (SELECT path, min(doc_id) AS doc_id FROM p GROUP BY path),
b AS (SELECT *, regexp_replace(replace(path, '/', '__'), '\\.[^.]+$', '') AS bare FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY path) - 1 AS k FROM b)
SELECT path, bare || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.csv' AS csv_name FROM n
""")
def output_names(spark, d):
    docs = table(spark, d, "documents").withColumn("n", F.expr("doc_id div 4 % 7"))
    files = docs.select(F.expr(FILE_PATH).alias("path")).distinct()
    return catalog.unique_names(files)


NAMES = """CASE page_id % 6 WHEN 0 THEN concat(cast(page_id as string), '_BATCH (1).zip') WHEN 1 THEN concat(cast(page_id as string), '-order', cast(page_id as string), '.zip')
 WHEN 2 THEN concat('AR_TERM.v', cast(page_id as string), '.zip') WHEN 3 THEN concat('Supply_20260113_0557', cast(10 + page_id % 90 as string), '.zip')
 WHEN 4 THEN concat('a very long container name, no module ', cast(page_id as string), '.zip') ELSE concat('éa', cast(page_id as string), '_x') END"""


@report(f"""
WITH n AS (SELECT page_id, {NAMES} AS name FROM pages),
s AS (SELECT *, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem FROM n)
SELECT page_id, name, regexp_extract(upper(name), '^(\\p{{L}}*)', 1) AS prefix,
  CASE WHEN regexp_matches(stem, '^\\d+[_\\-]?BATCH') OR regexp_matches(name, '_\\d{{8}}_\\d{{4,6}}.*\\.zip$') OR (contains(stem, ' ') AND length(stem) > 30) THEN NULL
       WHEN regexp_matches(stem, '^\\d+[_-].+') THEN upper(regexp_extract(stem, '^(\\d+)[_-](.+)$', 2)) ELSE upper(stem) END AS archive_group,
  coalesce(nullif(regexp_extract(upper(split_part(stem, '_', 1)), '^(\\p{{L}}*)', 1), ''), 'EXTRAS') AS file_group,
  CASE WHEN contains(stem, '_') THEN upper(split_part(stem, '_', 1)) ELSE 'MISC' END AS path_group
FROM s
""")
def group_names(spark, d):
    name = F.col("name")
    return table(spark, d, "pages").select("page_id", F.expr(NAMES).alias("name")).select(
        "page_id",
        "name",
        naming.alpha_prefix(name).alias("prefix"),
        naming.group_from_archive(name).alias("archive_group"),
        naming.infer_group(name, name).alias("file_group"),
        naming.group_from_path(F.concat(F.lit("x/output/"), name)).alias("path_group"),
    )


@report("""
WITH p AS (SELECT page_id, '\\x\\.\\..\\' || replace(url, '//', '/./') || CASE WHEN page_id % 2 = 0 THEN '.XML' ELSE '.v2.txt' END AS raw FROM pages),
c AS (SELECT page_id, raw, array_to_string(list_filter(string_split(replace(raw, '\\', '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS safe FROM p)
SELECT page_id, safe, regexp_replace(safe, '\\.[^./]+$', '') || '.csv' AS output, substr(sha1(safe), 1, 16) AS short,
       regexp_replace(regexp_extract(safe, '[^/]*$', 0), '^(.+)\\.[^.]+$', '\\1') || '__' || substr(sha1(safe), 1, 16) AS stub FROM c
""")
def safe_paths(spark, d):
    raw = F.concat(
        F.lit("\\x\\.\\..\\"), F.replace("url", F.lit("//"), F.lit("/./")), F.when(F.col("page_id") % 2 == 0, ".XML").otherwise(".v2.txt")
    )
    safe = naming.safe_path(raw)
    return table(spark, d, "pages").select(
        "page_id", safe.alias("safe"), naming.output_path(raw).alias("output"),
        naming.short_hash(safe).alias("short"), naming.stub(naming.base_name(safe), safe).alias("stub"),
    )


@report("""
WITH b AS (SELECT doc_id, n_chars * (1 + doc_id % 11) ** (doc_id % 9) AS n FROM documents),
s AS (SELECT doc_id, n::BIGINT AS n FROM b)
SELECT doc_id, CASE WHEN n < 1024 THEN format('{:.1f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024.0::DOUBLE)
  WHEN n < 1073741824 THEN format('{:.1f} MB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN format('{:.1f} GB', n / 1073741824.0::DOUBLE)
  ELSE format('{:.1f} TB', n / 1099511627776.0::DOUBLE) END AS size FROM s
""")
def byte_sizes(spark, d):
    n = F.expr("cast(n_chars * power(1 + doc_id % 11, doc_id % 9) as bigint)")
    return table(spark, d, "documents").select("doc_id", display.byte_size(n).alias("size"))


@report("""
SELECT c_custkey, array_to_string(list_transform(string_split(lower(c_mktsegment) || '_unitPrice__' || c_nationkey, '_'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS label,
  CASE WHEN c_nationkey = 3 THEN '—' ELSE (CASE WHEN c_acctbal < 0 THEN '-$' ELSE '$' END) || format('{:,.2f}', abs(c_acctbal)) END AS money,
  CASE WHEN c_nationkey = 3 THEN '—' ELSE format('{:.2f}', c_nationkey * 100.0::DOUBLE) || '%' END AS pct,
  CASE WHEN c_nationkey = 3 THEN '—' ELSE format('{:,}', c_custkey * 1000) END AS thousands
FROM customer
""")
def display_formats(spark, d):
    only = lambda c: F.when(F.col("c_nationkey") != 3, c)
    return table(spark, d, "customer").select(
        "c_custkey",
        display.label(F.concat(F.lower("c_mktsegment"), F.lit("_unitPrice__"), F.col("c_nationkey").cast("string"))).alias("label"),
        display.currency(only(F.col("c_acctbal"))).alias("money"),
        display.percentage(only(F.col("c_nationkey").cast("double"))).alias("pct"),
        display.grouped_number(only(F.col("c_custkey") * 1000)).alias("thousands"),
    )


@report("""
SELECT cls AS event_class, count(*) AS n FROM (SELECT CASE
  WHEN contains(a, 'login') AND contains(a, 'success') THEN 'badge-success' WHEN contains(a, 'login') AND contains(a, 'fail') THEN 'badge-error'
  WHEN contains(a, 'logout') THEN 'badge-info' WHEN contains(a, 'delete') OR contains(a, 'lock') OR contains(a, 'error') THEN 'badge-error' ELSE 'badge-warning' END AS cls
  FROM (SELECT lower(CASE event_type WHEN 'signup' THEN 'LOGIN_SUCCESS' WHEN 'view' THEN 'Logout' WHEN 'purchase' THEN 'login_FAILED' ELSE event_type END) AS a FROM events)) GROUP BY cls
""")
def event_classes(spark, d):
    action = F.expr("CASE event_type WHEN 'signup' THEN 'LOGIN_SUCCESS' WHEN 'view' THEN 'Logout' WHEN 'purchase' THEN 'login_FAILED' ELSE event_type END")
    return table(spark, d, "events").groupBy(display.event_class(action).alias("event_class")).agg(F.count(F.lit(1)).alias("n"))


@report("""
WITH u AS (SELECT doc_id AS seq, source || '/' || n_chars AS path, ' ' || lang || ' ' AS "group" FROM documents
  UNION ALL SELECT 1000000 + doc_id, source || '/' || n_chars, upper(source) FROM documents)
SELECT path, min(seq) AS seq, upper(trim(arg_min("group", seq))) AS "group" FROM u GROUP BY path
""")
def first_groups(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("path")
    first = docs.select(F.col("doc_id").alias("seq"), path, F.concat(F.lit(" "), "lang", F.lit(" ")).alias("group"))
    again = docs.select((F.col("doc_id") + 1000000).alias("seq"), path, F.upper("source").alias("group"))
    return catalog.dedupe_groups(first.unionByName(again)).select("path", "seq", "group")


@report("""
SELECT doc_id, coalesce(CASE WHEN quality IS NOT NULL THEN 'Q' || quality END, CASE WHEN doc_id % 3 = 0 THEN 'SRC' ELSE upper(lang) END) AS "group"
FROM documents LEFT JOIN labels USING (doc_id)
""")
def mapped_groups(spark, d):
    path = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "source", "doc_id")).otherwise(F.concat_ws("_", "lang", "doc_id"))
    files = table(spark, d, "documents").select("doc_id", path.alias("path"), F.concat_ws("_", "lang", "doc_id").alias("filename"))
    known = files.join(table(spark, d, "labels"), "doc_id").select("path", F.concat(F.lit("Q"), "quality").alias("group"))
    return lookups.with_group(files, known).select("doc_id", "group")


@report("""
SELECT doc_id, sha1(lower(trim(regexp_replace(replace(text, 'e', chr(160) || chr(9) || 'e'), '[\\s\\x{a0}]+', ' ', 'g')))) AS digest FROM documents
""")
def normalised_texts(spark, d):
    t = F.replace("text", F.lit("e"), F.lit("\u00a0\te"))
    return texts(spark, d).select("doc_id", F.sha1(text.norm_cell(F.concat(t, F.lit("\x00")), ignore_case=True)).alias("digest"))


@report("""SELECT o_orderpriority[1:1] AS folder, sum(strlen(o_orderkey || ',' || o_orderstatus) + 1)::BIGINT AS bytes, count(*)::BIGINT AS lines FROM orders GROUP BY 1""")
def scanned_files(spark, d):
    """Orders written as a folder tree of text files, then found by scanning it; hidden files are skipped."""
    root = scratch_path(spark, "scan")
    lines = table(spark, d, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("p"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value")
    )
    lines.write.partitionBy("p").text(root)
    found = archives.scan_files(spark, root, ".txt")
    folder = F.regexp_extract("path", "p=([0-9])/", 1)
    text_lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return found.groupBy(folder.alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(text_lines).cast("long").alias("lines"))

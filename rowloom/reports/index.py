"""Chunking and the chunk index."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import vectors
from rowloom.operators import chunking
from rowloom.plans.ranking import number_rows
from rowloom.reports.registry import report, table, texts

HEADER = ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"]


def part_tables(spark, d):
    """One table per brand and its rows as strings."""
    p = table(spark, d, "part").withColumn("filename", F.concat("p_brand", F.lit(".csv")))
    p = number_rows(p, ["filename"], ["p_partkey"], number="n", block=F.expr("p_partkey div 1000"))
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    name = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") == 7, F.repeat("p_name", 40)).otherwise(F.col("p_name"))
    return p.select(
        "filename",
        F.upper("p_brand").alias("group"),
        (F.col("n") - 1).alias("row_idx"),
        F.array(F.col("p_partkey").cast("string"), name, F.col("p_type"), F.col("p_size").cast("string"), price).alias("cells"),
    )


def part_header():
    return F.array(*[F.lit(c) for c in HEADER])


LINES = """
r AS (SELECT p_brand || '.csv' AS f, upper(p_brand) AS g, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n,
  CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size = 7 THEN repeat(p_name, 40) ELSE p_name END AS nm, p_partkey, p_type, p_size, p_retailprice::DECIMAL(18,2) AS price FROM part),
l AS (SELECT f, g, n, p_partkey || ' | ' || nm || ' | ' || p_type || ' | ' || p_size || ' | ' || price AS line, nm FROM r)
"""


@report("""WITH RECURSIVE """ + LINES + """,
b AS (SELECT f, g, 'TYPE: CSV_DATA_CHUNK | FILE: ' || f || ' | GROUP: ' || g || chr(10) || 'COLUMNS: p_partkey, p_name, p_type, p_size, p_retailprice' || chr(10) || 'ROWS:' AS head FROM l GROUP BY 1, 2),
s AS (SELECT l.f, l.g, n, line, head, length(head) + 1 AS base, sum(length(line) + 1) OVER (PARTITION BY l.f ORDER BY n)::BIGINT AS cum, length(line) + 1 AS len FROM l JOIN b USING (f)),
o AS (SELECT x.f, x.n, coalesce(min(y.n), x.n + 1) AS o FROM s x LEFT JOIN s y ON y.f = x.f AND y.n <= x.n AND x.cum - y.cum + y.len <= 200 GROUP BY 1, 2),
w AS (SELECT s.*, o.o, coalesce(lag(o.o) OVER (PARTITION BY s.f ORDER BY s.n), 1) AS po FROM s JOIN o USING (f, n)),
k AS (SELECT f, 0::BIGINT AS n, 1::BIGINT AS st, NULL::BIGINT AS a1, NULL::BIGINT AS b1, NULL::BIGINT AS a2, NULL::BIGINT AS b2 FROM b
  UNION ALL
  SELECT f, n, CASE WHEN fullnow THEN o ELSE st1 END, CASE WHEN flush THEN st END, CASE WHEN flush THEN n - 1 END, CASE WHEN fullnow THEN st1 END, CASE WHEN fullnow THEN n END
  FROM (SELECT *, base + cum - coalesce((SELECT z.cum FROM w z WHERE z.f = q.f AND z.n = q.st1 - 1), 0) >= 3500 AS fullnow FROM (
    SELECT k.f, w.n, w.o, w.base, w.cum, k.st, (k.st < w.n AND w.base + w.cum - coalesce(pw.cum, 0) > 1500) AS flush, CASE WHEN k.st < w.n AND w.base + w.cum - coalesce(pw.cum, 0) > 1500 THEN w.po ELSE k.st END AS st1
    FROM k JOIN w ON w.f = k.f AND w.n = k.n + 1 LEFT JOIN w pw ON pw.f = k.f AND pw.n = k.st - 1) q)),
c AS (SELECT f, n, 0 AS part, a1 AS a, b1 AS b FROM k WHERE a1 IS NOT NULL UNION ALL SELECT f, n, 1, a2, b2 FROM k WHERE a2 IS NOT NULL
  UNION ALL SELECT f, n, 2, st, n FROM k WHERE n = (SELECT max(n) FROM s WHERE s.f = k.f) AND st <= n)
SELECT c.f AS filename, (row_number() OVER (PARTITION BY c.f ORDER BY c.n, part) - 1)::INT AS chunk_index, a AS row_start, b AS row_end,
  sha256((head || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY s2.n) FROM s s2 WHERE s2.f = c.f AND s2.n BETWEEN a AND b))) AS digest
FROM c JOIN b ON b.f = c.f""")
def table_chunks(spark, d):
    chunks = chunking.chunk_lines(chunking.lines_of(part_tables(spark, d), part_header()))
    return chunks.select("filename", "chunk_index", "row_start", "row_end", F.sha2("text", 256).alias("digest"))


@report("""
WITH RECURSIVE v AS (SELECT l_returnflag || '.csv' AS f, l_orderkey || ' | ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' | ' || l_quantity || ' | ' || l_extendedprice || ' | ' || l_shipdate AS line,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem),
s AS (SELECT *, length(line) + 1 AS len, sum(length(line) + 1) OVER (PARTITION BY f ORDER BY n)::BIGINT AS cum, count(*) OVER (PARTITION BY f) AS last,
  'TYPE: CSV_DATA_CHUNK | FILE: ' || f || ' | GROUP: LINES' || chr(10) || 'COLUMNS: l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate' || chr(10) || 'ROWS:' AS head FROM v),
e AS (SELECT x.f, x.n, x.last, y.n AS upto FROM s x ASOF JOIN s y ON x.f = y.f AND x.cum - x.len + 1500 - length(x.head) - 1 >= y.cum),
o AS (SELECT x.f, x.n, y.n AS back FROM s x ASOF JOIN s y ON x.f = y.f AND x.cum - 200 <= y.cum - y.len),
nx AS (SELECT e.f, e.n, e.upto, CASE WHEN e.upto < e.last THEN o.back END AS next FROM e JOIN o ON o.f = e.f AND o.n = e.upto),
k AS (SELECT f, 0 AS i, n AS a, upto AS b, next FROM nx WHERE n = 1 UNION ALL SELECT k.f, i + 1, nx.n, nx.upto, nx.next FROM k JOIN nx ON nx.f = k.f AND nx.n = k.next)
SELECT k.f AS filename, i::INT AS chunk_index, a AS row_start, b AS row_end, sha256(any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS digest
FROM k JOIN s ON s.f = k.f AND s.n BETWEEN a AND b GROUP BY 1, 2, 3, 4
""")
def lineitem_chunks(spark, d):
    """Three tables that hold all line items: blocks of one table are packed apart."""
    li = table(spark, d, "lineitem").withColumn("filename", F.concat("l_returnflag", F.lit(".csv")))
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    placed = number_rows(li, ["filename"], cols, number="n")
    rows = placed.select(
        "filename", F.lit("LINES").alias("group"), (F.col("n") - 1).alias("row_idx"), F.array(*[F.col(c).cast("string") for c in cols]).alias("cells")
    )
    chunks = chunking.chunk_lines(chunking.lines_of(rows, F.array(*[F.lit(c) for c in cols])))
    return chunks.select("filename", "chunk_index", "row_start", "row_end", F.sha2("text", 256).alias("digest"))


@report("WITH " + LINES + """,
c AS (SELECT f, g, count(*) AS n, count(*) FILTER (WHERE nm <> '') AS nn, string_agg(CASE WHEN n <= 5 THEN line END, chr(10) ORDER BY n) AS sample FROM l GROUP BY 1, 2)
SELECT f AS filename, sha256(('TYPE: CSV_SUMMARY | FILE: ' || f || ' | GROUP: ' || g || chr(10) || 'COLUMNS: p_partkey, p_name, p_type, p_size, p_retailprice' || chr(10) || 'ROW_COUNT: ' || n || chr(10) ||
 'NON_EMPTY_COUNTS: p_partkey:' || n || ', p_name:' || nn || ', p_type:' || n || ', p_size:' || n || ', p_retailprice:' || n || chr(10) || 'SAMPLE_ROWS:' || chr(10) || sample)) AS digest FROM c""")
def table_summaries(spark, d):
    docs = chunking.summary_docs(part_tables(spark, d), part_header())
    return docs.select("filename", F.sha2("text", 256).alias("digest"))


@report(r"""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE length(text) > 1500),
x AS (SELECT doc_id, 0 AS i, '' AS buf, NULL::VARCHAR AS done FROM p
  UNION ALL SELECT x.doc_id, i + 1, CASE WHEN length(buf) + length(parts[i + 1]) + 1 > 1500 AND buf <> '' THEN parts[i + 1] || chr(10) ELSE buf || parts[i + 1] || chr(10) END,
    CASE WHEN length(buf) + length(parts[i + 1]) + 1 > 1500 AND buf <> '' THEN trim(buf, ' ' || chr(10)) END FROM x JOIN p ON p.doc_id = x.doc_id WHERE i < len(parts)),
c AS (SELECT doc_id, i, done AS content FROM x WHERE done IS NOT NULL UNION ALL SELECT x.doc_id, 100000, trim(buf, ' ' || chr(10)) FROM x JOIN p ON p.doc_id = x.doc_id WHERE i = len(parts) AND trim(buf, ' ' || chr(10)) <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS piece, sha256(content) AS digest FROM c
UNION ALL SELECT doc_id, 0, sha256(text) FROM documents WHERE length(text) <= 1500""")
def text_pieces(spark, d):
    out = chunking.split_text(texts(spark, d), ["doc_id"])
    return out.select("doc_id", "piece", F.sha2("content", 256).alias("digest"))


@report("""SELECT doc_id AS id, md5('s1::' || source || '::' || lang || '::chunk::' || n_chars || '::' || substr(sha1(text), 1, 12)) AS doc_id FROM documents""")
def chunk_ids(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("lang").alias("group"), F.col("n_chars").alias("chunk_index"), "text"
    )
    return chunking.with_ids(docs, "s1").select("id", "doc_id")


@report("""SELECT doc_id, coalesce('q' || quality, lang) AS mark FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 1000000000 + item_id, 'new' FROM benchmark""")
def upserted_chunks(spark, d):
    target = table(spark, d, "documents").select("doc_id", F.col("lang").alias("mark"))
    again = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("mark"))
    new = table(spark, d, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.lit("new").alias("mark"))
    return chunking.upsert(target, again.unionByName(new), F.col("doc_id"))


@report("""SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'de') AS deleted FROM documents WHERE lang <> 'de'""")
def deleted_group(spark, d):
    docs = table(spark, d, "documents").withColumn("group", F.col("lang"))
    return chunking.delete_group(docs, "de").select("doc_id").withColumn("deleted", chunking.count_deleted(docs, "de").scalar())


@report("""SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id AS k, toxic, quality FROM labels) ON k = doc_id // 2 * 2
 WHERE n_chars > CASE WHEN quality = 1 AND toxic = 0 THEN 1500 ELSE -1 END""")
def resumed_chunks(spark, d):
    chunks = table(spark, d, "documents").select(
        "doc_id", F.col("n_chars").alias("chunk_index"), F.expr("cast(doc_id div 2 * 2 as string)").alias("filename"), F.lit("G").alias("group"), F.lit("1:0").alias("file_sig")
    )
    state = table(spark, d, "labels").filter("quality = 1").select(
        F.lit("G").alias("group"), F.col("doc_id").cast("string").alias("filename"),
        F.concat(F.lit("1:"), "toxic").alias("file_sig"), F.lit(1500).alias("last_chunk"),
    )
    return chunking.resume_filter(chunks, state).select("doc_id")


SLOTS = r"""
k AS (SELECT {id} AS id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, count(*) AS tf FROM
  (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[A-Za-z0-9_./\-]{{2,64}}')) AS term FROM {table}) GROUP BY 1, 2)"""


@report("WITH " + SLOTS.format(id="doc_id", text="text", table="documents") + """ SELECT id AS doc_id, slot::INT AS slot, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)::DOUBLE), 6) AS weight FROM k""")
def embedded_texts(spark, d):
    v = texts(spark, d).select("doc_id", F.posexplode(vectors.embed(F.col("text"))).alias("slot", "weight"))
    return v.filter("weight <> 0").withColumn("weight", F.round("weight", 6))

"""Catalog rollups, filters, sorting, lookups, edits and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions import display
from rowloom.operators import catalog, dialogue, edits, lookups
from rowloom.reports.registry import report, table
from rowloom.session import spread

CATALOG = """WITH c AS (SELECT 'orders_' || o_custkey || '.csv' AS filename, o_orderpriority AS "group", count(*) AS rows, sum(o_orderkey)::BIGINT AS size_bytes FROM orders GROUP BY 1, 2)"""


def order_catalog(spark, d):
    return table(spark, d, "orders").groupBy(
        F.concat(F.lit("orders_"), "o_custkey", F.lit(".csv")).alias("filename"), F.col("o_orderpriority").alias("group")
    ).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("size_bytes"))


@report(CATALOG + """ SELECT "group", count(*) AS file_count, sum(rows)::BIGINT AS total_rows, sum(size_bytes)::BIGINT AS total_size FROM c GROUP BY ROLLUP ("group")""")
def group_rollup(spark, d):
    return catalog.group_summary(order_catalog(spark, d), totals=True)


@report("""SELECT p_brand || '.csv' AS filename, p_type AS "group", count(*) AS rows, 3 AS columns, sum(length(p_name))::BIGINT AS size_bytes FROM part GROUP BY 1, 2""")
def table_catalog(spark, d):
    rows = table(spark, d, "part").select(
        F.concat("p_brand", F.lit(".csv")).alias("filename"), F.col("p_type").alias("group"),
        F.array(F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")).alias("cells"), F.length("p_name").alias("size"),
    )
    return catalog.build_catalog(rows, F.col("size"))


@report("""SELECT count(*) AS row_count, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS "key", count(*) FILTER (WHERE o_orderstatus <> 'P') AS status FROM orders""")
def table_profile(spark, d):
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("status")
    )
    return catalog.profile(o, ["key", "status"])


@report("""
SELECT p_brand, 0 AS pos, count(*) AS row_count, count(*) AS non_empty FROM part GROUP BY 1
UNION ALL SELECT p_brand, 1, count(*), count(*) FILTER (WHERE p_size % 2 = 0) FROM part GROUP BY 1""")
def table_profiles(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.array(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit("x"))).alias("cells"))
    return catalog.profile_rows(rows, ["p_brand"])


@report("""SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 5""")
def sample_rows(spark, d):
    return catalog.sample_rows(table(spark, d, "part"), ["p_brand"], "p_partkey").select("p_brand", "p_partkey")


CHUNKS = """WITH c AS (SELECT doc_id, lang AS "group", CASE doc_id % 7 WHEN 0 THEN 'summary' WHEN 1 THEN 'file_marker' ELSE 'chunk' END AS doc_type FROM documents)"""


def typed_docs(spark, d):
    kind = F.when(F.col("doc_id") % 7 == 0, "summary").when(F.col("doc_id") % 7 == 1, "file_marker").otherwise("chunk")
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("group"), kind.alias("doc_type"), "text")


@report(CHUNKS + """ SELECT "group", count(*) AS chunk_count FROM c WHERE doc_type = 'chunk' GROUP BY 1""")
def indexed_groups(spark, d):
    return catalog.index_groups(typed_docs(spark, d))


@report(CHUNKS + """ SELECT count(*) AS documents, count(*) FILTER (WHERE doc_type = 'chunk') AS total_chunks, count(*) FILTER (WHERE doc_type <> 'chunk') AS total_summaries,
 count(DISTINCT "group") AS total_groups FROM c""")
def index_totals(spark, d):
    return catalog.index_stats(typed_docs(spark, d))


@report("""SELECT count(*) AS total, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, count(*) FILTER (WHERE turn = 0) AS sessions FROM conversations""")
def role_counts(spark, d):
    c = F.col
    return catalog.conditional_counts(
        table(spark, d, "conversations"),
        {"total": F.lit(True), "users": c("role") == "user", "assistants": c("role") == "assistant", "sessions": c("turn") == 0},
    )


@report("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'click') AS click FROM events")
def status_totals(spark, d):
    return catalog.status_counts(table(spark, d, "events"), "event_type", ["error", "click"])


@report("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_list(spark, d):
    return catalog.status_counts(table(spark, d, "events"), "event_type")


@report("SELECT sum(o_orderkey)::BIGINT AS records FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def selection_estimate(spark, d):
    return catalog.estimate(table(spark, d, "orders"), ["1-URGENT", "5-LOW"], "o_orderpriority", "o_orderkey")


@report("""SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')) AS skipped FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM')""")
def chosen_groups(spark, d):
    o = table(spark, d, "orders")
    pick = ["2-HIGH", "3-MEDIUM"]
    kept = catalog.filter_groups(o, pick, "o_orderpriority").select("o_orderkey")
    return kept.withColumn("skipped", catalog.count_skipped(o, pick, "o_orderpriority").scalar())


@report(CHUNKS + """ SELECT doc_id FROM c WHERE "group" = 'en' AND doc_type = 'chunk'""")
def filtered_chunks(spark, d):
    return catalog.where_meta(typed_docs(spark, d), "en", "chunk").select("doc_id")


@report("SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'mobil')")
def searched_groups(spark, d):
    return catalog.search_groups(table(spark, d, "customer"), "MOBIL", "c_mktsegment").select("c_custkey")


@report("SELECT *, (SELECT count(*) FROM part) AS total_rows, 6 AS columns FROM part ORDER BY p_partkey LIMIT 100")
def table_preview(spark, d):
    return catalog.preview(table(spark, d, "part"), "p_partkey", 100)


@report("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
 least(200, (SELECT count(*) FROM customer)) AS showing, (SELECT count(*) FROM customer) AS total FROM customer
 ORDER BY lower(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END) DESC NULLS LAST, c_custkey LIMIT 200""")
def sorted_head(spark, d):
    seg = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", seg.alias("segment"))
    return catalog.head_of(rows, "segment", "desc", 200, ["c_custkey"])


@report("""SELECT c_custkey, c_acctbal, rank() OVER (ORDER BY c_acctbal ASC NULLS LAST, c_custkey) AS place FROM customer""")
def sorted_table(spark, d):
    from rowloom.plans.ranking import number_rows

    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return number_rows(rows, [], [catalog.sort_key(rows, "c_acctbal"), "c_custkey"], number="place")


@report("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200")
def latest_events(spark, d):
    return catalog.latest(table(spark, d, "events"), "ts", 200, ["event_id"]).select("event_id", "event_type")


@report("SELECT event_id FROM events WHERE user_id = 8 AND event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def owner_events(spark, d):
    return catalog.owner_rows(table(spark, d, "events"), "user_id", 8, "ts", 50, ("event_type", "error"), ["event_id"]).select("event_id")


@report("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'signup') WHERE n = 1""")
def latest_request(spark, d):
    pending = table(spark, d, "events").filter("event_type = 'signup'")
    return catalog.latest_per_key(pending, "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@report("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS row_idx, i FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem) WHERE i % 3 <> 1")
def renumbered_rows(spark, d):
    from rowloom.plans.ranking import number_rows

    rows = number_rows(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], number="n", block=F.col("l_linenumber"))
    rows = rows.select("l_orderkey", (F.col("n") - 1).alias("row_idx"), (F.col("n") - 1).alias("i"))
    return catalog.delete_rows(rows, rows.filter("row_idx % 3 = 1"), ["l_orderkey"])


# --- lookups ----------------------------------------------------------------

@report("""
WITH g AS (SELECT 'customer#' || lpad((n_nationkey * 7)::VARCHAR, 9, '0') AS name, n_nationkey AS ord FROM nation UNION ALL SELECT 'New', 100),
f AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) || '_v1_x.csv' WHEN c_custkey % 3 = 0 THEN 'new_' || c_name || '.csv' ELSE c_name || '.csv' END AS filename FROM customer),
s AS (SELECT *, upper(regexp_replace(filename, '\\.[^.]+$', '')) AS stem FROM f)
SELECT c_custkey, filename, arg_min(name, ord) AS matched_group FROM s JOIN g ON stem = upper(name) OR starts_with(stem, upper(name) || '_') GROUP BY 1, 2""")
def prefix_groups(spark, d):
    n = table(spark, d, "nation").select(
        F.concat(F.lit("customer#"), F.lpad((F.col("n_nationkey") * 7).cast("string"), 9, "0")).alias("group"), F.col("n_nationkey").alias("ord")
    )
    groups = n.unionByName(n.limit(1).select(F.lit("New").alias("group"), F.lit(100).alias("ord")))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper("c_name"), F.lit("_v1_x.csv"))).when(
        F.col("c_custkey") % 3 == 0, F.concat(F.lit("new_"), "c_name", F.lit(".csv"))
    ).otherwise(F.concat("c_name", F.lit(".csv")))
    files = table(spark, d, "customer").select("c_custkey", name.alias("filename"))
    return lookups.match_prefix(files, groups)


@report("""
WITH g AS (SELECT 'R#' || n_nationkey AS name, n_nationkey AS ord FROM nation UNION ALL SELECT upper(n_nationkey::VARCHAR || '7'), 50 + n_nationkey FROM nation)
SELECT c_custkey, c_name || '.csv' AS filename, arg_min(name, ord) AS matched_group FROM customer JOIN g ON contains(lower(c_name), lower(name)) GROUP BY 1, 2""")
def contained_groups(spark, d):
    n = table(spark, d, "nation")
    groups = n.select(F.concat(F.lit("R#"), "n_nationkey").alias("group"), F.col("n_nationkey").alias("ord")).unionByName(
        n.select(F.concat("n_nationkey", F.lit("7")).alias("group"), (F.col("n_nationkey") + 50).alias("ord"))
    )
    files = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(".csv")).alias("filename"))
    return lookups.match_contains(files, groups)


@report("SELECT n_name AS \"group\", n_nationkey FROM nation WHERE upper(n_name) NOT IN (SELECT 'NATION_' || c_nationkey FROM customer WHERE c_acctbal > 9900)")
def selectable_groups(spark, d):
    groups = table(spark, d, "nation").select(F.lower("n_name").alias("group"), "n_nationkey")
    auto = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.concat(F.lit("Nation_"), "c_nationkey").alias("group"))
    return lookups.selectable(groups, auto).select(F.upper("group").alias("group"), "n_nationkey")


@report("SELECT DISTINCT upper(n_name) AS \"group\" FROM nation WHERE upper(n_name) IN (SELECT 'NATION_' || s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def eligible_groups(spark, d):
    configured = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("NATION_"), "s_nationkey").alias("group"))
    return lookups.eligible(table(spark, d, "nation").select(F.lower("n_name").alias("group")), configured)


@report("""SELECT n_name AS "group", n > 0 AS indexed, n AS chunk_count FROM (SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 6000) ON s_nationkey = n_nationkey GROUP BY 1)""")
def group_index_status(spark, d):
    counts = table(spark, d, "supplier").filter("s_acctbal > 6000").groupBy(F.concat(F.lit("NATION_"), "s_nationkey").alias("group")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return lookups.group_status(table(spark, d, "nation").select(F.col("n_name").alias("group")), counts)


@report("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def recent_orders(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return lookups.recent_with_owner(o, c, o["o_custkey"] == c["c_custkey"], "o_orderdate", 200, ["o_orderkey"]).select("o_orderkey", "c_name")


@report("""
SELECT 'all' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9800 UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9800 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'left', k FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)""")
def key_sets(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9800").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return (
        tag(lookups.all_keys(a, b, ["k"]), "all").unionByName(tag(lookups.common_keys(a, b, ["k"]), "both")).unionByName(tag(lookups.missing_keys(b, a, ["k"]), "left"))
    )


@report("""SELECT c_name AS name, c_mktsegment AS segment, '' AS brand FROM customer UNION ALL SELECT p_name, '', p_brand FROM part""")
def united_tables(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return lookups.union_tables(a, table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))


# --- edits ------------------------------------------------------------------

PATCHES = """p AS (SELECT p_brand AS filename, p_partkey AS row_idx, 1 AS seq, 'p_name' AS col, 'first' AS value FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_brand, p_partkey, 2, 'p_name', 'n' || p_size FROM part WHERE p_partkey % 6 = 0
 UNION ALL SELECT p_brand, p_partkey, 3, 'note', NULL FROM part WHERE p_partkey % 10 = 0
 UNION ALL SELECT p_brand, p_partkey, 4, 'note', 'seen' FROM part WHERE p_partkey % 5 = 1
 UNION ALL SELECT p_brand, p_partkey + 100000000, 5, 'p_name', 'x' FROM part)"""


def part_rows(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("filename"), F.col("p_partkey").alias("row_idx"), "p_name", "p_type")


def part_patches(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")

    def make(cond, seq, col, value, at=k):
        return p.filter(cond).select(
            F.col("p_brand").alias("filename"), at.alias("row_idx"), F.lit(seq).alias("seq"), F.lit(col).alias("column"), value.cast("string").alias("value")
        )

    return (
        make(k % 3 == 0, 1, "p_name", F.lit("first"))
        .unionByName(make(k % 6 == 0, 2, "p_name", F.concat(F.lit("n"), "p_size")))
        .unionByName(make(k % 10 == 0, 3, "note", F.lit(None)))
        .unionByName(make(k % 5 == 1, 4, "note", F.lit("seen")))
        .unionByName(make(F.lit(True), 5, "p_name", F.lit("x"), k + 100_000_000))
    )


@report("WITH " + PATCHES + """, l AS (SELECT filename, row_idx, col, arg_max(coalesce(value, ''), seq) AS value FROM p GROUP BY 1, 2, 3)
SELECT p_brand AS filename, p_partkey AS row_idx, coalesce(a.value, p_name) AS p_name, p_type, coalesce(b.value, '') AS note FROM part
 LEFT JOIN l a ON a.row_idx = p_partkey AND a.filename = p_brand AND a.col = 'p_name' LEFT JOIN l b ON b.row_idx = p_partkey AND b.filename = p_brand AND b.col = 'note'""")
def patched_cells(spark, d):
    return edits.patch_cells(part_rows(spark, d), part_patches(spark, d), ["filename"])


@report("WITH " + PATCHES + " SELECT count(*) AS updated FROM p WHERE row_idx < 100000000")
def applied_patches(spark, d):
    return edits.count_applied(part_rows(spark, d), part_patches(spark, d), ["filename"])


@report("""SELECT p_brand AS filename, p_partkey AS row_idx, CASE WHEN p_size > 25 THEN 'size ' || p_size ELSE p_name END AS p_name, p_type FROM part""")
def patched_rows(spark, d):
    p = table(spark, d, "part").filter("p_size > 25")
    j = p.select(F.col("p_brand").alias("filename"), F.col("p_partkey").alias("row_idx"), F.to_json(F.struct(F.concat(F.lit("size "), "p_size").alias("p_name"), F.lit(1).alias("other"))).alias("row_data"))
    return edits.patch_rows(part_rows(spark, d), j, ["filename"])


@report("""SELECT p_partkey AS row_idx, p_name, '' AS s_name FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey), '', s_name FROM supplier""")
def appended_rows(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), "p_name")
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), "s_name")
    return edits.append_rows(rows, new)


@report("""SELECT n_name || '.csv' AS filename, n_regionkey AS rows FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) UNION ALL SELECT r_name || '.csv', 0 FROM region""")
def edited_catalog(spark, d):
    cat = table(spark, d, "nation").select(F.concat("n_name", F.lit(".csv")).alias("filename"), F.col("n_regionkey").alias("rows"))
    new = table(spark, d, "region").select(F.concat("r_name", F.lit(".csv")).alias("filename"), F.lit(0).alias("rows"))
    gone = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.concat(F.lit("NATION_"), "s_nationkey", F.lit(".csv")).alias("filename"))
    return edits.drop_table(edits.add_table(edits.add_table(cat, new), cat), gone)


# --- conversations ----------------------------------------------------------

@report("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def context_turns(spark, d):
    return dialogue.last_turns(table(spark, d, "conversations"), dialogue.CONTEXT_TURNS).select("conv_id", "turn", "role")


@report("""SELECT conv_id, sha256(string_agg('[t] ' || upper(role) || ':' || chr(10) || text || chr(10), chr(10) ORDER BY turn)) AS txt,
 sha256('# Chat Transcript' || chr(10) || 'Session: ' || conv_id || chr(10) || 'Exported: t' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
   string_agg('## ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' (t)' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY turn)) AS md
 FROM conversations GROUP BY conv_id""")
def transcripts(spark, d):
    c = table(spark, d, "conversations")
    sha = lambda form: dialogue.transcript(c, form, "t").select("conv_id", F.sha2("transcript", 256).alias(form))
    return sha("txt").join(sha("md"), "conv_id")


@report("SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations")
def json_transcripts(spark, d):
    t = dialogue.transcript(table(spark, d, "conversations"), "json")
    back = t.select("conv_id", F.posexplode(F.from_json("transcript", "array<struct<role:string,content:string>>")).alias("turn", "m"))
    return back.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.sha2("m.content", 256).alias("digest"))


@report("""
WITH c AS (SELECT *, '2024-01-01 ' || lpad((turn % 24)::VARCHAR, 2, '0') || ':00' AS ts, role = 'assistant' AS says FROM conversations)
SELECT conv_id, sha256('# Chat Transcript' || chr(10) || 'Session: ' || conv_id || chr(10) || 'Exported: now' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  string_agg('## ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' (' || ts || ')' || chr(10) || chr(10) || text || chr(10) || chr(10) ||
    CASE WHEN says THEN '**Sources:**' || chr(10) || '- ' || conv_id || '.csv' || chr(10) || '- turn ' || turn || chr(10) || chr(10) ELSE '' END || '---' || chr(10), chr(10) ORDER BY turn)) AS digest
FROM c GROUP BY conv_id""")
def stamped_transcripts(spark, d):
    """Transcripts with the time of each turn and the files that answers rest on."""
    c = table(spark, d, "conversations")
    c = c.withColumn("ts", F.concat(F.lit("2024-01-01 "), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":00")))
    files = F.array(F.concat(F.col("conv_id").cast("string"), F.lit(".csv")), F.concat(F.lit("turn "), F.col("turn").cast("string")))
    c = c.withColumn("files", F.when(F.col("role") == "assistant", files))
    return dialogue.transcript(c, "md", "now", ts="ts", sources="files").select("conv_id", F.sha2("transcript", 256).alias("digest"))


@report("""SELECT o_orderkey, 0 AS block, 'bar' AS chart_type, s.label AS series_label, p.pt AS point, p.lab AS label, (CASE WHEN p.pt = 0 THEN o_custkey ELSE o_orderkey END + s.add)::DOUBLE AS value
 FROM orders, (VALUES ('A', 0), ('Series 2', 1)) s(label, add), (VALUES (0, 'x'), (1, 'y')) p(pt, lab)""")
def chart_points(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    answer = F.concat(
        F.lit('Text\n```chart\n{"type": "Bar", "data": {"labels": ["x", "y"], "datasets": [{"label": "A", "data": ['), c, F.lit(", "), k,
        F.lit(']}, {"data": ['), c + 1, F.lit(", "), k + 1, F.lit("]}]}}\n```\nmore\n```chart\n{bad json\n```\n"),
    )
    return display.chart_points(spread(table(spark, d, "orders")).select("o_orderkey", answer.alias("answer")), "answer", ["o_orderkey"])

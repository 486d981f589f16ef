"""Summary, ranking, trend and comparison analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import analysis
from rowloom.reports.registry import report, table
from rowloom.session import pin


def rounded(df, *cols, digits=4):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@report("""SELECT l_returnflag, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS mean, median(l_quantity) AS median, min(l_quantity) AS least,
 max(l_quantity) AS most, round(stddev_samp(l_quantity), 4) AS stddev FROM lineitem GROUP BY 1""")
def measure_summary(spark, d):
    return rounded(analysis.measures(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]), "total", "mean", "stddev")


@report("""SELECT event_type, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM events GROUP BY 1""")
def quartiles(spark, d):
    return rounded(analysis.quantiles(table(spark, d, "events"), "value", ["event_type"]), "p25", "p50", "p75")


@report("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT event_id, round((value - m) / sd, 4) AS z_score FROM events JOIN s USING (event_type) WHERE abs((value - m) / sd) > 2""")
def outlier_events(spark, d):
    return rounded(analysis.outliers(table(spark, d, "events"), "value", ["event_type"], 2.0), "z_score").select("event_id", "z_score")


@report("""WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer) SELECT c_custkey, round((c_acctbal - m) / sd, 4) AS z_score FROM customer, s WHERE abs((c_acctbal - m) / sd) > 1.6""")
def outlier_customers(spark, d):
    return rounded(analysis.outliers(table(spark, d, "customer"), "c_acctbal", z=1.6), "z_score").select("c_custkey", "z_score")


@report("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS a, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS b FROM customer)
SELECT c_mktsegment, c_custkey, 'top' AS side, a AS rn FROM t WHERE a <= 5 UNION ALL SELECT c_mktsegment, c_custkey, 'bottom', b FROM t WHERE b <= 5""")
def best_and_worst(spark, d):
    out = analysis.top_and_bottom(table(spark, d, "customer"), "c_acctbal", 5, ["c_mktsegment"], ["c_custkey"])
    return out.select("c_mktsegment", "c_custkey", "side", F.col("rn").cast("long").alias("rn"))


@report("""(SELECT o_orderkey, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT o_orderkey, 'bottom' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)""")
def extreme_orders(spark, d):
    return analysis.top_and_bottom(table(spark, d, "orders"), "o_totalprice", 10, then=["o_orderkey"]).select("o_orderkey", "side")


@report("""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS rank, round(n / sum(n) OVER ()::DOUBLE, 8) AS share FROM t""")
def customer_ranks(spark, d):
    per = pin(table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
    return rounded(analysis.rank_and_share(per, "n"), "share", digits=8)


@report("""WITH t AS (SELECT l_returnflag, l_suppkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_suppkey, n, rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) AS rank, round(n / sum(n) OVER (PARTITION BY l_returnflag)::DOUBLE, 8) AS share FROM t""")
def supplier_ranks(spark, d):
    per = pin(table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("n")))
    return rounded(analysis.rank_and_share(per, "n", ["l_returnflag"]), "share", digits=8)


@report("""WITH t AS (SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 2) AS a, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS r FROM lineitem GROUP BY 1)
SELECT l_linestatus, a AS left_value, r AS right_value, round(r - a, 2) AS difference, round((r - a) / a * 100, 4) AS pct_difference FROM t""")
def flag_comparison(spark, d):
    out = analysis.compare_groups(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", "A", "R", F.col("l_quantity"))
    return rounded(out, "left_value", "right_value", "difference", "pct_difference")


PERIODS = "WITH p AS (SELECT event_type, date_trunc('week', ts) AS period, count(*) AS value FROM events GROUP BY 1, 2)"


def weekly(spark, d):
    return analysis.by_period(table(spark, d, "events"), "ts", "week", F.count(F.lit(1)), ["event_type"])


@report(PERIODS + """ SELECT event_type, strftime(period, '%Y-%m-%d') AS period, value, lag(value) OVER w AS previous, value - lag(value) OVER w AS change,
 round((value - lag(value) OVER w) / (lag(value) OVER w)::DOUBLE * 100, 4) AS pct_change FROM p WINDOW w AS (PARTITION BY event_type ORDER BY period)""")
def weekly_change(spark, d):
    out = rounded(analysis.period_change(weekly(spark, d), ["event_type"]), "pct_change")
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@report(PERIODS + """ SELECT event_type, strftime(period, '%Y-%m-%d') AS period, value,
 CASE WHEN value > lag(value) OVER w AND value > lead(value) OVER w THEN 'peak' WHEN value < lag(value) OVER w AND value < lead(value) OVER w THEN 'trough' ELSE 'none' END AS turn,
 CASE WHEN value > lag(value) OVER w THEN 'up' WHEN value < lag(value) OVER w THEN 'down' WHEN value = lag(value) OVER w THEN 'flat' ELSE 'start' END AS direction
 FROM p WINDOW w AS (PARTITION BY event_type ORDER BY period)""")
def weekly_turns(spark, d):
    return analysis.turning_points(weekly(spark, d), ["event_type"]).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@report("SELECT event_type, round(regr_slope(value, user_id), 8) AS slope FROM events GROUP BY 1")
def value_slope(spark, d):
    return rounded(analysis.slope(table(spark, d, "events"), F.col("value"), F.col("user_id"), ["event_type"]), "slope", digits=8)


@report("""SELECT f.field, (SELECT count(*) FROM customer) AS row_count, f.filled, f.filled / (SELECT count(*) FROM customer)::DOUBLE AS share, f.sample_value FROM (
 SELECT 'c_name' AS field, count(*) AS filled, min(c_name) AS sample_value FROM customer
 UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_custkey % 4 <> 0), min(c_mktsegment) FILTER (WHERE c_custkey % 4 <> 0) FROM customer) f""")
def field_inventory(spark, d):
    c = table(spark, d, "customer").withColumn("segment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise(""))
    return analysis.field_inventory(c, ["c_name", "segment"])


@report("""
WITH f AS (SELECT 'doc_id' AS field, count(*) AS filled FROM documents UNION ALL SELECT 'lang', count(nullif(lang, '')) FROM documents UNION ALL SELECT 'quality', count(quality) FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'text', count(nullif(text, '')) FROM documents UNION ALL SELECT 'even', count(*) FILTER (WHERE doc_id % 2 = 0) FROM documents)
SELECT field, (SELECT count(*) FROM documents) AS row_count, filled, row_number() OVER (ORDER BY filled DESC, field)::INT AS fullest, row_number() OVER (ORDER BY filled, field)::INT AS sparsest FROM f""")
def ranked_fields(spark, d):
    """The fullest and the sparsest fields of the documents with their labels."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("even", F.when(F.col("doc_id") % 2 == 0, 1))
    return analysis.ranked_fields(analysis.field_inventory(docs, ["doc_id", "lang", "quality", "text", "even"])).drop("share", "sample_value")


@report("""SELECT 'Total' AS o_orderpriority, count(*)::VARCHAR AS o_orderkey, sum(o_totalprice::DECIMAL(18,2))::VARCHAR AS o_totalprice, '' AS o_orderstatus, max(o_custkey)::VARCHAR AS o_custkey FROM orders""")
def order_summary_row(spark, d):
    """The row below a table of orders: a label, a count, a sum, nothing, a maximum."""
    orders = table(spark, d, "orders")
    summary = {"o_orderpriority": "Total", "o_orderkey": F.count(F.lit(1)), "o_totalprice": F.sum(F.col("o_totalprice").cast("decimal(18,2)")), "o_custkey": F.max("o_custkey")}
    return analysis.summary_row(orders, summary, ["o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey"])


@report("""SELECT source, count(*) AS records, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 8) AS share FROM documents GROUP BY 1""")
def source_records(spark, d):
    return rounded(analysis.group_records(table(spark, d, "documents"), "source"), "share", digits=8)


@report("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS label, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average
 FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def priority_totals(spark, d):
    return rounded(rounded(analysis.with_totals(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "total", digits=2), "average")


@report("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem GROUP BY 1")
def price_correlation(spark, d):
    return rounded(analysis.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "correlation", digits=8)


@report("""SELECT round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS entities, min(o_totalprice) AS least, max(o_totalprice) AS most, 1.0::DOUBLE AS share_filled FROM orders""")
def order_kpis(spark, d):
    return rounded(analysis.kpis(table(spark, d, "orders"), "o_totalprice", "o_custkey"), "total", digits=2)


@report("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def user_span(spark, d):
    return analysis.first_and_last(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"])


@report("""WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS rn FROM t)
SELECT CASE WHEN rn <= 5 THEN p_brand ELSE 'Other' END AS category, sum(n)::BIGINT AS n, round(sum(n) / (SELECT count(*) FROM part)::DOUBLE, 8) AS share FROM r GROUP BY 1""")
def brand_distribution(spark, d):
    return rounded(analysis.distribution(table(spark, d, "part"), "p_brand", 5), "share", digits=8)

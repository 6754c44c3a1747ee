"""Ranking and set-operation queries."""

from pyspark.sql import functions as F

from seriesloom.operators import ranking as R
from seriesloom.plans.catalog import query


@query("i01_top_n", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25""")
def _(t):
    return R.top_n(t.part.select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", "p_partkey", 25)


@query("i01_bottom_n", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 20""")
def _(t):
    return R.top_n(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 20, ascending=True)


@query("i02_rank_change", """
WITH y AS (SELECT o_custkey, count(*) FILTER (year(o_orderdate) <= 1997) AS n0, count(*) FILTER (year(o_orderdate) >= 1999) AS n1 FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n0 DESC, o_custkey) AS rank_before, row_number() OVER (ORDER BY n1 DESC, o_custkey) AS rank_after FROM y)
SELECT o_custkey, rank_before, rank_after, rank_before - rank_after AS rank_change FROM r""")
def _(t):
    y = t.orders.groupBy("o_custkey").agg(F.count_if(F.year("o_orderdate") <= 1997).alias("n0"), F.count_if(F.year("o_orderdate") >= 1999).alias("n1"))
    return R.rank_change(y, "o_custkey", "n0", "n1").drop("n0", "n1")


@query("i03_top_k_per_group", """
SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 10""")
def _(t):
    o = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return R.top_k_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query("i04_arg_row", """
SELECT l_suppkey, l_extendedprice, l_orderkey * 10 + l_linenumber AS line, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def _(t):
    li = t.lineitem.withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.arg_row(li, ["l_suppkey"], "l_extendedprice", "line", ["l_quantity"])


@query("i05_slim_projection", """
SELECT p_partkey, round(p_retailprice, 1) AS price, p_brand || '/' || p_type AS label FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50""")
def _(t):
    top = R.top_n(t.part, "p_retailprice", "p_partkey", 50)
    return top.select("p_partkey", F.round("p_retailprice", 1).alias("price"), F.concat_ws("/", "p_brand", "p_type").alias("label"))


@query("i06_interleave", """
WITH d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS turn FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM d))
SELECT c_custkey, c_mktsegment, turn, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 4 END AS INTEGER) AS place FROM r""")
def _(t):
    done = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    rest = R.remaining(t.customer.select("c_custkey", "c_mktsegment"), done, ["c_custkey"])
    return R.interleave(rest, "c_mktsegment", "c_custkey", ["MACHINERY", "BUILDING", "FURNITURE"])


@query("j01_union_ids", """
SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 UNION SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000""")
def _(t):
    ids = t.orders.select("o_custkey", F.year("o_orderdate").alias("yr"))
    return ids.filter("yr = 1996").select("o_custkey").union(ids.filter("yr = 2000").select("o_custkey")).distinct()


@query("j02_common_months", """
SELECT ym FROM (SELECT strftime(o_orderdate, '%Y-%m') AS ym FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    a = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    return R.common(a, t.lineitem.filter("l_returnflag = 'R'").select(F.date_format("l_shipdate", "yyyy-MM").alias("ym")))


@query("j03_remaining_keys", """
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000""")
def _(t):
    done = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return R.remaining(t.customer.select("c_custkey"), done, ["c_custkey"])


@query("j04_merged_methods", """
WITH u AS (SELECT doc_id, 'digits' AS m FROM documents WHERE regexp_matches(text, '[0-9]') UNION SELECT doc_id, 'long' FROM documents WHERE n_chars > 3000 UNION SELECT doc_id, 'english' FROM documents WHERE lang = 'en')
SELECT doc_id, string_agg(m, '|' ORDER BY m) AS methods FROM u GROUP BY 1""")
def _(t):
    d = t.documents
    out = R.merged_methods({"digits": d.filter(F.col("text").rlike("[0-9]")), "long": d.filter("n_chars > 3000"), "english": d.filter("lang = 'en'")}, "doc_id")
    return out.select("doc_id", F.concat_ws("|", "methods").alias("methods"))

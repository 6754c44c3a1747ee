"""Cleaning and validation queries."""

from pyspark.sql import functions as F

from seriesloom.operators.quality import (clean_sentinels, covered_mean, flag_quality, period_slice, profile_quality,
                                          quality_cuts, skip_accounting)
from seriesloom.plans.catalog import query


@query("b01_clean_sentinels", """
SELECT event_type, count(*) AS n_rows, count(v) AS n_valid, round(avg(v), 6) AS mean_valid
FROM (SELECT event_type, CASE WHEN value <= 5.0 THEN NULL ELSE value END AS v FROM events) GROUP BY event_type""")
def _(t):
    return (clean_sentinels(t.events, ["value"], at_most=5.0, negative=True).groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_valid"),
                 F.round(F.avg("value"), 6).alias("mean_valid")))


@query("b02_profile_quality", """
SELECT l_returnflag, count(*) AS n_rows, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day,
  strftime(max(l_shipdate), '%Y-%m-%d') AS last_day,
  count(*) FILTER (l_discount IS NULL) AS discount_nulls,
  round(100.0 * count(*) FILTER (l_discount IS NULL) / count(*), 4) AS discount_null_pct,
  min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max,
  count(*) FILTER (l_tax < l_discount - 0.05 OR l_tax > l_quantity + 0.05) AS range_violations
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    p = profile_quality(t.lineitem, ["l_returnflag"], "l_shipdate", ["l_discount", "l_extendedprice"],
                        between=("l_discount", "l_tax", "l_quantity", 0.05))
    return p.select("l_returnflag", "n_rows", F.date_format("first_time", "yyyy-MM-dd").alias("first_day"),
                    F.date_format("last_time", "yyyy-MM-dd").alias("last_day"),
                    F.col("l_discount_nulls").alias("discount_nulls"),
                    F.round("l_discount_null_pct", 4).alias("discount_null_pct"),
                    F.col("l_extendedprice_min").alias("price_min"), F.col("l_extendedprice_max").alias("price_max"),
                    "range_violations")


@query("b03_min_coverage", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(value) AS n_valid, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1, 2 HAVING count(value) >= 3""")
def _(t):
    days = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return covered_mean(days, ["user_id", "day"], "value", 3).withColumn("mean_value", F.round("mean_value", 6))


@query("b04_quality_cuts", """
SELECT p_partkey, round(f, 8) AS frac_err, round(CASE WHEN f > 0 THEN 1.0 / (f * v * f * v) ELSE 1.0 END, 8) AS weight
FROM (SELECT p_partkey, v, CASE WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN greatest(abs(e1), abs(e2)) / v
                                WHEN e1 IS NOT NULL THEN abs(e1) / v END AS f
      FROM (SELECT p_partkey, p_retailprice AS v, CASE WHEN p_size % 7 <> 0 THEN p_size * 6.0 END AS e1,
                   CASE WHEN p_size % 5 <> 0 THEN p_size * -5.5 END AS e2 FROM part)
      WHERE v > 0 AND v BETWEEN 905 AND 990)
WHERE f IS NULL OR f <= 0.2""")
def _(t):
    src = t.part.select("p_partkey", "p_retailprice",
                        F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 6.0).alias("up"),
                        F.when(F.col("p_size") % 5 != 0, F.col("p_size") * -5.5).alias("down"))
    return (quality_cuts(src, "p_retailprice", "up", "down", 905, 990)
            .select("p_partkey", F.round("frac_err", 8).alias("frac_err"), F.round("weight", 8).alias("weight")))


@query("b05_flag_quality", """
SELECT p_partkey, concat_ws('|', CASE WHEN p_brand IN ('Brand#3', 'Brand#11') OR p_retailprice > 995 THEN 'inflated' END,
  CASE WHEN lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' THEN 'named' END,
  CASE WHEN p_size > 45 THEN 'oversize' END) AS flags FROM part""")
def _(t):
    name = F.lower("p_name")
    flags = {"inflated": F.col("p_brand").isin("Brand#3", "Brand#11") | (F.col("p_retailprice") > 995),
             "named": name.contains("ring") | name.contains("bolt"), "oversize": F.col("p_size") > 45}
    return flag_quality(t.part, flags).select("p_partkey", F.concat_ws("|", "flags").alias("flags"))


@query("b06_skip_accounting", """
WITH o AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT CASE WHEN o.o_custkey IS NULL THEN 'no_orders' WHEN c_acctbal < 0 THEN 'negative_balance'
  WHEN n_orders < 5 THEN 'few_orders' WHEN total < 1000000 THEN 'low_value' ELSE 'kept' END AS reason,
  count(*) AS n
FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1""")
def _(t):
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    both = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return skip_accounting(both, [("no_orders", F.col("o_custkey").isNull()),
                                  ("negative_balance", F.col("c_acctbal") < 0),
                                  ("few_orders", F.col("n_orders") < 5), ("low_value", F.col("total") < 1000000)])


@query("b07_period_slice", """
SELECT period, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN (VALUES ('full', 1995, 2001), ('early', 1995, 1997), ('late', 1998, 2001), ('last_two', 2000, 2001))
  p(period, lo, hi) ON year(o_orderdate) BETWEEN lo AND hi GROUP BY period""")
def _(t):
    yearly = t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    sliced = period_slice(yearly, "yr", [("full", 1995, 2001), ("early", 1995, 1997), ("late", 1998, 2001),
                                         ("last_two", 2000, 2001)])
    return sliced.groupBy("period").agg(F.sum("n").alias("n_orders"), F.round(F.sum("v"), 2).alias("total"))

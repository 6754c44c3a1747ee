"""Series derived from the test tables, each with its SQL twin as a common table expression.

Values are rounded sums so both engines start from identical numbers.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly(t) -> DataFrame:
    """nation, mi (months since 1995-01), yr, mo, value: one row per nation and month."""
    o = t.orders.select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("yr"),
                        F.month("o_orderdate").alias("mo"))
    c = t.customer.select("c_custkey", "c_nationkey")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("nation"), "yr", "mo")
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n"))
            .withColumn("mi", ((F.col("yr") - 1995) * 12 + F.col("mo") - 1)))


MONTHLY = """monthly AS (SELECT c_nationkey AS nation, year(o_orderdate) AS yr, month(o_orderdate) AS mo,
  (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS mi, round(sum(o_totalprice), 2) AS value, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""


def monthly_priority(t) -> DataFrame:
    """priority, mi, yr, mo, value, n: one row per order priority and month."""
    return (t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("yr"),
                             F.month("o_orderdate").alias("mo"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n"))
            .withColumn("mi", ((F.col("yr") - 1995) * 12 + F.col("mo") - 1)))


MPRIO = """mprio AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS yr, month(o_orderdate) AS mo,
  (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS mi, round(sum(o_totalprice), 2) AS value, count(*) AS n
  FROM orders GROUP BY 1, 2, 3, 4)"""


def daily(t) -> DataFrame:
    """event_type, day (string), di (days since 2024-01-01), value: one row per event type and day."""
    return (t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                             F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("di"))
            .agg(F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("n")))


DAILY = """daily AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day,
  date_diff('day', DATE '2024-01-01', ts::DATE) AS di, round(sum(value), 2) AS value, count(*) AS n
  FROM events GROUP BY 1, 2, 3)"""


def hourly(t) -> DataFrame:
    """event_type, hi (hours since 2024-01-01 00:00), value, n: one row per event type and hour."""
    hi = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return (t.events.groupBy("event_type", hi.alias("hi"))
            .agg(F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("n")))


HOURLY = """hourly AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts) AS hi,
  round(sum(value), 2) AS value, count(*) AS n FROM events GROUP BY 1, 2)"""

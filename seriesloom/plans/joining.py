"""Join queries."""

from pyspark.sql import functions as F

from seriesloom.operators.joins import (box_join, first_box, first_overlap, month_fallback, nearest_within,
                                        neighbourhood_join, series_pairs, share_of_global, snapshot_compare)
from seriesloom.operators.split import neighbours
from seriesloom.operators.thinning import thin_events
from seriesloom.plans.catalog import query
from seriesloom.plans.inputs import DAILY, MONTHLY, daily, monthly

BOXES = [("low_small", 900.0, 930.0, 1.0, 20.0), ("low_small", 960.0, 999.9, 41.0, 50.0),
         ("middle", 920.0, 970.0, 10.0, 40.0), ("wide", 900.0, 999.9, 25.0, 30.0)]
REGIONS = [("north", 0.0, 40.0, 0.0, 50.0), ("centre", 20.0, 80.0, 10.0, 90.0), ("south", 60.0, 200.0, 0.0, 60.0)]
KNOWN = [("opening", "2024-01-01", "2024-01-04"), ("second_week", "2024-01-08", "2024-01-14"),
         ("mid_month", "2024-01-13", "2024-01-20")]


def catalogue(t):
    """Events as a catalogue with positions and a magnitude from whole-table columns."""
    return t.events.select(
        F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        (F.col("value") / 50.0 + 2).alias("mag"),
        ((F.col("user_id") * 7919) % 1400 / 10.0 - 70).alias("lat"),
        ((F.col("user_id") * 104729) % 3600 / 10.0 - 180).alias("lon"))


CATALOGUE = """cat AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t, value / 50.0 + 2 AS mag,
  (user_id * 7919) % 1400 / 10.0 - 70 AS lat, (user_id * 104729) % 3600 / 10.0 - 180 AS lon FROM events)"""


@query("c01_equi_join", """
SELECT n_name, count(*) AS n_orders, count(o_orderkey) AS n_matched, round(sum(o_totalprice), 2) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(t):
    return (t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.count("o_orderkey").alias("n_matched"),
                                   F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("c02_snapshot_compare", """
WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.n, 0) AS "before", coalesce(a.n, 0) AS "after"
FROM (SELECT * FROM y WHERE yr = 1996) b FULL JOIN (SELECT * FROM y WHERE yr = 2000) a ON a.o_custkey = b.o_custkey""")
def _(t):
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    return snapshot_compare(y.filter("yr = 1996"), y.filter("yr = 2000"), ["o_custkey"], "n")


@query("c03_box_join", """
SELECT DISTINCT p_partkey, box FROM part JOIN (VALUES ('low_small', 900.0, 930.0, 1.0, 20.0),
  ('low_small', 960.0, 999.9, 41.0, 50.0), ('middle', 920.0, 970.0, 10.0, 40.0), ('wide', 900.0, 999.9, 25.0, 30.0))
  b(box, a, b, c, d) ON p_retailprice BETWEEN a AND b AND p_size BETWEEN c AND d""")
def _(t):
    return box_join(t.part.select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size",
                    BOXES).select("p_partkey", "box")


@query("c04_first_box", """
SELECT CASE WHEN value IS NULL THEN 'unknown' WHEN value BETWEEN 0 AND 40 AND k BETWEEN 0 AND 50 THEN 'north'
  WHEN value BETWEEN 20 AND 80 AND k BETWEEN 10 AND 90 THEN 'centre'
  WHEN value BETWEEN 60 AND 200 AND k BETWEEN 0 AND 60 THEN 'south' ELSE 'elsewhere' END AS region, count(*) AS n
FROM (SELECT value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return (t.events.groupBy(first_box(F.col("value"), k, REGIONS, "elsewhere").alias("region"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("c05_interval_overlap", """
WITH s AS (SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
           FROM events WHERE event_type = 'error' GROUP BY user_id, date_diff('day', DATE '2024-01-01', ts::DATE) // 5)
SELECT user_id, first_day, last_day, CASE WHEN first_day <= '2024-01-04' THEN 'opening'
  WHEN first_day <= '2024-01-14' AND last_day >= '2024-01-08' THEN 'second_week'
  WHEN first_day <= '2024-01-20' AND last_day >= '2024-01-13' THEN 'mid_month' ELSE 'none' END AS known FROM s""")
def _(t):
    block = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 5)
    spans = (t.events.filter("event_type = 'error'").groupBy("user_id", block.alias("block"))
             .agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
                  F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day")).drop("block"))
    return spans.withColumn("known", first_overlap(F.col("first_day"), F.col("last_day"), KNOWN, "none"))


@query("c06_nearest_within", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, value FROM events),
a AS (SELECT e.event_id, e.t, o.t AS ot, o.value AS ov FROM e ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') o
      ON e.user_id = o.user_id AND e.t >= o.t WHERE e.event_type = 'purchase'),
b AS (SELECT e.event_id, o.t AS nt, o.value AS nv FROM e ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') o
      ON e.user_id = o.user_id AND e.t <= o.t WHERE e.event_type = 'purchase'),
m AS (SELECT a.event_id, t - ot AS back, nt - t AS ahead, ov, nv,
        CASE WHEN ot IS NULL THEN FALSE WHEN nt IS NULL THEN TRUE ELSE t - ot <= nt - t END AS ub FROM a JOIN b USING (event_id))
SELECT event_id, CASE WHEN ub AND back < 36000 THEN ov WHEN NOT ub AND ahead < 36000 THEN nv END AS value,
  round(CASE WHEN ub AND back < 36000 THEN back WHEN NOT ub AND ahead < 36000 THEN ahead END, 4) AS gap FROM m""")
def _(t):
    e = t.events.select("event_id", "user_id", "event_type", "value",
                        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    out = nearest_within(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "t",
                         "event_id", "value", 36000.0)
    return out.select("event_id", "value", F.round("gap", 4).alias("gap"))


@query("c07_month_fallback", f"""
WITH {MONTHLY}, k AS (SELECT * FROM monthly WHERE (mi * 7 + nation) % 3 = 0),
w AS (SELECT DISTINCT nation, yr FROM monthly),
c AS (SELECT w.nation, w.yr, p.prio, CASE WHEN p.prio = 5 THEN (w.yr - 1995) * 12 + 11 ELSE (w.yr - 1995) * 12 + 8 + off END AS mi
      FROM w, (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2), (5, 0)) p(prio, off))
SELECT c.nation, c.yr, CAST(9 AS INTEGER) AS mo, arg_min(k.value, c.prio) AS value
FROM c LEFT JOIN k ON k.nation = c.nation AND k.mi = c.mi GROUP BY 1, 2""")
def _(t):
    m = monthly(t)
    known = m.filter((F.col("mi") * 7 + F.col("nation")) % 3 == 0)
    wanted = m.select("nation", "yr").distinct().withColumn("mo", F.lit(9))
    return month_fallback(wanted, known, ["nation"], "yr", "mo", "value").withColumn("yr", F.col("yr").cast("bigint"))


@query("c08_previous_state", """
SELECT conv_id, turn, role, length(text) AS n_chars, lag(role) OVER w AS prev_role,
  CAST(coalesce(length(text) - lag(length(text)) OVER w, 0) AS BIGINT) AS change
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t):
    c = t.conversations.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))
    prev = neighbours(c, ["conv_id"], "turn", before={"role": "prev_role", "n_chars": "prev_chars"})
    return prev.select("conv_id", "turn", "role", "n_chars", "prev_role",
                       F.coalesce(F.col("n_chars") - F.col("prev_chars"), F.lit(0).cast("bigint")).alias("change"))


@query("c09_neighbourhood_join", f"""
WITH {CATALOGUE}, m AS (SELECT * FROM cat WHERE mag >= 7),
p AS (SELECT m.id AS m_id, c.id, c.t - m.t AS gap_s, 2 * 6371.0 * asin(sqrt(least(1.0,
   pow(sin(radians(c.lat - m.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - m.lon) / 2), 2)))) AS d,
   least(1000.0, pow(10, 0.5 * m.mag - 1.78)) AS r
 FROM m JOIN cat c ON c.t - m.t > 10 AND c.t - m.t <= 90 * 86400.0)
SELECT m_id, count(*) AS n_after, round(avg(gap_s), 3) AS mean_gap, round(avg(d), 4) AS mean_km FROM p WHERE d <= r GROUP BY m_id""")
def _(t):
    cat = catalogue(t)
    radius = F.pow(F.lit(10.0), 0.5 * F.col("m_mag") - 1.78)
    pairs = neighbourhood_join(cat.filter("mag >= 7"), cat.select("id", "t", "lat", "lon"), 90, radius, 1000.0)
    return pairs.groupBy("m_id").agg(F.count(F.lit(1)).alias("n_after"), F.round(F.avg("gap_s"), 3).alias("mean_gap"),
                                     F.round(F.avg("dist_km"), 4).alias("mean_km"))


def _kept_in_turn(where: str) -> str:
    return f"""
WITH RECURSIVE {CATALOGUE}, o AS (SELECT *, row_number() OVER (ORDER BY mag DESC, id) AS r FROM cat WHERE {where}),
g(r, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, t DOUBLE, lat DOUBLE, lon DOUBLE)[] UNION ALL
  SELECT o.r, CASE WHEN len(list_filter(kept, lambda s: o.t > s.t AND (o.t - s.t < 172800 OR (o.t - s.t < 7776000 AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(o.lat - s.lat) / 2), 2)
    + cos(radians(s.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - s.lon) / 2), 2)))) < 300)))) = 0
   THEN list_append(kept, {{'id': o.id, 't': o.t::DOUBLE, 'lat': o.lat::DOUBLE, 'lon': o.lon::DOUBLE}}) ELSE kept END FROM g JOIN o ON o.r = g.r + 1),
k AS (SELECT unnest(kept).id AS id FROM g WHERE r = (SELECT count(*) FROM o))
SELECT id, round(mag, 4) AS mag, round(t, 3) AS t FROM cat JOIN k USING (id)"""


@query("c10_thin_events", _kept_in_turn("mag >= 6"))
def _(t):
    kept = thin_events(catalogue(t).filter("mag >= 6"))
    return kept.select("id", F.round("mag", 4).alias("mag"), F.round("t", 3).alias("t"))


@query("c10_thin_catalogue", _kept_in_turn("TRUE"))
def _(t):
    """Every event, without a cut in magnitude."""
    return thin_events(catalogue(t)).select("id", F.round("mag", 4).alias("mag"), F.round("t", 3).alias("t"))


@query("c11_series_pairs", f"""
WITH {DAILY} SELECT a.event_type AS key_a, b.event_type AS key_b, count(*) AS n_slots,
  round(sum(a.value * b.value), 2) AS sum_xy FROM daily a JOIN daily b ON a.di = b.di AND a.event_type < b.event_type GROUP BY 1, 2""")
def _(t):
    return (series_pairs(daily(t), ["di"], "event_type", "value").groupBy("key_a", "key_b")
            .agg(F.count(F.lit(1)).alias("n_slots"), F.round(F.sum(F.col("x") * F.col("y")), 2).alias("sum_xy")))


@query("c12_global_share", """
WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT o_orderpriority, round(total, 2) AS total, round(total / (SELECT sum(total) FROM g), 8) AS share FROM g""")
def _(t):
    return share_of_global(t.orders, ["o_orderpriority"], "o_totalprice").select(
        "o_orderpriority", F.round("total", 2).alias("total"), F.round("share", 8).alias("share"))


@query("c13_semi_anti", """
SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)) AS n_in,
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)) AS n_out
FROM customer GROUP BY 1""")
def _(t):
    big = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    inside = t.customer.join(big, "c_custkey", "left_semi").withColumn("side", F.lit(1))
    outside = t.customer.join(big, "c_custkey", "left_anti").withColumn("side", F.lit(0))
    return inside.union(outside).groupBy("c_mktsegment").agg(
        F.count_if(F.col("side") == 1).alias("n_in"), F.count_if(F.col("side") == 0).alias("n_out"))

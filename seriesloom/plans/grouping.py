"""Group aggregation queries."""

from pyspark.sql import functions as F

from seriesloom.functions.scalars import day_of_year_365, decade
from seriesloom.operators import aggregates as A
from seriesloom.plans.catalog import query
from seriesloom.plans.inputs import MONTHLY, MPRIO, monthly, monthly_priority


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("d01_period_mean", """
SELECT o_orderstatus, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*) AS n,
  round(avg(o_totalprice), 4) AS mean_value FROM orders GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(t):
    out = A.period_mean(t.orders, ["o_orderstatus"], "o_orderdate", "o_totalprice", "month", at_least=20)
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


SEASON = """CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"""


@query("d02_season_mean", f"""
SELECT o_orderpriority, year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS season_year,
  {SEASON} AS season, count(*) AS n, round(avg(o_totalprice), 4) AS mean_value FROM orders GROUP BY 1, 2, 3 HAVING count(*) >= 50""")
def _(t):
    out = A.season_mean(t.orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", at_least=50)
    return rounded(out.withColumn("season_year", F.col("season_year").cast("bigint")), 4, "mean_value")


@query("d02_season_mean_calendar", f"""
SELECT year(o_orderdate) AS season_year, {SEASON} AS season, count(*) AS n, round(avg(o_totalprice), 4) AS mean_value
FROM orders GROUP BY 1, 2""")
def _(t):
    out = A.season_mean(t.orders, [], "o_orderdate", "o_totalprice", december_to_next=False)
    return rounded(out.withColumn("season_year", F.col("season_year").cast("bigint")), 4, "mean_value")


@query("d03_describe", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS "min", max(l_extendedprice) AS "max",
  round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS "median", round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
  round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
  round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr,
  round(stddev_samp(l_extendedprice) / avg(l_extendedprice), 8) AS cv FROM lineitem GROUP BY 1, 2""")
def _(t):
    out = A.describe(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rounded(rounded(out, 4, "mean", "std", "p5", "p25", "median", "p75", "p95", "iqr"), 8, "cv")


@query("d03_quantile_variants", """
SELECT event_type, list_sort(list(value))[1 + CAST(floor(count(*) * 0.1) AS BIGINT)] AS p10_floor,
  list_sort(list(value))[1 + CAST(floor(count(*) * 0.9) AS BIGINT)] AS p90_floor,
  list_sort(list(value))[1 + count(*) // 2] AS upper_median FROM events GROUP BY 1""")
def _(t):
    from seriesloom.operators.split import exact_quantiles
    return exact_quantiles(t.events, ["event_type"], "value",
                           {"p10_floor": 0.1, "p90_floor": 0.9, "upper_median": 0.5}, method="floor")


@query("d04_exceedance_count", """
WITH b AS (SELECT event_type, quantile_cont(value, 0.95) AS cut FROM events WHERE ts < TIMESTAMP '2024-01-11'
           GROUP BY 1 HAVING count(*) >= 20)
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(value) AS n_valid, count(*) FILTER (value > cut) AS n_beyond,
  round(max(cut), 6) AS threshold FROM events JOIN b USING (event_type) GROUP BY 1, 2 HAVING count(value) >= 5""")
def _(t):
    e = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = A.exceedance_count(e, ["event_type"], "day", "value", percentile=0.95, baseline=F.col("ts") < "2024-01-11",
                             min_baseline=20, min_valid=5)
    return rounded(out, 6, "threshold")


@query("d04_exceedance_fixed", """
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(value) AS n_valid, count(*) FILTER (value < 5) AS n_beyond,
  5.0::DOUBLE AS threshold FROM events GROUP BY 1, 2""")
def _(t):
    e = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return A.exceedance_count(e, ["event_type"], "day", "value", threshold=5.0, above=False)


@query("d05_weighted_mean", """
SELECT l_suppkey, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8) AS weighted_mean, count(*) AS n
FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(A.weighted_mean(t.lineitem, ["l_suppkey"], F.col("l_discount"), F.col("l_extendedprice")), 8, "weighted_mean")


@query("d06_share_of_total", """
SELECT strftime(l_shipdate, '%Y-%m') AS ym, l_returnflag, round(sum(l_quantity), 2) AS total,
  round(100.0 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY strftime(l_shipdate, '%Y-%m')), 6) AS share_pct
FROM lineitem GROUP BY 1, 2""")
def _(t):
    li = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("ym"), "l_returnflag", "l_quantity")
    return rounded(A.share_of_total(li, ["ym"], "l_returnflag", "l_quantity"), 6, "share_pct")


@query("d07_climatology_anomaly", f"""
WITH {MONTHLY}, b AS (SELECT nation, mo, avg(value) AS normal FROM monthly WHERE yr BETWEEN 1995 AND 1998 GROUP BY 1, 2)
SELECT nation, m.mi, round(normal, 4) AS normal, round(value - normal, 4) AS anomaly FROM monthly m LEFT JOIN b USING (nation, mo)""")
def _(t):
    out = A.climatology_anomaly(monthly(t), ["nation"], "mo", "value", F.col("yr").between(1995, 1998))
    return rounded(out.select("nation", F.col("mi").cast("bigint").alias("mi"), "normal", "anomaly"), 4, "normal", "anomaly")


SLOT = "CAST(hour(ts) * 2 + minute(ts) // 30 AS INTEGER)"


@query("d08_diurnal_profile", f"""
WITH p AS (SELECT event_type, {SLOT} AS slot, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type, round(min(v), 6) AS low, round(max(v), 6) AS high, arg_min(slot, v) AS low_slot,
  arg_max(slot, v) AS high_slot, round(max(v) - min(v), 6) AS value_range FROM p GROUP BY 1""")
def _(t):
    p = A.diurnal_profile(t.events, ["event_type"], "ts", "value")
    return rounded(A.profile_extremes(p, ["event_type"]), 6, "low", "high", "value_range")


@query("d09_profile_features", f"""
WITH p AS (SELECT event_type, {SLOT} AS slot, avg(value) AS v FROM events GROUP BY 1, 2),
s AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type ORDER BY slot) AS step FROM p),
m AS (SELECT event_type, max(step) AS max_ramp, avg(v) FILTER (slot >= 22 AND slot < 30) AS belly,
  avg(v) FILTER (slot >= 34 AND slot < 42) AS peak, avg(v) FILTER (slot < 12) AS night FROM s GROUP BY 1)
SELECT event_type, round(max_ramp, 6) AS max_ramp, round(belly, 6) AS belly, round(peak, 6) AS peak,
  round(night, 6) AS night, round(belly / peak, 6) AS belly_peak_ratio, round(peak - belly, 6) AS dip_depth FROM m""")
def _(t):
    p = A.diurnal_profile(t.events, ["event_type"], "ts", "value")
    out = A.profile_features(p, ["event_type"], {"belly": (22, 30), "peak": (34, 42), "night": (0, 12)})
    return rounded(out, 6, "max_ramp", "belly", "peak", "night", "belly_peak_ratio", "dip_depth")


@query("d10_bin_stats", """
SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS "median", round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
  CAST(floor(l_quantity / 5) * 5 + 2.5 AS DOUBLE) AS center FROM lineitem GROUP BY floor(l_quantity / 5)""")
def _(t):
    return rounded(A.bin_stats(t.lineitem, "l_quantity", "l_extendedprice", 5.0), 4, "mean", "std", "p10", "median", "p90")


@query("d11_histogram", """
WITH b AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, bin, n, CAST(sum(n) OVER w AS BIGINT) AS n_at_least, round(log10(sum(n) OVER w), 8) AS log_n
FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bin DESC)""")
def _(t):
    e = t.events.withColumn("tens", F.col("value") / 10)
    return rounded(A.histogram(e, ["event_type"], "tens", scale=1), 8, "log_n")


@query("d12_histogram_2d", """
SELECT p_type, CAST(floor((log10(p_retailprice) - 2.95) / 0.005) + 1 AS BIGINT) AS xb,
  CAST(floor(log10(p_size) / 0.2) + 1 AS BIGINT) AS yb, count(*) AS n FROM part
WHERE log10(p_retailprice) >= 2.95 AND log10(p_retailprice) < 3.0 AND log10(p_size) >= 0 AND log10(p_size) < 2 GROUP BY 1, 2, 3""")
def _(t):
    return A.histogram_2d(t.part, ["p_type"], "p_retailprice", "p_size", (2.95, 3.0, 10), (0.0, 2.0, 10))


@query("d13_crosstab", """
SELECT o_orderpriority, CAST(yr AS VARCHAR) AS level, count(o_orderkey) AS n
FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN generate_series(1994, 2001) g(yr)
LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND year(o_orderdate) = yr GROUP BY p.o_orderpriority, yr""".replace(
    "SELECT o_orderpriority, CAST(yr", "SELECT p.o_orderpriority, CAST(yr"))
def _(t):
    return A.crosstab(t.orders.withColumn("yr", F.year("o_orderdate")), "o_orderpriority", "yr", range(1994, 2002))


@query("d13_crosstab_rest", """
SELECT p.o_orderpriority, level, count(o_orderkey) AS n
FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (VALUES ('1996'), ('1997'), ('1998'), ('other years')) g(level)
LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND level = CASE WHEN year(o_orderdate) IN (1996, 1997, 1998) THEN year(o_orderdate)::VARCHAR ELSE 'other years' END
GROUP BY 1, 2""")
def _(t):
    return A.crosstab(t.orders.withColumn("yr", F.year("o_orderdate")), "o_orderpriority", "yr", [1996, 1997, 1998], "other years")


@query("d13_decade_crosstab", """
SELECT l_returnflag, CAST(d AS VARCHAR) AS level, count(l_orderkey) AS n
FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem) CROSS JOIN (VALUES (1980), (1990), (2000)) g(d)
LEFT JOIN lineitem ON l_returnflag = f AND year(l_shipdate) // 10 * 10 = d GROUP BY l_returnflag, f, d""".replace(
    "SELECT l_returnflag, CAST", "SELECT f AS l_returnflag, CAST").replace("GROUP BY l_returnflag, f, d", "GROUP BY f, d"))
def _(t):
    li = t.lineitem.withColumn("dec", decade(F.year("l_shipdate")))
    return A.crosstab(li, "l_returnflag", "dec", [1980, 1990, 2000])


@query("d14_shannon_entropy", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT user_id, n, n * 1.0 / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, count(*) AS n_categories, CAST(sum(n) AS DOUBLE) AS n_total,
  round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) ELSE 0 END, 8) AS entropy FROM s GROUP BY 1""")
def _(t):
    return rounded(A.shannon_entropy(t.events, ["user_id"], "event_type"), 8, "entropy")


@query("d15_gini", """
WITH r AS (SELECT c_mktsegment, abs(c_acctbal) AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal)) AS i FROM customer)
SELECT c_mktsegment, count(*) AS n, round((2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 8) AS gini FROM r GROUP BY 1""")
def _(t):
    c = t.customer.withColumn("x", F.abs("c_acctbal"))
    return rounded(A.gini(c, ["c_mktsegment"], "x"), 8, "gini")


@query("d16_group_divergence", f"""
WITH {MPRIO} SELECT mi, round(stddev_pop(value), 3) AS spread, round(max(value) - min(value), 2) AS value_range,
  arg_max(priority, value) AS highest, arg_min(priority, value) AS lowest, count(*) AS n_groups FROM mprio GROUP BY 1""")
def _(t):
    out = A.group_divergence(monthly_priority(t).withColumn("mi", F.col("mi").cast("bigint")), ["mi"], "priority", "value")
    return rounded(rounded(out, 3, "spread"), 2, "value_range")


@query("d17_dispersion_of_gaps", """
WITH g AS (SELECT user_id, (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400.0 AS d FROM events),
s AS (SELECT user_id, count(d) AS n_gaps, avg(d) AS m, stddev_pop(d) AS sd, quantile_cont(d, 0.5) AS md FROM g WHERE d IS NOT NULL GROUP BY 1 HAVING count(d) >= 2)
SELECT user_id, n_gaps, round(m, 6) AS mean_days, round(sd, 6) AS std_days, round(md, 6) AS median_days,
  round(sd / m, 6) AS cv, round(sd / m * (sd / m), 6) AS dispersion,
  CASE WHEN sd / m > 1.2 THEN 'clustered' WHEN sd / m < 0.8 THEN 'quasi-periodic' ELSE 'approximately_poisson' END AS pattern FROM s""")
def _(t):
    out = A.dispersion_of_gaps(t.events, ["user_id"], "ts", "event_id")
    return rounded(out, 6, "mean_days", "std_days", "median_days", "cv", "dispersion")


@query("d19_calendar_densify", """
WITH c AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS di, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT user_id, unnest(generate_series(min(di), max(di))) AS di FROM c GROUP BY 1)
SELECT s.user_id, s.di, coalesce(c.n, 0) AS n FROM s LEFT JOIN c USING (user_id, di)""")
def _(t):
    di = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return A.calendar_densify(t.events.groupBy("user_id", di.alias("di")).agg(F.count(F.lit(1)).alias("n")),
                              ["user_id"], "di", "n")


@query("d20_category_totals", """
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, o_orderpriority AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT ym, round(sum(v), 2) AS total, max(round(v, 2)) FILTER (k = '1-URGENT') AS urgent,
  max(round(v, 2)) FILTER (k = '5-LOW') AS low, count(*) AS n_categories FROM c GROUP BY 1""")
def _(t):
    o = t.orders.withColumn("ym", F.date_format("o_orderdate", "yyyy-MM"))
    out = A.category_totals(o, ["ym"], "o_orderpriority", "o_totalprice")
    return out.select("ym", "total", F.col("by_category")["1-URGENT"].alias("urgent"),
                      F.col("by_category")["5-LOW"].alias("low"), F.size("by_category").cast("bigint").alias("n_categories"))


DOY = "list_extract([0,31,59,90,120,151,181,212,243,273,304,334], month(o_orderdate)) + day(o_orderdate)"


@query("d21_cumulative_share", f"""
WITH d AS (SELECT year(o_orderdate) AS yr, CAST({DOY} AS BIGINT) AS doy, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
r AS (SELECT yr, doy, sum(v) OVER (PARTITION BY yr ORDER BY doy) AS run, sum(v) OVER (PARTITION BY yr) AS whole FROM d)
SELECT yr, min(doy) FILTER (run >= 0.25 * whole) AS q25_day, min(doy) FILTER (run >= 0.5 * whole) AS q50_day FROM r GROUP BY 1""")
def _(t):
    d = (t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("yr"), day_of_year_365(F.col("o_orderdate")).cast("bigint").alias("doy"))
         .agg(F.round(F.sum("o_totalprice"), 2).alias("v")))
    return A.cumulative_share_point(d, ["yr"], "doy", "v", {"q25_day": 0.25, "q50_day": 0.5})


@query("d22_duplicates", """
SELECT count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1""")
def _(t):
    return A.duplicates(t.documents, "text", "doc_id").drop("digest")


@query("d23_distinct_periods", """
SELECT c_nationkey AS nation, count(DISTINCT year(o_orderdate)) AS n_years, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_months,
  strftime(min(o_orderdate), '%Y-%m-%d') AS record_start, strftime(max(o_orderdate), '%Y-%m-%d') AS record_end
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) >= 5""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"), "o_orderdate")
    out = A.distinct_periods(o, ["nation"], "yr", "mo", "o_orderdate", 5)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("record_start", "record_end")})


@query("d24_grouped_count", """
SELECT year(o_orderdate) AS yr, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 GROUP BY 1, 2""")
def _(t):
    o = t.orders.withColumn("yr", F.year("o_orderdate").cast("bigint"))
    return A.grouped_count(o, (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 100000), ["yr", "o_orderpriority"])

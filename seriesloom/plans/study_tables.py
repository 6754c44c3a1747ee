"""Further result tables of the studies: group tests, rate changes, gap and magnitude tables, share switching, breaks."""

from pyspark.sql import functions as F

from seriesloom.operators import aggregates as A
from seriesloom.operators import episodes as G
from seriesloom.operators import stats as S
from seriesloom.operators.joins import first_box
from seriesloom.operators.split import with_group_stats
from seriesloom.operators.windows import by_time
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import rounded
from seriesloom.plans.inputs import DAILY, MONTHLY, daily, monthly
from seriesloom.plans.joining import CATALOGUE, catalogue
from seriesloom.plans.sourcing import REGION_CASE
from seriesloom.plans.sqlstats import p_chi2_even, p_normal, p_t
from seriesloom.plans.trends import line_sql, rates_sql
from seriesloom.plans.windowing import long_cols
from seriesloom.sources import dimensions as D

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
GAUGES = f"""{MONTHLY}, f AS ({line_sql('monthly', 'nation', 'mi', 'value')}),
sl AS (SELECT r_name AS g, round(slope, 4) AS v FROM f JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def gauge_slopes(t):
    """region, slope: the trend of every nation's monthly series."""
    fit = S.ols_trend(monthly(t), ["nation"], "mi", "value", tests=False)
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))
    return fit.join(named, "nation").select("region", F.round("slope", 4).alias("slope"))


@query("q06_region_tests", f"""
WITH {GAUGES}, c AS (SELECT g, v, count(*) AS c FROM sl GROUP BY 1, 2), s AS (SELECT g, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY 1),
u AS (SELECT a.g AS group_a, b.g AS group_b, sum(a.c * b.c * CASE WHEN b.v < a.v THEN 1.0 WHEN b.v = a.v THEN 0.5 ELSE 0 END) AS u FROM c a JOIN c b ON a.g < b.g GROUP BY 1, 2),
tie AS (SELECT group_a, group_b, sum(t * t * t - t) AS cube FROM (SELECT p.group_a, p.group_b, v, sum(c)::DOUBLE AS t FROM u p JOIN c ON c.g IN (p.group_a, p.group_b) GROUP BY 1, 2, 3) GROUP BY 1, 2),
z AS (SELECT group_a, group_b, a.n AS n_a, b.n AS n_b, CAST(u AS DOUBLE) AS u,
  greatest(abs(u - a.n * b.n / 2.0) - 0.5, 0) / sqrt(a.n * b.n / 12.0 * ((a.n + b.n + 1) - cube / ((a.n + b.n) * (a.n + b.n - 1.0)))) AS z
  FROM u JOIN tie USING (group_a, group_b) JOIN s a ON a.g = group_a JOIN s b ON b.g = group_b)
SELECT group_a, group_b, n_a, n_b, u, round(z, 6) AS z, round({p_normal('z')}, 6) AS p_value FROM z""")
def _(t):
    """Trends of every pair of regions against each other."""
    return rounded(S.mann_whitney_u(gauge_slopes(t), "region", "slope", REGIONS).drop("z_greater", "p_greater"), 6, "z", "p_value")


@query("q06_regions_together", f"""
WITH {GAUGES}, r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM sl), n AS (SELECT count(*) AS m FROM sl),
t AS (SELECT sum(c * c * c - c) AS cube FROM (SELECT count(*)::DOUBLE AS c FROM sl GROUP BY v)), q AS (SELECT count(*) AS k, sum(rs * rs / c) AS q FROM (SELECT sum(r) AS rs, count(*) AS c FROM r GROUP BY g)),
h AS (SELECT k AS n_groups, m AS n, (12.0 / (m * (m + 1.0)) * q - 3 * (m + 1)) / (1 - cube / (m * m * m - m)) AS h FROM n, t, q)
SELECT n_groups, n, round(h, 6) AS h, round({p_chi2_even('h', '(n_groups - 1)')}, 6) AS p_value FROM h""")
def _(t):
    return rounded(S.kruskal_wallis(gauge_slopes(t), "region", "slope"), 6, "h", "p_value")


@query("q06_rate_changes", f"""
WITH {MONTHLY}, {rates_sql('40', 'nation', 'monthly')}, z AS (SELECT nation, b.slope - a.slope AS change, (b.slope - a.slope) / sqrt(a.se * a.se + b.se * b.se) AS z FROM pre a JOIN post b USING (nation)
  WHERE a.n >= 10 AND b.n >= 10), p AS (SELECT n_regionkey AS region, change, {p_normal('z')} AS p FROM z JOIN nation ON nation = n_nationkey)
SELECT region, count(*) AS n, round(avg(change), 4) AS mean_change, count(*) FILTER (p < 0.05) AS n_changed, round(min(p), 6) AS least_p FROM p GROUP BY 1""")
def _(t):
    """Trend before and from month 40 of every nation, per region."""
    rates = S.rate_comparison(monthly(t), ["nation"], "mi", "value", F.lit(40.0)).join(t.nation, F.col("nation") == F.col("n_nationkey"))
    out = rates.groupBy(F.col("n_regionkey").alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("change").alias("mean_change"), F.count_if(F.col("p_difference") < 0.05).alias("n_changed"), F.min("p_difference").alias("least_p"))
    return rounded(rounded(out, 4, "mean_change"), 6, "least_p")


REGIONAL = f"""{CATALOGUE}, r AS (SELECT *, {REGION_CASE.replace('la BETWEEN', 'lat BETWEEN').replace('lo BETWEEN', 'lon BETWEEN')} AS region FROM cat)"""


def regional(t):
    return catalogue(t).withColumn("region", first_box(F.col("lat"), F.col("lon"), D.SEISMIC_REGIONS, "intraplate")).withColumn("ts", F.timestamp_seconds("t"))


@query("q09_magnitudes", f"""
WITH {REGIONAL}, b AS (SELECT region, CAST(floor(mag * 10) AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY region ORDER BY bin DESC) AS BIGINT) AS n_at_least FROM b) SELECT *, round(log10(n_at_least), 6) AS log_n FROM c""")
def _(t):
    """Counts by magnitude and region, and how many reach it."""
    return long_cols(rounded(A.histogram(regional(t), ["region"], "mag", 10), 6, "log_n"), "bin")


@query("q09_gap_fit", f"""
WITH {REGIONAL}, g AS (SELECT region, (t - lag(t) OVER (PARTITION BY region ORDER BY t, id)) / 86400.0 AS d FROM r),
p AS (SELECT region, d, rank() OVER (PARTITION BY region ORDER BY d) - 1 AS lo, count(*) OVER (PARTITION BY region, d) AS c, count(*) OVER (PARTITION BY region) AS n, avg(d) OVER (PARTITION BY region) AS m FROM g WHERE d IS NOT NULL)
SELECT region, max(n) AS n, round(max(greatest(abs((lo + c)::DOUBLE / n - (1 - exp(-d / m))), abs(1 - exp(-d / m) - lo::DOUBLE / n))), 5) AS d, round(1.36 / sqrt(max(n)), 6) AS critical FROM p GROUP BY 1""")
def _(t):
    """Gaps between events of a region against an exponential law."""
    gaps = A.event_gaps(regional(t), ["region"], "ts", "id").filter(F.col("gap_days").isNotNull())
    return rounded(rounded(S.ks_distance(gaps, ["region"], "gap_days", "exponential").drop("passes"), 5, "d"), 6, "critical")


SHARES = f"{DAILY}, s AS (SELECT event_type, di, 100.0 * value / sum(value) OVER (PARTITION BY di) AS sh FROM daily)"


def shares(t):
    return A.share_of_total(daily(t), ["di"], "event_type", "value")


@query("q12_switching", f"""
WITH {SHARES}, c AS (SELECT event_type, di, sh - lag(sh) OVER (PARTITION BY event_type ORDER BY di) AS ch FROM s),
p AS (SELECT a.event_type AS key_a, b.event_type AS key_b, count(*) AS n, corr(a.ch, b.ch) AS r FROM c a JOIN c b ON a.di = b.di AND a.event_type < b.event_type WHERE a.ch IS NOT NULL AND b.ch IS NOT NULL GROUP BY 1, 2)
SELECT key_a, key_b, n, round(r, 6) AS r, round({p_t('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p_value FROM p""")
def _(t):
    """Which kinds replace each other: correlation of the daily changes of their shares."""
    change = shares(t).withColumn("change", F.col("share_pct") - F.lag("share_pct").over(by_time(["event_type"], "di"))).filter(F.col("change").isNotNull())
    return rounded(S.pearson_matrix(change, ["di"], "event_type", "change"), 6, "r", "p_value")


@query("q12_high_share", f"""
WITH {SHARES}, a AS (SELECT event_type, di, sh - avg(sh) OVER (PARTITION BY event_type) AS x FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY di) - row_number() OVER (PARTITION BY event_type, x > 1e-9 ORDER BY di) AS g FROM a)
SELECT event_type, min(di) AS "start", max(di) AS "end", count(*) AS length, round(max(x), 5) AS peak, round(avg(x), 5) AS mean_value FROM i WHERE x > 1e-9 GROUP BY event_type, g HAVING count(*) >= 2""")
def _(t):
    """Runs of days on which a kind stands above its usual share."""
    a = with_group_stats(shares(t), ["event_type"], usual=F.avg("share_pct")).withColumn("x", F.col("share_pct") - F.col("usual"))
    out = G.episodes(a, ["event_type"], "di", F.col("x") > 1e-9, "x", 2).select("event_type", "start", "end", "length", "peak", "mean_value")
    return long_cols(rounded(out, 5, "peak", "mean_value"), "start", "end")


@query("q13_breaks", f"""
WITH m AS (SELECT l_returnflag AS k, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS mi, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2),
cuts AS (SELECT unnest(range(12, 73, 6))::DOUBLE AS cut), tried AS (SELECT * FROM m, cuts),
pre AS ({line_sql('tried', 'k, cut', 'mi', 'value', 'WHERE mi < cut')}), post AS ({line_sql('tried', 'k, cut', 'mi', 'value', 'WHERE mi >= cut')}),
z AS (SELECT k, cut, a.slope AS s0, b.slope AS s1, (b.slope - a.slope) / sqrt(a.se * a.se + b.se * b.se) AS z FROM pre a JOIN post b USING (k, cut) WHERE a.n >= 10 AND b.n >= 10),
q AS (SELECT *, count(*) OVER (PARTITION BY k) AS n_tested, row_number() OVER (PARTITION BY k ORDER BY abs(z) DESC, cut) AS i FROM z)
SELECT k AS l_returnflag, n_tested, cut, round(s0, 2) AS pre_slope, round(s1, 2) AS post_slope, round(z, 5) AS z FROM q WHERE i = 1""")
def _(t):
    """Where the monthly amount of a class changes its course most clearly."""
    mi = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    m = t.lineitem.groupBy("l_returnflag", mi.alias("mi")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    out = S.breakpoint_scan(m, ["l_returnflag"], "mi", "value", range(12, 73, 6), tests=False).select("l_returnflag", "n_tested", "cut", "pre_slope", "post_slope", "z")
    return rounded(rounded(out, 2, "pre_slope", "post_slope"), 5, "z")

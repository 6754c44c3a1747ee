"""Statistical queries."""


from pyspark.sql import functions as F

from seriesloom.operators import stats as S
from seriesloom.operators.aggregates import significance_summary
from seriesloom.operators.joins import neighbourhood_join
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import rounded
from seriesloom.plans.inputs import DAILY, MONTHLY, MPRIO, daily, monthly, monthly_priority
from seriesloom.plans.joining import CATALOGUE, catalogue
from seriesloom.plans.sqlstats import p_chi2_even, p_normal, p_t
from seriesloom.session import stored


def line_sql(source: str, keys: str, x: str, y: str, where: str = "") -> str:
    """CTE body with n, slope, se, r2, t of a line fit."""
    return f"""SELECT *, sqrt((1 - r2) * syy / sxx / (n - 2)) AS se, sign(sxy) * sqrt(r2 * (n - 2) / (1 - r2 + 1e-20)) AS tt FROM (
  SELECT {keys}, regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_sxx({y}, {x}) AS sxx,
   regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, least(1.0, pow(regr_sxy({y}, {x}), 2) / (regr_sxx({y}, {x}) * regr_syy({y}, {x}))) AS r2
  FROM {source} {where} GROUP BY {keys})"""


@query("e01_ols_trend", f"""
WITH {MPRIO}, f AS ({line_sql('mprio', 'priority', 'mi', 'value')})
SELECT priority, CAST(n AS BIGINT) AS n, round(slope * 12, 4) AS slope, round(intercept, 3) AS intercept, round(r2, 6) AS r2,
  round(se * 12, 4) AS std_err, round({p_t('tt', '(n - 2)')}, 6) AS p_value FROM f""")
def _(t):
    out = S.ols_trend(monthly_priority(t), ["priority"], "mi", "value", scale=12.0).drop("ci_lower", "ci_upper")
    return rounded(rounded(rounded(out, 4, "slope", "std_err"), 3, "intercept"), 6, "r2", "p_value")


@query("e01_ols_interval")
def _(t):
    out = S.ols_trend(monthly(t), ["nation"], "mi", "value", scale=12.0, min_points=10)
    return rounded(out, 4, "slope", "intercept", "r2", "std_err", "p_value", "ci_lower", "ci_upper")


MK_SQL = """mk AS (SELECT a.{k} AS k, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM {src} a JOIN {src} b ON a.{k} = b.{k} AND a.mi < b.mi GROUP BY 1),
ties AS (SELECT k, sum(c) AS n, sum(CASE WHEN c > 1 THEN c * (c - 1) * (2 * c + 5) ELSE 0 END) AS tp FROM (
  SELECT {k} AS k, value, count(*) AS c FROM {src} GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT k, CAST(n AS BIGINT) AS n, s, s / (n * (n - 1) / 2.0) AS tau, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tp) / 18.0) AS z FROM ties JOIN mk USING (k))"""


@query("e02_mann_kendall", f"""
WITH {MONTHLY}, {MK_SQL.format(k='nation', src='monthly')}
SELECT k AS nation, n, s, round(tau, 6) AS tau, round(z, 6) AS z, round({p_normal('z')}, 6) AS p_value FROM z""")
def _(t):
    out = S.mann_kendall(monthly(t), ["nation"], "mi", "value").drop("significant")
    return rounded(out, 6, "tau", "z", "p_value")


@query("e02_mann_kendall_ties", """
WITH c AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS mi, count(*) AS value FROM events GROUP BY 1, 2),
""" + MK_SQL.format(k="user_id", src="c") + """
SELECT k AS user_id, n, s, round(tau, 6) AS tau, round(z, 6) AS z FROM z""")
def _(t):
    c = t.events.groupBy("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("di")) \
        .agg(F.count(F.lit(1)).alias("value"))
    return rounded(S.mann_kendall(c, ["user_id"], "di", "value", n=None, tests=False), 6, "tau", "z")


@query("e03_sen_slope", f"""
WITH {MPRIO}, c AS (SELECT priority, count(*) AS n FROM mprio GROUP BY 1)
SELECT a.priority, max(c.n) AS n, round(quantile_cont((b.value - a.value) / (b.mi - a.mi), 0.5) * 12, 4) AS sen_slope
FROM mprio a JOIN mprio b ON a.priority = b.priority AND a.mi < b.mi JOIN c ON c.priority = a.priority GROUP BY 1""")
def _(t):
    return S.sen_slope(monthly_priority(t), ["priority"], "mi", "value", scale=12.0, digits=4)


@query("e04_kendall_tau_b", """
WITH d AS (SELECT p_brand, p_size AS x, floor(p_retailprice / 10) AS y FROM part),
i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY x, y) AS id FROM d),
s AS (SELECT a.p_brand, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s FROM i a JOIN i b ON a.p_brand = b.p_brand AND a.id < b.id GROUP BY 1),
tx AS (SELECT p_brand, sum(c) AS n, sum(c * (c - 1) / 2.0) AS p, sum(c * (c - 1) * (2 * c + 5)) AS v, sum(c * (c - 1) * (c - 2)) AS v2 FROM (SELECT p_brand, x, count(*) AS c FROM d GROUP BY 1, 2) GROUP BY 1),
ty AS (SELECT p_brand, sum(c * (c - 1) / 2.0) AS p, sum(c * (c - 1) * (2 * c + 5)) AS v, sum(c * (c - 1) * (c - 2)) AS v2 FROM (SELECT p_brand, y, count(*) AS c FROM d GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT p_brand, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, s / nullif(sqrt((n * (n - 1) / 2.0 - tx.p) * (n * (n - 1) / 2.0 - ty.p)), 0) AS tau_b,
 s / nullif(sqrt((n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18.0 + 2.0 * tx.p * ty.p / (n * (n - 1)) + coalesce(tx.v2 * ty.v2 / nullif(9.0 * n * (n - 1) * (n - 2), 0), 0)), 0) AS z
 FROM s JOIN tx USING (p_brand) JOIN ty USING (p_brand))
SELECT p_brand, n, s, round(tau_b, 6) AS tau_b, round(z, 6) AS z, CASE WHEN z IS NOT NULL THEN round(""" + p_normal("z") + """, 6) END AS p_value FROM z""")
def _(t):
    p = t.part.select("p_brand", F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 10).alias("y"))
    return rounded(S.kendall_tau_b(p, ["p_brand"], "x", "y", n=None), 6, "tau_b", "z", "p_value")


@query("e05_pearson_matrix", f"""
WITH {DAILY}, m AS (SELECT a.event_type AS key_a, b.event_type AS key_b, count(*) AS n, corr(a.value, b.value) AS r
  FROM daily a JOIN daily b ON a.di = b.di AND a.event_type < b.event_type GROUP BY 1, 2)
SELECT key_a, key_b, n, round(r, 6) AS r, round({p_t('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)')}, 6) AS p_value FROM m""")
def _(t):
    return rounded(S.pearson_matrix(daily(t), ["di"], "event_type", "value"), 6, "r", "p_value")


@query("e06_spearman", """
WITH d AS (SELECT p_type, p_size AS x, p_retailprice AS y FROM part),
r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY x) + (count(*) OVER (PARTITION BY p_type, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY p_type ORDER BY y) + (count(*) OVER (PARTITION BY p_type, y) - 1) / 2.0 AS ry FROM d)
SELECT p_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def _(t):
    return rounded(S.spearman(t.part, ["p_type"], "p_size", "p_retailprice", tests=False), 6, "rho")


@query("e07_percentile_rank", """
SELECT p_partkey, round((rank() OVER (ORDER BY p_size) - 1 + 0.5 * count(*) OVER (PARTITION BY p_size)) / count(*) OVER (), 8) AS pct_rank FROM part""")
def _(t):
    out = S.percentile_rank_mid(t.part.select("p_partkey", "p_size"), [], "p_size")
    return out.select("p_partkey", F.round("pct_rank", 8).alias("pct_rank"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("e08_mann_whitney", f"""
WITH c AS (SELECT c_mktsegment AS g, floor(c_acctbal / 10) AS v, count(*) AS c FROM customer GROUP BY 1, 2),
s AS (SELECT g, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY 1),
u AS (SELECT a.g AS group_a, b.g AS group_b, sum(a.c * b.c * CASE WHEN b.v < a.v THEN 1.0 WHEN b.v = a.v THEN 0.5 ELSE 0 END) AS u
  FROM c a JOIN c b ON a.g < b.g GROUP BY 1, 2),
tie AS (SELECT group_a, group_b, sum(t * t * t - t) AS cube FROM (SELECT p.group_a, p.group_b, v, sum(c)::DOUBLE AS t FROM u p JOIN c ON c.g IN (p.group_a, p.group_b) GROUP BY 1, 2, 3) GROUP BY 1, 2),
z AS (SELECT group_a, group_b, a.n AS n_a, b.n AS n_b, CAST(u AS DOUBLE) AS u,
  greatest(abs(u - a.n * b.n / 2.0) - 0.5, 0) / sqrt(a.n * b.n / 12.0 * ((a.n + b.n + 1) - cube / ((a.n + b.n) * (a.n + b.n - 1.0)))) AS z
  FROM u JOIN tie USING (group_a, group_b) JOIN s a ON a.g = group_a JOIN s b ON b.g = group_b)
SELECT group_a, group_b, n_a, n_b, u, round(z, 6) AS z, round({p_normal('z')}, 6) AS p_value FROM z""")
def _(t):
    c = t.customer.select("c_mktsegment", F.floor(F.col("c_acctbal") / 10).alias("v"))
    out = S.mann_whitney_u(c, "c_mktsegment", "v", SEGMENTS).drop("z_greater", "p_greater")
    return rounded(out, 6, "z", "p_value")


@query("e09_kruskal_wallis", f"""
WITH r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r FROM customer),
n AS (SELECT count(*) AS m FROM customer), t AS (SELECT sum(c * c * c - c) AS cube FROM (SELECT count(*)::DOUBLE AS c FROM customer GROUP BY c_acctbal)),
q AS (SELECT count(*) AS k, sum(rs * rs / c) AS q FROM (SELECT sum(r) AS rs, count(*) AS c FROM r GROUP BY g)),
h AS (SELECT k AS n_groups, m AS n, (12.0 / (m * (m + 1.0)) * q - 3 * (m + 1)) / (1 - cube / (m * m * m - m)) AS h FROM n, t, q)
SELECT n_groups, n, round(h, 6) AS h, round({p_chi2_even('h', '(n_groups - 1)')}, 6) AS p_value FROM h""")
def _(t):
    return rounded(S.kruskal_wallis(t.customer, "c_mktsegment", "c_acctbal"), 6, "h", "p_value")


@query("e10_t_two_sample", f"""
WITH m AS (SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS n_a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n_b,
  avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS b,
  var_samp(value) FILTER (ts < TIMESTAMP '2024-01-16') AS va, var_samp(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS vb FROM events GROUP BY 1),
t AS (SELECT *, (a - b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)) AS t FROM m)
SELECT event_type, n_a, n_b, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(t, 6) AS t, round({p_t('t', '(n_a + n_b - 2)')}, 6) AS p_value FROM t""")
def _(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    out = S.t_two_sample(t.events, ["event_type"], "value", F.col("ts") < cut, F.col("ts") >= cut)
    return rounded(out, 6, "mean_a", "mean_b", "t", "p_value")


@query("e10_t_one_sample", f"""
WITH m AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1), t AS (SELECT *, (m - 50) / (sd / sqrt(n)) AS t FROM m)
SELECT user_id, n, round(m, 6) AS mean_value, round(t, 6) AS t, round({p_t('t', '(n - 1)')}, 6) AS p_value FROM t""")
def _(t):
    return rounded(S.t_one_sample(t.events, ["user_id"], "value", 50.0), 6, "mean_value", "t", "p_value")


@query("e11_ks_exponential", """
WITH p AS (SELECT event_type, value, rank() OVER w - 1 AS lo, count(*) OVER (PARTITION BY event_type, value) AS c,
  count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type, max(n) AS n, round(max(greatest(abs((lo + c)::DOUBLE / n - (1 - exp(-value / m))), abs(1 - exp(-value / m) - lo::DOUBLE / n))), 6) AS d,
  round(1.36 / sqrt(max(n)), 6) AS critical FROM p GROUP BY 1""")
def _(t):
    return rounded(S.ks_distance(t.events, ["event_type"], "value", "exponential").drop("passes"), 6, "d", "critical")


@query("e11_ks_gutenberg_richter", """
WITH r AS (SELECT event_type, value / 50.0 + 2 AS m FROM events WHERE value / 50.0 + 2 >= 3.0),
p AS (SELECT event_type, m, rank() OVER (PARTITION BY event_type ORDER BY m) - 1 AS lo, count(*) OVER (PARTITION BY event_type, m) AS c,
  count(*) OVER (PARTITION BY event_type) AS n, log10(exp(1)) / (avg(m) OVER (PARTITION BY event_type) - 3.0 + 0.05) AS b FROM r)
SELECT event_type, max(n) AS n, round(max(abs((lo + c)::DOUBLE / n - (1 - pow(10, -b * (m - 3.0))))), 6) AS d, round(1.36 / sqrt(max(n)), 6) AS critical FROM p GROUP BY 1""")
def _(t):
    e = t.events.select("event_type", (F.col("value") / 50.0 + 2).alias("mag"))
    out = S.ks_distance(e, ["event_type"], "mag", "gutenberg_richter", start=3.0, both_sides=False).drop("passes")
    return rounded(out, 6, "d", "critical")


def rates_sql(cut: str, key: str = "priority", src: str = "mprio", span: str = "") -> str:
    def side(name: str, cond: str) -> str:
        return f"{name} AS ({line_sql(src, key, 'mi', 'value', 'WHERE ' + cond)})"
    return side("pre", f"mi < {cut}{span}") + ", " + side("post", f"mi >= {cut}")


@query("e12_rate_comparison", f"""
WITH {MPRIO}, {rates_sql('40')}, z AS (SELECT priority, CAST(a.n AS BIGINT) AS pre_n, CAST(b.n AS BIGINT) AS post_n, a.slope AS pre_slope, b.slope AS post_slope,
  b.slope - a.slope AS change, (b.slope - a.slope) / sqrt(a.se * a.se + b.se * b.se) AS z FROM pre a JOIN post b USING (priority))
SELECT priority, pre_n, post_n, round(pre_slope, 3) AS pre_slope, round(post_slope, 3) AS post_slope, round(change, 3) AS change, round(z, 6) AS z,
  round({p_normal('z')}, 6) AS p_difference FROM z""")
def _(t):
    out = S.rate_comparison(monthly_priority(t), ["priority"], "mi", "value", F.lit(40.0))
    return rounded(rounded(out, 3, "pre_slope", "post_slope", "change"), 6, "z", "p_difference")


@query("e13_breakpoint_scan", f"""
WITH {MPRIO}, cuts AS (SELECT unnest([20.0, 32.0, 44.0, 56.0]) AS cut), tried AS (SELECT * FROM mprio, cuts),
pre AS ({line_sql('tried', 'priority, cut', 'mi', 'value', 'WHERE mi < cut')}), post AS ({line_sql('tried', 'priority, cut', 'mi', 'value', 'WHERE mi >= cut')}),
z AS (SELECT priority, cut, b.slope - a.slope AS change, (b.slope - a.slope) / sqrt(a.se * a.se + b.se * b.se) AS z FROM pre a JOIN post b USING (priority, cut))
SELECT priority, count(*) AS n_tested, CAST(arg_max(cut, abs(z)) AS DOUBLE) AS cut, round(arg_max(change, abs(z)), 3) AS change, round(arg_max(z, abs(z)), 6) AS z FROM z GROUP BY 1""")
def _(t):
    out = S.breakpoint_scan(monthly_priority(t), ["priority"], "mi", "value", [20, 32, 44, 56], tests=False)
    return rounded(rounded(out.drop("pre_slope", "post_slope"), 3, "change"), 6, "z")


@query("e13_breakpoint_windowed", f"""
WITH {MPRIO}, cuts AS (SELECT unnest(range(20, 61, 5))::DOUBLE AS cut), tried AS (SELECT priority, mi, ln(value) AS value, cut FROM mprio, cuts),
pre AS ({line_sql('tried', 'priority, cut', 'mi', 'value', 'WHERE mi < cut AND mi >= cut - 15')}), post AS ({line_sql('tried', 'priority, cut', 'mi', 'value', 'WHERE mi >= cut AND mi < cut + 15')}),
z AS (SELECT priority, cut, a.slope AS s0, b.slope AS s1, (b.slope - a.slope) / sqrt(a.se * a.se + b.se * b.se) AS z FROM pre a JOIN post b USING (priority, cut) WHERE a.n >= 10 AND b.n >= 10),
q AS (SELECT *, count(*) OVER (PARTITION BY priority) AS n_tested, row_number() OVER (PARTITION BY priority ORDER BY abs(z) DESC, cut) AS i FROM z)
SELECT priority, n_tested, cut, round(s0, 6) AS pre_slope, round(s1, 6) AS post_slope, round(s1 - s0, 6) AS change, round(z, 6) AS z, round({p_normal('z')}, 6) AS p_difference FROM q WHERE i = 1""")
def _(t):
    out = S.breakpoint_scan(monthly_priority(t).withColumn("lv", F.log("value")), ["priority"], "mi", "lv", range(20, 61, 5), window=15.0)
    return rounded(out, 6, "pre_slope", "post_slope", "change", "z", "p_difference")


@query("e14_quadratic_fit", f"""
WITH {MPRIO}, c AS (SELECT priority, value AS y, mi - avg(mi) OVER (PARTITION BY priority) AS t FROM mprio),
m AS (SELECT priority, count(*) AS n, regr_sxx(y, t) AS tt, regr_sxx(y, t * t) AS qq, regr_syy(y, t) AS yy, regr_sxy(y, t) AS ty, regr_sxy(y, t * t) AS qy,
  regr_sxy(t * t, t) AS tq FROM c GROUP BY 1),
k AS (SELECT *, (qy - tq * ty / tt) / (qq - tq * tq / tt) AS c, qq - tq * tq / tt AS fr, yy - ty * ty / tt AS rl FROM m),
r AS (SELECT *, yy - (ty - c * tq) / tt * ty - c * qy AS rq FROM k),
a AS (SELECT *, 2 * c AS acc, 2 * sqrt(rq / ((n - 3) * fr)) AS acc_se FROM r)
SELECT priority, n, round(acc, 4) AS acceleration, round(acc_se, 4) AS acceleration_se, round((ty - c * tq) / tt, 3) AS slope_at_mean,
  round(6 + n * (ln(2 * pi() * rq / n) + 1), 4) AS aic_quadratic, round(4 + n * (ln(2 * pi() * rl / n) + 1), 4) AS aic_linear,
  round(3 * ln(n) + n * (ln(2 * pi() * rq / n) + 1), 4) AS bic_quadratic, round(2 * ln(n) + n * (ln(2 * pi() * rl / n) + 1), 4) AS bic_linear,
  round(100 * (rl - rq) / rl, 4) AS rss_reduction_pct, round({p_t('(acc / acc_se)', '(n - 3)')}, 6) AS p_value FROM a""")
def _(t):
    out = S.quadratic_fit(monthly_priority(t), ["priority"], "mi", "value")
    out = rounded(out, 4, "acceleration", "acceleration_se", "aic_quadratic", "aic_linear", "bic_quadratic", "bic_linear", "rss_reduction_pct")
    return rounded(rounded(out, 3, "slope_at_mean"), 6, "p_value")


@query("e15_model_selection", """
WITH c AS (SELECT l_returnflag AS k, l_extendedprice AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS t, ln(l_quantity + 1) AS lx FROM lineitem),
m AS (SELECT k, count(*) AS n, regr_syy(y, t) AS yy, regr_sxx(y, t) AS tt, regr_sxy(y, t) AS ty, regr_sxx(y, t * t) AS qq, regr_sxy(y, t * t) AS qy,
  regr_sxy(t * t, t) AS tq, regr_sxx(y, lx) AS ll, regr_sxy(y, lx) AS ly FROM c GROUP BY 1),
f AS (SELECT k, n, yy, 'linear' AS model, yy - ty * ty / tt AS rss, 2 AS p FROM m
  UNION ALL SELECT k, n, yy, 'quadratic', yy - ty * ty / tt - pow(qy - tq * ty / tt, 2) / (qq - tq * tq / tt), 3 FROM m
  UNION ALL SELECT k, n, yy, 'logarithmic', yy - ly * ly / ll, 2 FROM m),
a AS (SELECT *, n * ln(rss / n) + 2 * p AS aic, n * ln(rss / n) + p * ln(n) AS bic FROM f)
SELECT k AS l_returnflag, model, n, round(1 - rss / yy, 8) AS r2, round(aic, 3) AS aic, round(bic, 3) AS bic,
  round(aic - min(aic) OVER (PARTITION BY k), 3) AS delta_aic, round(bic - min(bic) OVER (PARTITION BY k), 3) AS delta_bic, aic = min(aic) OVER (PARTITION BY k) AS best FROM a""")
def _(t):
    out = S.model_selection(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice").drop("rss")
    return rounded(rounded(out, 3, "aic", "bic", "delta_aic", "delta_bic"), 8, "r2")


@query("e16_decadal_rates", f"""
WITH {MPRIO}, b AS (SELECT *, mi // 10 * 10 AS block FROM mprio WHERE mi // 10 * 10 > 0), f AS ({line_sql('b', 'priority, block', 'mi', 'value')})
SELECT priority, CAST(block AS BIGINT) AS block, CAST(n AS BIGINT) AS n, round(slope, 4) AS slope, round(r2, 6) AS r2, round(se, 4) AS std_err FROM f WHERE n >= 7""")
def _(t):
    out = S.decadal_rates(monthly_priority(t), ["priority"], "mi", "value", tests=False).drop("intercept")
    return rounded(rounded(out, 4, "slope", "std_err"), 6, "r2")


B_SQL = """bins AS (SELECT {k} AS k, floor(mag * 10) AS b, count(*) AS c FROM {src} GROUP BY 1, 2),
mc AS (SELECT k, round(arg_min(b, (-c, b)) / 10 + 0.2, 1) AS mc, CAST(sum(c) AS BIGINT) AS n_total FROM bins GROUP BY 1 HAVING sum(c) >= 20),
m AS (SELECT {k} AS k, max(mc) AS mc, max(n_total) AS n_total, count(*) AS n, avg(mag) AS mm, var_samp(mag) AS v FROM {src} JOIN mc ON k = {k} WHERE mag >= mc GROUP BY 1 HAVING count(*) >= 10),
bv AS (SELECT *, log10(exp(1)) / (mm - mc + 0.05) AS b FROM m)"""


@query("e17_b_value", "WITH cat AS (SELECT event_type, value / 50.0 + 2 AS mag FROM events), " + B_SQL.format(k="event_type", src="cat") + """
SELECT k AS event_type, mc, n_total, n, round(mm, 6) AS mean_mag, round(b, 6) AS b, round(2.30 * b * b * sqrt(v / n), 6) AS b_uncertainty,
  round(log10(n) + b * mc, 6) AS a FROM bv""")
def _(t):
    e = t.events.select("event_type", (F.col("value") / 50.0 + 2).alias("mag"))
    return rounded(S.b_value(e, ["event_type"], "mag").drop("max_mag"), 6, "mean_mag", "b", "b_uncertainty", "a")


@query("e17_b_value_windows", """
WITH ev AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS di, value / 50.0 + 2 AS mag FROM events),
cat AS (SELECT w.s AS s, mag FROM ev JOIN (SELECT unnest(generate_series(0, 28, 4)) AS s) w ON di >= s AND di < s + 10), """ + B_SQL.format(k="s", src="cat") + """
SELECT k AS start_day, mc, n, round(b, 6) AS b FROM bv""")
def _(t):
    di = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    e = t.events.select(F.explode(S.window_ids(di, 10, 4)).alias("start_day"), (F.col("value") / 50.0 + 2).alias("mag"))
    e = e.withColumn("start_day", F.col("start_day").cast("bigint"))
    return rounded(S.b_value(e, ["start_day"], "mag").select("start_day", "mc", "n", "b"), 6, "b")


@query("e18_poisson_trend", f"""
WITH RECURSIVE {DAILY}, dd AS (SELECT event_type, di - avg(di) OVER w AS t, n::DOUBLE AS k, avg(n) OVER w AS kb FROM daily WINDOW w AS (PARTITION BY event_type)),
nw AS (SELECT DISTINCT event_type, ln(kb) AS a, 0.0::DOUBLE AS b, 0 AS i FROM dd
 UNION ALL SELECT event_type, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01), i + 1 FROM (
  SELECT nw.event_type, a, b, i, sum(k - exp(a + b * t)) AS g0, sum(t * (k - exp(a + b * t))) AS g1, sum(exp(a + b * t)) AS h00, sum(t * exp(a + b * t)) AS h01, sum(t * t * exp(a + b * t)) AS h11
  FROM nw JOIN dd ON dd.event_type = nw.event_type WHERE i < 25 GROUP BY 1, 2, 3, 4)),
r AS (SELECT nw.event_type, count(*)::DOUBLE AS n_periods, b, greatest(2 * sum(k * (a + b * t - ln(kb)) - exp(a + b * t) + kb), 0) AS lr FROM nw JOIN dd ON dd.event_type = nw.event_type WHERE i = 25 GROUP BY 1, 3)
SELECT event_type, n_periods, round(b, 6) AS rate, round(lr, 6) AS lr, round((exp(10 * b) - 1) * 100, 6) AS pct_per_scale, round({p_normal('sqrt(lr)')}, 6) AS p_value FROM r""")
def _(t):
    out = S.poisson_trend(daily(t).withColumn("n", F.col("n").cast("double")), ["event_type"], "di", "n")
    return rounded(out, 6, "rate", "lr", "pct_per_scale", "p_value")


def aftershocks(t, known=None):
    """Main events and their pairs; with a table `known` by m_id those of its main events, with its columns."""
    cat = catalogue(t)
    mains = cat.filter("mag >= 7")
    extra = [c for c in known.columns if c != "m_id"] if known is not None else []
    if known is not None:
        mains = mains.join(known.withColumnRenamed("m_id", "id"), "id")
    radius = F.pow(F.lit(10.0), 0.5 * F.col("m_mag") - 1.78)
    return mains, neighbourhood_join(mains, cat, 90, radius, 1000.0, tags=("mag",), main_tags=extra)


@query("e19_omori_fit", f"""
WITH {CATALOGUE}, mm AS (SELECT * FROM cat WHERE mag >= 7),
p AS (SELECT mm.id AS m_id, (c.t - mm.t) / 86400.0 AS d, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - mm.lat) / 2), 2) +
   cos(radians(mm.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - mm.lon) / 2), 2)))) AS km, least(1000.0, pow(10, 0.5 * mm.mag - 1.78)) AS r
 FROM mm JOIN cat c ON c.t - mm.t > 10 AND c.t - mm.t <= 90 * 86400.0),
s AS (SELECT m_id, count(*) AS n, max(d) AS e FROM p WHERE km <= r GROUP BY 1 HAVING count(*) >= 15),
g AS (SELECT p.m_id, c, max(n) AS n, max(e) AS e, sum(ln(d + c)) AS sl FROM p JOIN s USING (m_id), (SELECT unnest([0.01, 0.05, 0.2, 1.0, 5.0]) AS c) WHERE km <= r GROUP BY 1, 2),
l AS (SELECT *, n / ((pow(e + c, 1 - q) - pow(c, 1 - q)) / (1 - q)) AS k FROM g, (SELECT unnest([0.5, 0.7, 0.9, 1.1, 1.3, 1.5]) AS q)),
f AS (SELECT *, n * ln(k) - q * sl - n AS ll FROM l)
SELECT m_id, n, round(arg_max(k, (round(ll, 8), -q, -c)), 6) AS rate_k, CAST(arg_max(c, (round(ll, 8), -q, -c)) AS DOUBLE) AS c, CAST(arg_max(q, (round(ll, 8), -q, -c)) AS DOUBLE) AS p,
 round(max(ll), 6) AS log_likelihood FROM f GROUP BY 1, 2""")
def _(t):
    _, pairs = aftershocks(t)
    times = pairs.select("m_id", (F.col("gap_s") / 86400.0).alias("d"))
    out = S.omori_fit(times, ["m_id"], "d", refine=False, c_grid=[0.01, 0.05, 0.2, 1.0, 5.0], p_grid=[0.5, 0.7, 0.9, 1.1, 1.3, 1.5])
    return rounded(out.drop("aic"), 6, "rate_k", "log_likelihood")


@query("e19_omori_refined")
def _(t):
    def times(known=None):
        """Times of the pairs with the columns known of their main events, which get them before they meet their pairs."""
        extra = [c for c in known.columns if c != "m_id"] if known is not None else []
        return aftershocks(t, known)[1].select("m_id", (F.col("gap_s") / 86400.0).alias("d"), *extra)

    fits = stored(S.omori_fit(times(), ["m_id"], "d", attach=times))
    ks = S.omori_errors(times(), fits, ["m_id"], "d", attach=times).select("m_id", "ks")
    return rounded(fits.join(ks, "m_id"), 6, "rate_k", "c", "p", "log_likelihood", "aic", "ks")


@query("e20_baths_law", f"""
WITH {CATALOGUE}, mm AS (SELECT * FROM cat WHERE mag >= 7),
p AS (SELECT mm.id AS m_id, mm.mag AS m_mag, c.mag, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - mm.lat) / 2), 2) +
   cos(radians(mm.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - mm.lon) / 2), 2)))) AS km, least(1000.0, pow(10, 0.5 * mm.mag - 1.78)) AS r
 FROM mm JOIN cat c ON c.t - mm.t > 10 AND c.t - mm.t <= 90 * 86400.0)
SELECT m_id, round(max(mag), 6) AS largest, count(*) AS n_after, round(max(m_mag) - max(mag), 6) AS gap FROM p WHERE km <= r GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    mains, pairs = aftershocks(t)
    out = S.baths_law(pairs, mains.select(F.col("id").alias("m_id"), "mag").withColumnRenamed("mag", "main_mag"), "m_id", "main_mag", "mag")
    return rounded(out.filter("n_after >= 5").select("m_id", "largest", "n_after", "gap"), 6, "largest", "gap")


KDE = dict(bandwidth=0.0025, low=2.95, high=3.0, points=1000)


@query("e21_weighted_kde", """
WITH v AS (SELECT log10(p_retailprice) AS lv, sum(p_size) AS w FROM part GROUP BY 1), tot AS (SELECT sum(p_size) AS s FROM part),
g AS (SELECT unnest(range(0, 1000)) AS g)
SELECT g, round(sum(w / s * exp(-0.5 * pow((lv - (2.95 + g * (0.05 / 999))) / 0.0025, 2)) / (0.0025 * sqrt(2 * pi()))), 6) AS density FROM v, tot, g GROUP BY 1""")
def _(t):
    out = S.weighted_kde(t.part, [], "p_retailprice", F.col("p_size"), **KDE)
    return out.select(F.col("g").cast("bigint").alias("g"), F.round("density", 6).alias("density"))


def valley_sql(curve: str, key: str, min_gap: float) -> str:
    """CTEs from a density curve (key, g, x, density) to the lowest point between its two tallest separated peaks."""
    def tops(k: int) -> str:
        return (f"coalesce(density > max(density) OVER (PARTITION BY {key} ORDER BY g ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AND "
                f"density > max(density) OVER (PARTITION BY {key} ORDER BY g ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), FALSE)")

    return f"""mk AS (SELECT *, {tops(5)} AS wide, {tops(3)} AS near FROM {curve}), en AS (SELECT *, count(*) FILTER (wide) OVER (PARTITION BY {key}) >= 2 AS enough FROM mk),
pk AS (SELECT {key}, g, log10(x) AS lx, x, density FROM en WHERE CASE WHEN enough THEN wide ELSE near END), p1 AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY density DESC, g DESC) = 1),
p2 AS (SELECT pk.* FROM pk JOIN p1 USING ({key}) WHERE abs(pk.lx - p1.lx) > {min_gap} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY pk.density DESC, pk.g DESC) = 1),
ee AS (SELECT {key}, least(a.g, b.g) AS g1, greatest(a.g, b.g) AS g2, least(a.x, b.x) AS peak_low, greatest(a.x, b.x) AS peak_high, CASE WHEN a.g < b.g THEN a.density ELSE b.density END AS ld, CASE WHEN a.g < b.g THEN b.density ELSE a.density END AS hd
  FROM p1 a JOIN p2 b USING ({key})), ins AS (SELECT * FROM {curve} JOIN ee USING ({key}) WHERE g BETWEEN g1 AND g2), vl AS (SELECT {key}, arg_min(g, (density, g)) AS vg, arg_min(x, (density, g)) AS vx, min(density) AS vd FROM ins GROUP BY 1),
wd AS (SELECT {key}, min(log10(x)) FILTER (g >= vg AND density >= vd + ((ld + hd) / 2 - vd) / 2) - max(log10(x)) FILTER (g <= vg AND density >= vd + ((ld + hd) / 2 - vd) / 2) AS width FROM ins JOIN vl USING ({key}) GROUP BY 1)
SELECT {key}, round(peak_low, 6) AS peak_low, round(peak_high, 6) AS peak_high, round(ld, 6) AS low_density, round(hd, 6) AS high_density, round(vx, 6) AS valley, round(vd, 6) AS valley_density, round(1 - vd / ((ld + hd) / 2), 6) AS depth, round(width, 6) AS width_log
FROM ee JOIN vl USING ({key}) JOIN wd USING ({key})"""


def curve_sql(source: str, key: str, value: str, weight: str, h: float, low: float, high: float, points: int) -> str:
    step = f"({high - low} / {points - 1}.0)"
    return f"""ms AS (SELECT {key}, log10({value}) AS lv, sum({weight}) AS w FROM {source} GROUP BY 1, 2), tw AS (SELECT {key}, sum(w) AS s FROM ms GROUP BY 1), gr AS (SELECT unnest(range(0, {points})) AS g),
cv AS (SELECT {key}, g, pow(10, {low} + g * {step}) AS x, sum(w / s * exp(-0.5 * pow((lv - ({low} + g * {step})) / {h}, 2)) / ({h} * sqrt(2 * pi()))) AS density FROM ms JOIN tw USING ({key}), gr GROUP BY 1, 2)"""


@query("e22_valley_detect", f"WITH {curve_sql('lineitem', 'l_returnflag', 'l_extendedprice', '1.0', 0.04, 2.5, 5.2, 400)}, {valley_sql('cv', 'l_returnflag', 0.08)}")
def _(t):
    curve = S.weighted_kde(t.lineitem, ["l_returnflag"], "l_extendedprice", F.lit(1.0), 0.04, 2.5, 5.2, 400)
    return rounded(S.valley_detect(curve, ["l_returnflag"]), 6, "peak_low", "peak_high", "low_density", "high_density", "valley", "valley_density", "depth", "width_log")


@query("e23_weighted_line_fit", """
WITH d AS (SELECT p_brand, log10(p_size) AS x, log10(p_retailprice) AS y, 1.0 / pow(0.01 + p_size / 1000.0, 2) AS w FROM part),
m AS (SELECT p_brand, count(*) AS n, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM d GROUP BY 1)
SELECT p_brand, n, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 6) AS slope, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 6) AS intercept,
  round(sqrt(s / (s * sxx - sx * sx)), 6) AS slope_se, round(sqrt(sxx / (s * sxx - sx * sx)), 6) AS intercept_se FROM m""")
def _(t):
    out = S.weighted_line_fit(t.part, ["p_brand"], F.log10("p_size"), F.log10("p_retailprice"), F.lit(0.01) + F.col("p_size") / 1000.0)
    return rounded(out.drop("chi2"), 6, "slope", "intercept", "slope_se", "intercept_se")


@query("e24_skill_scores", """
WITH d AS (SELECT year(l_shipdate) AS yr, l_extendedprice / l_quantity AS o, p_retailprice * 1.5 AS m FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT yr, count(*) AS n, round(avg(m - o), 4) AS bias, round(sqrt(avg(pow(m - o, 2))), 4) AS rmse, round(avg(abs(m - o)), 4) AS mae,
  count(*) FILTER (o > m) AS n_above, count(*) FILTER (o < m) AS n_below, round(100.0 * count(*) FILTER (o BETWEEN m * 0.8 AND m * 1.2) / count(*), 6) AS pct_inside FROM d GROUP BY 1""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.year("l_shipdate").cast("bigint").alias("yr"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("o"), (F.col("p_retailprice") * 1.5).alias("m"))
    out = S.skill_scores(d, ["yr"], F.col("o"), F.col("m"), F.col("m") * 0.8, F.col("m") * 1.2)
    return rounded(rounded(out, 4, "bias", "rmse", "mae"), 6, "pct_inside")


@query("e25_growth_metrics", f"""
WITH {MONTHLY}, m AS (SELECT nation, round(sum(value) FILTER (yr = 1995), 2) AS v0, round(sum(value) FILTER (yr = 1998), 2) AS v1, round(sum(value) FILTER (yr = 2000), 2) AS v2 FROM monthly GROUP BY 1),
g AS (SELECT *, pow(v2 / v0, 1.0 / 5) - 1 AS c, pow(v1 / v0, 1.0 / 3) - 1 AS cb, pow(v2 / v1, 1.0 / 2) - 1 AS ca FROM m)
SELECT nation, round(c, 8) AS cagr, round(v2 - v0, 2) AS growth, round(v2 / v0, 8) AS growth_ratio, round(cb, 8) AS cagr_before, round(ca, 8) AS cagr_after,
  round(CASE WHEN c > 0 THEN ln(2) / ln(1 + c) END, 6) AS doubling_time, round(ca - cb, 8) AS acceleration FROM g""")
def _(t):
    out = S.growth_metrics(monthly(t), ["nation"], "yr", "value", 1995, 1998, 2000).drop("v0", "v1", "v2")
    return rounded(rounded(rounded(out, 8, "cagr", "growth_ratio", "cagr_before", "cagr_after", "acceleration"), 2, "growth"), 6, "doubling_time")


@query("e25_annualised", f"""
WITH {MONTHLY}, y AS (SELECT nation, yr, count(*) AS months, round(sum(value), 2) AS total FROM monthly GROUP BY 1, 2)
SELECT nation, yr, months, CAST(floor(CASE WHEN months < 12 THEN total * 12 / months ELSE total END) AS BIGINT) AS annual FROM y""")
def _(t):
    y = monthly(t).groupBy("nation", F.col("yr").cast("bigint").alias("yr")).agg(
        F.count(F.lit(1)).alias("months"), F.round(F.sum("value"), 2).alias("total"))
    return S.annualised(y, ["nation"], "yr", "months", "total").drop("total")


@query("e26_revealed_advantage", """
WITH c AS (SELECT c_nationkey AS place, o_orderpriority AS topic, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT place, topic, CAST(n AS DOUBLE) AS n, round((n / sum(n) OVER (PARTITION BY place)) / (sum(n) OVER (PARTITION BY topic) / sum(n) OVER ()), 8) AS rca FROM c""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("place"), F.col("o_orderpriority").alias("topic"))
    return rounded(S.revealed_advantage(o, "place", "topic"), 8, "rca")


@query("e27_surge_ratio", f"""
WITH {MONTHLY}, y AS (SELECT nation, yr, sum(n) AS c FROM monthly GROUP BY 1, 2),
m AS (SELECT nation, avg(c) FILTER (yr BETWEEN 1995 AND 1996) AS b, avg(c) FILTER (yr BETWEEN 1999 AND 2000) AS p FROM y GROUP BY 1)
SELECT nation, round(b, 6) AS base_mean, round(p, 6) AS peak_mean, round(p / b, 8) AS surge FROM m WHERE b >= 50 AND p >= 60 AND p / b >= 1.0""")
def _(t):
    y = monthly(t).groupBy("nation", "yr").agg(F.sum("n").alias("c"))
    out = S.surge_ratio(y, ["nation"], "yr", "c", (1995, 1996), (1999, 2000), 50, 60, 1.0)
    return rounded(rounded(out, 6, "base_mean", "peak_mean"), 8, "surge")


@query("e28_period_attention", f"""
WITH {MPRIO}, s AS (SELECT priority, avg(value) FILTER (mi BETWEEN 0 AND 23) AS pre, avg(value) FILTER (mi BETWEEN 24 AND 35) AS peak,
  avg(value) FILTER (mi BETWEEN 36 AND 47) AS trans, avg(value) FILTER (mi BETWEEN 48 AND 78) AS post,
  arg_max(mi, value) FILTER (mi BETWEEN 24 AND 47) AS pm, max(value) FILTER (mi BETWEEN 24 AND 47) AS pv FROM mprio GROUP BY 1),
h AS (SELECT s.priority, min(mi - pm) AS hl FROM s JOIN mprio USING (priority) WHERE mi > pm AND pv > pre AND value <= pre + (pv - pre) * 0.5 GROUP BY 1)
SELECT priority, round(pre, 5) AS pre_mean, round(peak, 5) AS peak_mean, round(trans, 5) AS transition_mean, round(post, 5) AS post_mean, CAST(pm AS BIGINT) AS peak_month,
  pv AS peak_value, round(pv / pre, 6) AS peak_ratio, round(100 * (post - pre) / pre, 6) AS dividend_pct, round(post / peak, 6) AS retention, CAST(hl AS DOUBLE) AS half_life FROM s LEFT JOIN h USING (priority)""")
def _(t):
    out = S.period_attention(monthly_priority(t), ["priority"], "mi", "value", {"pre": (0, 23), "peak": (24, 35), "transition": (36, 47), "post": (48, 78)}, 100.0)
    out = rounded(rounded(out, 5, "pre_mean", "peak_mean", "transition_mean", "post_mean"), 6, "peak_ratio", "dividend_pct", "retention")
    return out.withColumns({"peak_month": F.col("peak_month").cast("bigint"), "half_life": F.col("half_life").cast("double")})


@query("e29_composite_index", f"""
WITH {MPRIO}, s AS (SELECT priority, regr_slope(value, mi) / avg(value) AS a, regr_slope(n, mi) / avg(n) AS b, regr_slope(value / n, mi) / avg(value / n) AS c FROM mprio GROUP BY 1)
SELECT priority, round((a - b + 10 * c) / (abs(a) + abs(b) + abs(10 * c)), 6) AS composite FROM s""")
def _(t):
    m = monthly_priority(t).withColumn("per", F.col("value") / F.col("n"))
    s = m.groupBy("priority").agg(*[(F.regr_slope(c, "mi") / F.avg(c)).alias(f"s_{c}") for c in ("value", "n", "per")])
    return s.select("priority", F.round(S.composite_index(F.col("s_value"), -F.col("s_n"), 10 * F.col("s_per")), 6).alias("composite"))


@query("e30_harmonic_fit", f"""
WITH {MPRIO}, g AS (SELECT priority, p, value AS y, cos(2 * pi() * mi / p) AS c, sin(2 * pi() * mi / p) AS s FROM mprio, (SELECT unnest(range(6, 81))::DOUBLE AS p)),
m AS (SELECT priority, p, count(*) AS n, regr_sxx(y, c) AS cc, regr_sxx(y, s) AS ss, regr_sxy(s, c) AS cs, regr_sxy(y, c) AS cy, regr_sxy(y, s) AS sy, regr_syy(y, c) AS yy FROM g GROUP BY 1, 2),
f AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS a, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS b FROM m), r AS (SELECT *, yy - a * cy - b * sy AS rss FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY rss, p) AS i FROM r)
SELECT priority, n, CAST(p AS DOUBLE) AS period, round(sqrt(a * a + b * b), 2) AS amplitude, round(1 - rss / yy, 6) AS r2, round(((yy - rss) / 2) / (rss / (n - 3)), 5) AS f_stat FROM q WHERE i = 1""")
def _(t):
    out = S.harmonic_fit(monthly_priority(t), ["priority"], "mi", "value", range(6, 81), tests=False).drop("phase")
    return rounded(rounded(rounded(out, 2, "amplitude"), 6, "r2"), 5, "f_stat")


@query("d18_significance_summary", f"""
WITH {MONTHLY}, f AS ({line_sql('monthly', 'nation', 'mi', 'value')}), p AS (SELECT n_regionkey AS region, slope, {p_t('tt', '(n - 2)')} AS p FROM f JOIN nation ON nation = n_nationkey)
SELECT region, count(*) AS n, count(*) FILTER (p < 0.05) AS n_significant, round(100.0 * count(*) FILTER (p < 0.05) / count(*), 4) AS pct_significant,
  count(*) FILTER (slope > 0) AS n_up, count(*) FILTER (slope < 0) AS n_down, round(avg(slope), 3) AS mean_slope FROM p GROUP BY 1""")
def _(t):
    fits = S.ols_trend(monthly(t), ["nation"], "mi", "value").join(t.nation, F.col("nation") == F.col("n_nationkey"))
    out = significance_summary(fits.withColumn("region", F.col("n_regionkey")), ["region"], "slope", "p_value")
    return rounded(rounded(out, 4, "pct_significant"), 3, "mean_slope")

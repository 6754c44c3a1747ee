"""Ordered-series queries."""

from pyspark.sql import functions as F

from seriesloom.functions.pvalues import p_value
from seriesloom.operators import windows as W
from seriesloom.operators.aggregates import season_mean
from seriesloom.operators.stats import ols_trend
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import SEASON, rounded
from seriesloom.plans.inputs import DAILY, MONTHLY, MPRIO, daily, monthly, monthly_priority
from seriesloom.plans.sqlstats import p_t


def long_cols(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


@query("f01_delta", """
WITH d AS (SELECT event_id, value - lag(value) OVER w AS d, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN gap <= 36000 THEN d END, 6) AS delta FROM d""")
def _(t):
    out = W.delta(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", "event_id", 36000.0)
    return out.select("event_id", F.round("delta", 6).alias("delta"))


RET = f"""{DAILY}, ret AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY event_type ORDER BY di)) AS r,
  row_number() OVER (PARTITION BY event_type ORDER BY di) AS rn FROM daily)"""


def returns(t):
    return W.log_return(daily(t), ["event_type"], "di", "value", name="r")


@query("f02_log_return", f"WITH {RET} SELECT event_type, di, round(r, 8) AS r FROM ret")
def _(t):
    return long_cols(rounded(returns(t).select("event_type", "di", "r"), 8, "r"), "di")


@query("f03_forward_fill", f"""
WITH {DAILY}, h AS (SELECT event_type, di, CASE WHEN n % 3 <> 0 THEN value END AS v FROM daily)
SELECT event_type, di, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY di) AS v FROM h""")
def _(t):
    h = daily(t).select("event_type", "di", F.when(F.col("n") % 3 != 0, F.col("value")).alias("v"))
    return long_cols(W.forward_fill(h, ["event_type"], "di", "v"), "di")


@query("f04_rolling_std", f"""
WITH {RET} SELECT event_type, di, round(CASE WHEN rn > 10 AND count(r) OVER w >= 8 THEN stddev_samp(r) OVER w * sqrt(252) END, 6) AS rolling_std
FROM ret WINDOW w AS (PARTITION BY event_type ORDER BY di ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(t):
    out = W.rolling_std(returns(t), ["event_type"], "di", "r", n=10, min_obs=8)
    return long_cols(rounded(out.select("event_type", "di", "rolling_std"), 6, "rolling_std"), "di")


def ewma_sql(at: str, v0: str) -> str:
    return f"""live AS (SELECT *, count(r) FILTER (rn > {at}) OVER (PARTITION BY event_type ORDER BY di) AS i FROM ret)
SELECT a.event_type, a.di, round(CASE WHEN a.rn >= {at} THEN pow(0.94, max(a.i)) * max(v0) + 0.06 * coalesce(sum(pow(0.94, a.i - b.i) * b.r * b.r), 0) END, 8) AS ewma_var
FROM live a JOIN seed USING (event_type) LEFT JOIN live b ON a.event_type = b.event_type AND b.rn <= a.rn AND b.rn > {at} AND b.r IS NOT NULL GROUP BY 1, 2, a.rn"""


@query("f05_ewma_variance", f"""
WITH {RET}, seed AS (SELECT event_type, var_samp(r) AS v0 FROM ret WHERE rn BETWEEN 2 AND 11 GROUP BY 1), {ewma_sql('11', 'v0')}""")
def _(t):
    out = W.ewma_variance(returns(t), ["event_type"], "di", "r", window=10, min_obs=8)
    return long_cols(rounded(out.select("event_type", "di", "ewma_var"), 8, "ewma_var"), "di")


@query("f05_ewma_mean_square", f"""
WITH {RET}, seed AS (SELECT event_type, avg(r * r) AS v0 FROM ret WHERE rn BETWEEN 2 AND 31 GROUP BY 1), {ewma_sql('1', 'v0')}""")
def _(t):
    out = W.ewma_variance(returns(t), ["event_type"], "di", "r", seed="mean_square")
    return long_cols(rounded(out.select("event_type", "di", "ewma_var"), 8, "ewma_var"), "di")


@query("f06_rolling_mean_min", f"""
WITH {MONTHLY}, m AS (SELECT nation, yr, avg(value) OVER w AS a, count(value) OVER w AS c FROM monthly
  WINDOW w AS (PARTITION BY nation, yr ORDER BY mi ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT nation, yr, round(min(a) FILTER (c = 3), 4) AS low_3 FROM m GROUP BY 1, 2""")
def _(t):
    return long_cols(rounded(W.rolling_mean_min(monthly(t), ["nation", "yr"], "mi", "value", 3, "low_3"), 4, "low_3"), "yr")


@query("f07_rolling_years", f"""
WITH {MPRIO}, m AS (SELECT priority, nth_value(mi, 7) OVER w AS center, stddev_samp(value) OVER w AS s, count(*) OVER w AS c FROM mprio
  WINDOW w AS (PARTITION BY priority ORDER BY mi ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT priority, center, round(s, 3) AS rolling_std FROM m WHERE c = 13""")
def _(t):
    return long_cols(rounded(W.rolling_stat(monthly_priority(t), ["priority"], "mi", "value", 13), 3, "rolling_std"), "center")


@query("f08_rolling_ols", f"""
WITH {MPRIO}, m AS (SELECT priority, min(mi) OVER w AS "start", mi AS "end", regr_slope(value, mi) OVER w AS s, regr_r2(value, mi) OVER w AS r2, count(*) OVER w AS c FROM mprio
  WINDOW w AS (PARTITION BY priority ORDER BY mi ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT priority, "start", "end", round(s, 2) AS slope, round(r2, 5) AS r2, round({p_t('sqrt(r2 * 22 / (1 - r2))', '22')}, 4) AS p_value FROM m WHERE c = 24""")
def _(t):
    out = W.rolling_ols(monthly_priority(t), ["priority"], "mi", "value", 24)
    out = out.withColumn("p_value", p_value("t", F.col("t"), F.lit(22.0))).drop("t")
    return long_cols(rounded(rounded(rounded(out, 2, "slope"), 5, "r2"), 4, "p_value"), "start", "end")


EVENT_SECONDS = "epoch_us(ts) / 1e6"


def seconds(t):
    return t.events.select("event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))


def windows_sql(width: int, step: int) -> str:
    return f"""ev AS (SELECT event_type, value, {EVENT_SECONDS} AS s FROM events), sp AS (SELECT event_type, min(s) AS t0, max(s) AS t1 FROM ev GROUP BY 1),
g AS (SELECT event_type, t0, unnest(range(0, CAST(floor((t1 - t0 - {width} * 86400.0) / ({step} * 86400.0)) AS BIGINT) + 1)) AS i FROM sp),
c AS (SELECT g.event_type, i, t0 + i * {step} * 86400.0 AS start_s, t0 + i * {step} * 86400.0 + {width} * 86400.0 AS end_s, count(s) AS n
  FROM g LEFT JOIN ev ON ev.event_type = g.event_type AND s >= t0 + i * {step} * 86400.0 AND s < t0 + i * {step} * 86400.0 + {width} * 86400.0 GROUP BY 1, 2, 3, 4),
wz AS (SELECT *, (n - avg(n) OVER (PARTITION BY event_type)) / stddev_pop(n) OVER (PARTITION BY event_type) AS z FROM c)"""


@query("f09_rolling_event_window", f"WITH {windows_sql(7, 1)} SELECT event_type, i AS \"window\", n, round(z, 6) AS z FROM wz")
def _(t):
    out = W.rolling_event_counts(seconds(t), ["event_type"], "s", 7, 1)
    return long_cols(rounded(out.select("event_type", "window", "n", "z"), 6, "z"), "window", "n")


@query("f10_centered_variance", f"""
WITH {MPRIO}, a AS (SELECT priority, mi, (value - avg(value) OVER (PARTITION BY priority)) / 1e6 AS x FROM mprio),
w AS (SELECT priority, mi, var_pop(x) OVER w AS v, avg(abs(x)) FILTER (abs(x) > 0.5) OVER w AS m, count(*) OVER w AS c FROM a
  WINDOW w AS (PARTITION BY priority ORDER BY mi ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
SELECT priority, mi, round(v, 6) AS running_var, round(coalesce(m, 0), 6) AS running_amp FROM w WHERE c = 24""")
def _(t):
    from seriesloom.operators.split import with_group_stats
    a = with_group_stats(monthly_priority(t), ["priority"], m=F.avg("value")).withColumn("x", (F.col("value") - F.col("m")) / 1e6)
    return long_cols(rounded(W.centered_variance(a, ["priority"], "mi", "x", 12, 0.5), 6, "running_var", "running_amp"), "mi")


PAIR_WINDOW = f"""{RET}, pw AS (SELECT a.di, a.event_type AS key_a, b.event_type AS key_b, corr(a.r, b.r) OVER w AS r, count(a.r + b.r) OVER w AS c, row_number() OVER w2 AS rn
  FROM ret a JOIN ret b ON a.di = b.di AND a.event_type < b.event_type
  WINDOW w AS (PARTITION BY a.event_type, b.event_type ORDER BY a.di ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY a.event_type, b.event_type ORDER BY a.di))"""


@query("f11_rolling_pair_corr", f"WITH {PAIR_WINDOW} SELECT di, key_a, key_b, round(r, 5) AS r FROM pw WHERE c >= 5 AND rn >= 10")
def _(t):
    return long_cols(rounded(W.rolling_pair_corr(returns(t), "di", "event_type", "r", 10, 5), 5, "r"), "di")


@query("f11_mean_pair_corr", f"""
WITH {PAIR_WINDOW} SELECT di, CASE WHEN key_a IN ('click', 'view') AND key_b IN ('click', 'view') THEN 'within' WHEN key_a IN ('click', 'view') OR key_b IN ('click', 'view') THEN 'across' ELSE 'other' END AS pair_group,
  round(avg(r), 5) AS mean_r, count(r) AS n_pairs FROM pw WHERE c >= 5 AND rn >= 10 GROUP BY 1, 2""")
def _(t):
    roll = W.rolling_pair_corr(returns(t), "di", "event_type", "r", 10, 5)
    a, b = F.col("key_a").isin("click", "view"), F.col("key_b").isin("click", "view")
    group = F.when(a & b, "within").when(a | b, "across").otherwise("other")
    return long_cols(rounded(W.mean_pair_corr(roll, "di", group), 5, "mean_r"), "di")


ACF = f"""{MPRIO}, x AS (SELECT priority, mi, value - avg(value) OVER (PARTITION BY priority) AS x FROM mprio),
l AS (SELECT unnest(range(0, 37)) AS lag), p AS (SELECT priority, sum(x * x) AS p FROM x GROUP BY 1),
acf AS (SELECT a.priority, lag, sum(a.x * b.x) / max(p) AS acf FROM x a JOIN l ON TRUE JOIN x b ON a.priority = b.priority AND b.mi = a.mi + lag JOIN p ON p.priority = a.priority GROUP BY 1, 2)"""


@query("f12_autocorrelation", f"WITH {ACF} SELECT priority, lag, round(acf, 6) AS acf FROM acf")
def _(t):
    return long_cols(rounded(W.autocorrelation(monthly_priority(t), ["priority"], "mi", "value", 36), 6, "acf"), "lag")


@query("f12_decorrelation", f"""
WITH {ACF}, n AS (SELECT *, lead(acf) OVER (PARTITION BY priority ORDER BY lag) AS nx FROM acf)
SELECT priority, coalesce(min(lag) FILTER (sign(acf) <> sign(nx)), 36) AS decorrelation FROM n GROUP BY 1""")
def _(t):
    acf = W.autocorrelation(monthly_priority(t), ["priority"], "mi", "value", 36)
    return long_cols(W.decorrelation(acf, ["priority"], 36), "decorrelation")


@query("f13_year_over_year", f"""
WITH {MONTHLY}, y AS (SELECT nation, yr, round(sum(value), 2) AS value FROM monthly GROUP BY 1, 2 HAVING count(*) = 12),
p AS (SELECT *, CASE WHEN lag(yr) OVER w = yr - 1 THEN lag(value) OVER w END AS prev FROM y WINDOW w AS (PARTITION BY nation ORDER BY yr))
SELECT nation, yr, value, round(value - prev, 2) AS change, round(100 * (value - prev) / prev, 6) AS change_pct FROM p""")
def _(t):
    y = monthly(t).groupBy("nation", "yr").agg(F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("m")).filter("m = 12").drop("m")
    return long_cols(rounded(rounded(W.year_over_year(y, ["nation"], "yr", "value"), 2, "change"), 6, "change_pct"), "yr")


@query("f14_first_last_mean", f"""
WITH {MONTHLY}, r AS (SELECT nation, value, row_number() OVER (PARTITION BY nation ORDER BY mi) AS a, row_number() OVER (PARTITION BY nation ORDER BY mi DESC) AS z FROM monthly)
SELECT nation, round(avg(value) FILTER (a <= 10), 4) AS first_mean, round(avg(value) FILTER (z <= 10), 4) AS last_mean,
  round(avg(value) FILTER (z <= 10) - avg(value) FILTER (a <= 10), 4) AS change FROM r GROUP BY 1""")
def _(t):
    return rounded(W.first_last_mean(monthly(t), ["nation"], "mi", "value", 10), 4, "first_mean", "last_mean", "change")


@query("f15_z_anomaly", f"""
WITH {DAILY}, z AS (SELECT event_type, di, value, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM daily WINDOW w AS (PARTITION BY event_type))
SELECT event_type, di, value, round(z, 6) AS z FROM z WHERE abs(z) >= 1.5""")
def _(t):
    out = W.z_anomaly(daily(t), ["event_type"], "value", 1.5)
    return long_cols(rounded(out.select("event_type", "di", "value", "z"), 6, "z"), "di")


@query("f15_local_z", f"""
WITH {MPRIO} SELECT priority, mi, round((avg(value) OVER (PARTITION BY priority ORDER BY mi ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - avg(value) OVER (PARTITION BY priority))
  / stddev_samp(value) OVER (PARTITION BY priority), 6) AS local_z FROM mprio""")
def _(t):
    return long_cols(rounded(W.local_z(monthly_priority(t), ["priority"], "mi", "value").select("priority", "mi", "local_z"), 6, "local_z"), "mi")


MRET = f"""{MPRIO}, mret AS (SELECT priority, mi, value / lag(value) OVER (PARTITION BY priority ORDER BY mi) - 1 AS r FROM mprio)"""


def monthly_returns(t):
    m = monthly_priority(t)
    prev = F.lag("value").over(W.by_time(["priority"], "mi"))
    return m.select("priority", "mi", (F.col("value") / prev - 1).alias("r"))


@query("f16_compound_return", f"""
WITH {MRET}, s AS (SELECT priority, q, CASE WHEN q % 5 <> 0 THEN q * 3 END AS a, q * 3 + 2 AS b FROM (SELECT DISTINCT priority FROM mprio), (SELECT unnest(range(0, 26)) AS q))
SELECT s.priority, q, round(exp(sum(coalesce(ln(1 + r), 0))) - 1, 8) AS compound FROM s LEFT JOIN mret ON mret.priority = s.priority AND mi BETWEEN coalesce(a, b) AND b GROUP BY 1, 2""")
def _(t):
    r = monthly_returns(t)
    s = r.select("priority").distinct().select("priority", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("q"))
    s = s.select("priority", F.col("q").cast("bigint").alias("q"), F.when(F.col("q") % 5 != 0, F.col("q") * 3).alias("a"), (F.col("q") * 3 + 2).alias("b"))
    return rounded(W.compound_return(s, r, ["priority"], "q", "a", "b", "mi", "r"), 8, "compound")


@query("f17_forward_return", f"""
WITH {MRET}, f AS (SELECT * FROM mret WHERE r IS NOT NULL)
SELECT priority, mi, round(CASE WHEN count(r) OVER w3 = 3 THEN exp(sum(ln(1 + r)) OVER w3) - 1 END, 8) AS fwd_3,
  round(CASE WHEN count(r) OVER w6 = 6 THEN exp(sum(ln(1 + r)) OVER w6) - 1 END, 8) AS fwd_6 FROM f
WINDOW w3 AS (PARTITION BY priority ORDER BY mi ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), w6 AS (PARTITION BY priority ORDER BY mi ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""")
def _(t):
    out = W.forward_return(monthly_returns(t).filter("r is not null"), ["priority"], "mi", "r", [3, 6]).drop("r")
    return long_cols(rounded(out, 8, "fwd_3", "fwd_6"), "mi")


@query("f18_variability", f"""
WITH {DAILY}, d AS (SELECT event_type, value, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY di)) AS d FROM daily)
SELECT event_type, count(*) AS n, round(stddev_pop(value) / avg(value), 8) AS cv, round(least(quantile_cont(value, 0.9) / quantile_cont(value, 0.1), 999), 8) AS p90_p10,
  round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / quantile_cont(value, 0.5), 8) AS iqr_median, round(sum(d) / sum(value), 8) AS flashiness FROM d GROUP BY 1""")
def _(t):
    return rounded(W.variability(daily(t), ["event_type"], "di", "value"), 8, "cv", "p90_p10", "iqr_median", "flashiness")


@query("f19_seasonal_contrast", f"""
WITH s AS (SELECT c_nationkey AS nation, year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS sy, {SEASON} AS season, round(avg(o_totalprice), 4) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
c AS (SELECT nation, sy, max(v) FILTER (season = CASE WHEN nation % 2 = 0 THEN 'JJA' ELSE 'DJF' END) - max(v) FILTER (season = CASE WHEN nation % 2 = 0 THEN 'DJF' ELSE 'JJA' END) AS d FROM s GROUP BY 1, 2)
SELECT nation, count(d) AS n, CASE WHEN count(d) < 3 THEN 0 ELSE round(regr_slope(d, sy), 3) END::DOUBLE AS slope, CASE WHEN count(d) < 3 THEN 0 ELSE round(regr_r2(d, sy), 6) END::DOUBLE AS r2 FROM c WHERE d IS NOT NULL GROUP BY 1""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), "o_orderdate", "o_totalprice")
    s = rounded(season_mean(o, ["nation"], "o_orderdate", "o_totalprice"), 4, "mean_value")
    c = W.seasonal_contrast(s, ["nation"], "season_year", "season", "mean_value", F.col("nation") % 2 == 0)
    out = ols_trend(c, ["nation"], "season_year", "contrast", tests=False).select("nation", "n", "slope", "r2")
    return rounded(rounded(out, 3, "slope"), 6, "r2")


@query("f19_season_extremes", f"""
WITH s AS (SELECT o_orderpriority AS priority, year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS sy, {SEASON} AS season, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2, 3),
f AS (SELECT priority, season, regr_slope(v, sy) AS b FROM s GROUP BY 1, 2)
SELECT priority, arg_max(season, b) AS fastest, arg_min(season, b) AS slowest, round(max(b) / min(b), 5) AS asymmetry FROM f GROUP BY 1""")
def _(t):
    s = rounded(season_mean(t.orders, ["o_orderpriority"], "o_orderdate", "o_totalprice"), 4, "mean_value").withColumnRenamed("o_orderpriority", "priority")
    f = ols_trend(s, ["priority", "season"], "season_year", "mean_value", tests=False)
    return rounded(W.season_extremes(f, ["priority"], "season", "slope"), 5, "asymmetry")


def breaches(t):
    from seriesloom.operators.split import with_group_stats
    flags = with_group_stats(daily(t), ["event_type"], m=F.avg("value")).withColumns({"flag": F.col("value") > 1.05 * F.col("m"), "rn": F.col("di").cast("bigint")})
    top = flags.groupBy("rn").agg(F.count_if("flag").alias("k"))
    onsets = top.filter("k >= 3").select(F.col("rn").alias("onset"), F.concat(F.lit("day"), F.col("rn")).alias("onset_id"))
    return W.first_breach(flags, onsets, "event_type", "rn", "flag", "onset_id", "onset", 4, 3)


BREACH = f"""{DAILY}, fl AS (SELECT event_type, di AS rn, value > 1.05 * avg(value) OVER (PARTITION BY event_type) AS flag FROM daily),
os AS (SELECT rn AS onset FROM fl GROUP BY 1 HAVING count(*) FILTER (flag) >= 3),
fb AS (SELECT onset, event_type, min(rn) AS breach FROM fl JOIN os ON abs(rn - onset) <= 4 WHERE flag GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY onset ORDER BY breach, event_type) AS position, count(*) OVER (PARTITION BY onset) AS n_breached FROM fb),
br AS (SELECT concat('day', onset) AS onset_id, event_type, breach, position, n_breached, max(breach) FILTER (position - 1 = n_breached // 2) OVER (PARTITION BY onset) - breach AS lead FROM rk)"""


@query("f20_first_breach", f"WITH {BREACH} SELECT onset_id, event_type, breach, n_breached, lead, position FROM br WHERE n_breached >= 3")
def _(t):
    return long_cols(breaches(t), "breach", "n_breached", "lead", "position")


@query("f20_lead_ranking", f"""
WITH {BREACH} SELECT event_type, count(*) AS n_onsets, round(avg(lead), 6) AS mean_lead, round(stddev_pop(lead), 6) AS spread, count(*) FILTER (position = 1) AS times_first,
  count(*) FILTER (position <= 3) AS times_top3, round(quantile_cont(lead, 0.5), 6) AS median_lead FROM br WHERE n_breached >= 3 GROUP BY 1""")
def _(t):
    return rounded(W.lead_ranking(breaches(t), "event_type", "onset_id"), 6, "mean_lead", "spread", "median_lead")

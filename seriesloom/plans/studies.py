"""Whole studies: each query composes the operators of one tool over the test tables."""

from pyspark.sql import functions as F

from seriesloom.functions import scalars as K
from seriesloom.operators import aggregates as A
from seriesloom.operators import episodes as G
from seriesloom.operators import evidence as E
from seriesloom.operators import portfolio as P
from seriesloom.operators import quality as B
from seriesloom.operators import ranking as R
from seriesloom.operators import spectral as H
from seriesloom.operators import stats as S
from seriesloom.operators import text as T
from seriesloom.operators import windows as W
from seriesloom.operators.joins import box_join, first_box
from seriesloom.operators.split import exact_quantiles, join_keys, row_positions, with_group_stats
from seriesloom.operators.thinning import thin_events
from seriesloom.plans import texts as TX
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import SEASON, rounded
from seriesloom.plans.inputs import DAILY, MONTHLY, daily, monthly, monthly_priority
from seriesloom.plans.joining import CATALOGUE, catalogue
from seriesloom.plans.portfolios import DATES, SIGNAL, signals
from seriesloom.plans.sourcing import BASIN_VALUES, REGION_CASE
from seriesloom.plans.sqlstats import p_normal, p_t
from seriesloom.plans.trends import MK_SQL, curve_sql, line_sql, valley_sql
from seriesloom.plans.windowing import long_cols
from seriesloom.session import checkpointed, stored
from seriesloom.sources import dimensions as D

PERIODS = [("full", 0, 79), ("early", 0, 39), ("late", 40, 79)]


@query("q01_warming_rank", f"""
WITH {MONTHLY}, s AS (SELECT concat(nation, '/', name) AS k, nation, name, mi, value FROM monthly JOIN (VALUES ('full', 0, 79), ('early', 0, 39), ('late', 40, 79)) p(name, lo, hi) ON mi BETWEEN lo AND hi),
{MK_SQL.format(k='k', src='s')}, f AS ({line_sql('s', 'k, nation, name', 'mi', 'value')}),
sen AS (SELECT a.k, quantile_cont((b.value - a.value) / (b.mi - a.mi), 0.5) * 12 AS sen FROM s a JOIN s b ON a.k = b.k AND a.mi < b.mi GROUP BY 1)
SELECT f.nation, n_name, f.name AS period, CAST(f.n AS BIGINT) AS n, round(slope * 12, 4) AS slope, round(r2, 6) AS r2, round({p_t('tt', '(f.n - 2)')}, 6) AS p_value, round(sen, 4) AS sen_slope,
  round(tau, 6) AS tau, round({p_normal('z.z')}, 6) AS mk_p, row_number() OVER (PARTITION BY f.name ORDER BY round(slope * 12, 4) DESC, f.nation) AS rank
FROM f JOIN z USING (k) JOIN sen USING (k) JOIN nation ON f.nation = n_nationkey""")
def _(t):
    """Monthly value per nation over three periods: line, robust slope, rank test, position by slope."""
    s = B.period_slice(monthly(t), "mi", PERIODS)
    keys = ["nation", "period"]
    fit = S.ols_trend(s, keys, "mi", "value", scale=12.0).select(*keys, "n", "slope", "r2", "p_value")
    mk = S.mann_kendall(s, keys, "mi", "value").select(*keys, "tau", F.col("p_value").alias("mk_p"))
    sen = S.sen_slope(s, keys, "mi", "value", scale=12.0, digits=4).select(*keys, "sen_slope")
    out = rounded(rounded(join_keys(join_keys(fit, mk, keys), sen, keys), 4, "slope"), 6, "r2", "p_value", "tau", "mk_p")
    ranked = row_positions(out, ["period"], "slope", "nation", True, "rank")
    return ranked.join(t.nation.select("n_nationkey", "n_name"), F.col("nation") == F.col("n_nationkey")).drop("n_nationkey")


@query("q02_extreme_days", f"""
WITH b AS (SELECT event_type, quantile_cont(value, 0.9) AS cut FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
x AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS di, count(*) FILTER (value > cut) AS v FROM events JOIN b USING (event_type) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY di) AS a, row_number() OVER (PARTITION BY event_type ORDER BY di DESC) AS z FROM x), f AS ({line_sql('x', 'event_type', 'di', 'v')})
SELECT event_type, CAST(max(f.n) AS BIGINT) AS n, round(max(slope) * 10, 6) AS slope, round(max({p_t('tt', '(f.n - 2)')}), 6) AS p_value, round(avg(v) FILTER (a <= 10), 6) AS first_mean, round(avg(v) FILTER (z <= 10), 6) AS last_mean FROM r JOIN f USING (event_type) GROUP BY 1""")
def _(t):
    e = t.events.withColumn("di", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    x = A.exceedance_count(e, ["event_type"], "di", "value", percentile=0.9, baseline=F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    fit = S.ols_trend(x, ["event_type"], "di", "n_beyond", scale=10.0).select("event_type", "n", "slope", "p_value")
    ends = W.first_last_mean(x, ["event_type"], "di", "n_beyond", 10).drop("change")
    return rounded(join_keys(fit, ends, ["event_type"]), 6, "slope", "p_value", "first_mean", "last_mean")


@query("q03_seasonal_trends", f"""
WITH s AS (SELECT o_orderpriority AS priority, year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS sy, {SEASON} AS season, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2, 3), f AS ({line_sql('s', 'priority, season', 'sy', 'v')})
SELECT priority, season, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round({p_t('tt', '(n - 2)')}, 6) AS p_value, season = first_value(season) OVER (PARTITION BY priority ORDER BY slope DESC) AS fastest FROM f""")
def _(t):
    s = rounded(A.season_mean(t.orders.withColumnRenamed("o_orderpriority", "priority"), ["priority"], "o_orderdate", "o_totalprice"), 4, "mean_value")
    fit = S.ols_trend(s, ["priority", "season"], "season_year", "mean_value").select("priority", "season", "n", "slope", "p_value")
    best = W.season_extremes(fit, ["priority"], "season", "slope").select("priority", F.col("fastest").alias("__f"))
    out = join_keys(fit, best, ["priority"]).withColumn("fastest", F.col("season") == F.col("__f")).drop("__f")
    return rounded(out, 6, "slope", "p_value")


@query("q04_volatility_index", f"""
WITH {MONTHLY}, d AS (SELECT nation, yr, value, abs(value - lag(value) OVER (PARTITION BY nation ORDER BY mi)) AS d FROM monthly),
y AS (SELECT nation, yr, avg(d) AS swing, stddev_samp(value) AS sd, stddev_pop(value) / avg(value) AS cv, max(value) - min(value) AS rg FROM d GROUP BY 1, 2 HAVING count(*) = 12),
s AS (SELECT nation, regr_slope(swing, yr) / avg(swing) AS a, regr_slope(sd, yr) / avg(sd) AS b, regr_slope(cv, yr) / avg(cv) AS c, regr_slope(rg, yr) / avg(rg) AS e FROM y GROUP BY 1)
SELECT nation, round(a, 6) AS swing, round(b, 6) AS std, CASE WHEN isfinite((a - e + 10 * c + 10 * b) / (abs(a) + abs(e) + abs(10 * c) + abs(10 * b))) THEN round((a - e + 10 * c + 10 * b) / (abs(a) + abs(e) + abs(10 * c) + abs(10 * b)), 6) ELSE 0 END AS volatility FROM s""")
def _(t):
    d = monthly(t).withColumn("d", F.abs(F.col("value") - F.lag("value").over(W.by_time(["nation"], "mi"))))
    y = d.groupBy("nation", "yr").agg(F.count(F.lit(1)).alias("m"), F.avg("d").alias("swing"), F.stddev_samp("value").alias("sd"), (F.stddev_pop("value") / F.avg("value")).alias("cv"),
                                      (F.max("value") - F.min("value")).alias("rg")).filter("m = 12")
    s = y.groupBy("nation").agg(*[(F.regr_slope(c, "yr") / F.avg(c)).alias(c) for c in ("swing", "sd", "cv", "rg")])
    return s.select("nation", F.round("swing", 6).alias("swing"), F.round("sd", 6).alias("std"),
                    F.round(S.composite_index(F.col("swing"), -F.col("rg"), 10 * F.col("cv"), 10 * F.col("sd")), 6).alias("volatility"))


@query("q05_model_skill", f"""
WITH {MONTHLY}, p AS (SELECT o.nation, o.yr, o.value AS o, m.value AS m FROM monthly o JOIN monthly m ON o.nation = m.nation AND o.mi = m.mi + 12)
SELECT nation, count(*) AS n, round(avg(m - o), 6) AS bias, round(sqrt(avg((m - o) * (m - o))), 3) AS rmse, round(avg(abs(m - o)), 6) AS mae, count(*) FILTER (o > m) AS n_above, count(*) FILTER (o < m) AS n_below,
  round(100.0 * count(*) FILTER (o BETWEEN m * 0.7 AND m * 1.3) / count(*), 6) AS pct_inside FROM p GROUP BY 1""")
def _(t):
    o = monthly(t).select("nation", "mi", F.col("value").alias("o"))
    m = monthly(t).select("nation", (F.col("mi") + 12).alias("mi"), F.col("value").alias("m"))
    out = S.skill_scores(join_keys(o, m, ["nation", "mi"]), ["nation"], F.col("o"), F.col("m"), F.col("m") * 0.7, F.col("m") * 1.3)
    return rounded(rounded(out, 6, "bias", "mae", "pct_inside"), 3, "rmse")


@query("q06_gauge_regions", f"""
WITH {MONTHLY}, f AS ({line_sql('monthly', 'nation', 'mi', 'value')}), c AS (SELECT nation, value AS y, mi - avg(mi) OVER (PARTITION BY nation) AS t FROM monthly),
m AS (SELECT nation, regr_sxx(y, t) AS tt, regr_sxx(y, t * t) AS qq, regr_sxy(y, t) AS ty, regr_sxy(y, t * t) AS qy, regr_sxy(t * t, t) AS tq FROM c GROUP BY 1),
a AS (SELECT nation, 2 * (qy - tq * ty / tt) / (qq - tq * tq / tt) AS acc FROM m)
SELECT n_regionkey AS region, count(*) AS n, round(avg(slope), 4) AS mean_slope, round(avg(acc), 4) AS mean_acceleration, count(*) FILTER (slope > 0) AS n_up, round(quantile_cont(slope, 0.5), 4) AS median_slope
FROM f JOIN a USING (nation) JOIN nation ON nation = n_nationkey GROUP BY 1""")
def _(t):
    m = monthly(t)
    fit = S.ols_trend(m, ["nation"], "mi", "value", tests=False).select("nation", "slope")
    acc = S.quadratic_fit(m, ["nation"], "mi", "value", tests=False).select("nation", "acceleration")
    both = join_keys(fit, acc, ["nation"]).join(t.nation, F.col("nation") == F.col("n_nationkey")).withColumn("region", F.col("n_regionkey"))
    g = both.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("slope").alias("mean_slope"), F.avg("acceleration").alias("mean_acceleration"), F.count_if(F.col("slope") > 0).alias("n_up"))
    return rounded(join_keys(g, exact_quantiles(both, ["region"], "slope", {"median_slope": 0.5}, n=1), ["region"]), 4, "mean_slope", "mean_acceleration", "median_slope")


@query("q07_basin_anomalies", f"""
WITH p AS (SELECT DISTINCT user_id, (user_id * 7919) % 1400 / 10.0 - 70 AS la, (user_id * 104729) % 3600 / 10.0 - 180 AS lo FROM events), m AS (SELECT DISTINCT user_id, la, basin FROM p JOIN (VALUES {BASIN_VALUES}) b(basin, a, b, c, d) ON la BETWEEN a AND b AND lo BETWEEN c AND d),
dd AS (SELECT basin, date_diff('day', DATE '2024-01-01', ts::DATE) AS di, round(sum(cos(radians(la)) * value) / sum(cos(radians(la))), 6) AS v FROM events JOIN m USING (user_id) GROUP BY 1, 2),
an AS (SELECT basin, di, v - avg(v) FILTER (di < 15) OVER (PARTITION BY basin) AS x FROM dd), i AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY di) - row_number() OVER (PARTITION BY basin, x >= 1 ORDER BY di) AS g FROM an)
SELECT basin, min(di) AS "start", max(di) AS "end", count(*) AS length, round(max(x), 4) AS peak, round(avg(x), 4) AS mean_value FROM i WHERE x >= 1 GROUP BY basin, g HAVING count(*) >= 2""")
def _(t):
    la, lo = (F.col("user_id") * 7919) % 1400 / 10.0 - 70, (F.col("user_id") * 104729) % 3600 / 10.0 - 180
    cells = box_join(t.events.select("user_id", la.alias("la"), lo.alias("lo")).distinct(), "la", "lo", D.OCEAN_BASINS, "basin")
    e = t.events.withColumn("di", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).join(cells, "user_id")
    d = rounded(A.weighted_mean(e, ["basin", "di"], F.col("value"), F.cos(F.radians("la"))), 6, "weighted_mean")
    a = with_group_stats(d, ["basin"], base=F.avg(F.when(F.col("di") < 15, F.col("weighted_mean")))).withColumn("x", F.col("weighted_mean") - F.col("base"))
    out = G.episodes(a, ["basin"], "di", F.col("x") >= 1, "x", 2).select("basin", "start", "end", "length", "peak", "mean_value")
    return long_cols(rounded(out, 4, "peak", "mean_value"), "start", "end")


@query("q08_streamflow", f"""
WITH {DAILY}, d AS (SELECT event_type, di, value, abs(value - lag(value) OVER w) AS ch, CASE WHEN count(*) OVER w7 = 7 THEN avg(value) OVER w7 END AS m7, sum(value) OVER w AS run, sum(value) OVER (PARTITION BY event_type) AS whole FROM daily
  WINDOW w AS (PARTITION BY event_type ORDER BY di), w7 AS (PARTITION BY event_type ORDER BY di ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 4) AS "median", round(min(m7), 6) AS low_7, min(di) FILTER (run >= 0.25 * whole) AS q25_day, min(di) FILTER (run >= 0.5 * whole) AS q50_day,
  round(sum(ch) / sum(value), 8) AS flashiness FROM d GROUP BY 1""")
def _(t):
    d = daily(t)
    base = A.describe(d, ["event_type"], "value").select("event_type", "mean", "median")
    low = W.rolling_mean_min(d, ["event_type"], "di", "value", 7, "low_7")
    point = A.cumulative_share_point(d, ["event_type"], "di", "value", {"q25_day": 0.25, "q50_day": 0.5})
    var = W.variability(d, ["event_type"], "di", "value").select("event_type", "flashiness")
    out = join_keys(join_keys(join_keys(base, low, ["event_type"]), point, ["event_type"]), var, ["event_type"])
    return long_cols(rounded(rounded(rounded(out, 6, "mean", "low_7"), 4, "median"), 8, "flashiness"), "q25_day", "q50_day")


@query("q09_catalogue", f"""
WITH {CATALOGUE}, r AS (SELECT *, {REGION_CASE.replace('la BETWEEN', 'lat BETWEEN').replace('lo BETWEEN', 'lon BETWEEN')} AS region FROM cat), bins AS (SELECT region, floor(mag * 10) AS b, count(*) AS c FROM r GROUP BY 1, 2),
mc AS (SELECT region, round(arg_min(b, (-c, b)) / 10 + 0.2, 1) AS mc, CAST(sum(c) AS BIGINT) AS n_total FROM bins GROUP BY 1), m AS (SELECT region, max(mc) AS mc, max(n_total) AS n_total, count(*) AS n, avg(mag) AS mm FROM r JOIN mc USING (region) WHERE mag >= mc GROUP BY 1 HAVING count(*) >= 10),
g AS (SELECT region, (t - lag(t) OVER (PARTITION BY region ORDER BY t, id)) / 86400.0 AS d FROM r), s AS (SELECT region, count(d) AS n_gaps, stddev_pop(d) / avg(d) AS cv FROM g WHERE d IS NOT NULL GROUP BY 1)
SELECT region, mc, n_total, n, round(log10(exp(1)) / (mm - mc + 0.05), 6) AS b, n_gaps, round(cv, 6) AS cv FROM m JOIN s USING (region)""")
def _(t):
    cat = catalogue(t).withColumn("region", first_box(F.col("lat"), F.col("lon"), D.SEISMIC_REGIONS, "intraplate")).withColumn("ts", F.timestamp_seconds("t"))
    b = S.b_value(cat, ["region"], "mag").select("region", "mc", "n_total", "n", "b")
    gaps = A.dispersion_of_gaps(cat, ["region"], "ts", "id").select("region", "n_gaps", "cv")
    return rounded(join_keys(b, gaps, ["region"]), 6, "b", "cv")


@query("q09_aftershocks")
def _(t):
    """Thinned main events with their decay fits."""
    from seriesloom.operators.joins import neighbourhood_join
    cat = catalogue(t)
    mains = thin_events(cat.filter("mag >= 6")).select("id", "t", "mag", "lat", "lon")
    pairs = neighbourhood_join(mains, cat, 90, F.pow(F.lit(10.0), 0.5 * F.col("m_mag") - 1.78), 1000.0, tags=("mag",))
    fits = S.omori_fit(pairs.select("m_id", (F.col("gap_s") / 86400).alias("d")), ["m_id"], "d")
    bath = S.baths_law(pairs, mains.select(F.col("id").alias("m_id"), F.col("mag").alias("main_mag")), "m_id", "main_mag", "mag")
    return rounded(join_keys(bath.select("m_id", "main_mag", "largest", "n_after", "gap"), fits.select("m_id", "rate_k", "c", "p", "aic"), ["m_id"], "left"), 6, "main_mag", "largest", "gap", "rate_k", "c", "p", "aic")


@query("q10_cycles")
def _(t):
    """Cycle segments per priority beside the best sinusoid and the strongest spectral peak."""
    m = monthly_priority(t).withColumn("v", F.col("value") / 1e6)
    seg = G.cycle_segments(m, ["priority"], "mi", "v", [(1, 8), (2, 30), (3, 52), (4, 70)], 6)
    fit = S.harmonic_fit(m, ["priority"], "mi", "v", H.period_grid(6, 60, 40)).select("priority", F.col("period").alias("best_period"), "p_value")
    peak = H.spectral_peaks(H.periodogram(m, ["priority"], "mi", "v"), ["priority"], "f_idx", n_peaks=1).select("priority", F.col("period").alias("peak_years"))
    out = join_keys(join_keys(seg, fit, ["priority"]), peak, ["priority"], "left")
    return rounded(out.drop("n"), 6, "min_value", "max_value", "total", "asymmetry", "best_period", "p_value", "peak_years")


@query("q11_demographics", """
WITH p AS (SELECT *, (p_retailprice - 895) / 7.0 AS r, pow(p_size, 1.8) AS per FROM part),
c AS (SELECT CASE WHEN r < 0.8 THEN 'sub-Earth' WHEN r < 1.25 THEN 'Earth-like' WHEN r < 2 THEN 'super-Earth' WHEN r < 3.5 THEN 'sub-Neptune' WHEN r < 6 THEN 'Neptune' WHEN r < 10 THEN 'sub-Saturn' WHEN r < 25 THEN 'gas giant' ELSE 'super-Jupiter' END AS planet,
  CASE WHEN per < 1 THEN 'ultra-short (P<1d)' WHEN per < 10 THEN 'short (1-10d)' WHEN per < 100 THEN 'moderate (10-100d)' WHEN per < 1000 THEN 'long (100-1000d)' ELSE 'very long (>1000d)' END AS bin FROM p)
SELECT d.planet, lv.level, count(c.bin) AS n FROM (SELECT DISTINCT planet FROM c) d CROSS JOIN (VALUES ('ultra-short (P<1d)'), ('short (1-10d)'), ('moderate (10-100d)'), ('long (100-1000d)'), ('very long (>1000d)')) lv(level)
LEFT JOIN c ON c.planet = d.planet AND c.bin = lv.level GROUP BY 1, 2""")
def _(t):
    p = t.part.select(K.planet_type((F.col("p_retailprice") - 895) / 7.0).alias("planet"), K.period_bin(F.pow(F.col("p_size").cast("double"), F.lit(1.8))).alias("bin"))
    return A.crosstab(p, "planet", "bin", [b[2] for b in K.PERIOD_BINS])


@query("q11_radius_valley", f"""
WITH qc AS (SELECT p_type, v, CASE WHEN f > 0 THEN 1.0 / (f * v * f * v) ELSE 1.0 END AS wt FROM (SELECT p_type, p_retailprice AS v, CASE WHEN p_size % 3 = 0 THEN greatest(p_size * 0.9, p_size * 1.1) ELSE p_size * 0.9 END / p_retailprice AS f FROM part)
  WHERE v BETWEEN 900 AND 1000 AND f <= 0.2), {curve_sql('qc', 'p_type', 'v', 'wt', 0.0015, 2.95, 3.0, 1000)}, {valley_sql('cv', 'p_type', 0.004)}""")
def _(t):
    """Quality cuts, weights, log density and its valley per part type."""
    src = t.part.select("p_partkey", "p_type", "p_retailprice", (F.col("p_size") * 0.9).alias("up"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") * -1.1).alias("down"))
    cut = B.quality_cuts(src, "p_retailprice", "up", "down", 900, 1000)
    curve = S.weighted_kde(cut, ["p_type"], "p_retailprice", F.col("weight"), 0.0015, 2.95, 3.0, 1000)
    return rounded(S.valley_detect(curve, ["p_type"], min_gap=0.004), 6, "peak_low", "peak_high", "low_density", "high_density", "valley", "valley_density", "depth", "width_log")


@query("q12_grid_mix", f"""
WITH {DAILY}, s AS (SELECT event_type, di, 100.0 * value / sum(value) OVER (PARTITION BY di) AS sh FROM daily), d AS (SELECT di, stddev_pop(value) AS spread FROM daily GROUP BY 1),
f AS ({line_sql('s', 'event_type', 'di', 'sh')}), c AS (SELECT event_type, corr(sh, spread) AS r FROM s JOIN d USING (di) GROUP BY 1)
SELECT event_type, round(slope, 6) AS share_slope, round({p_t('tt', '(n - 2)')}, 6) AS p_value, round(r, 6) AS spread_r FROM f JOIN c USING (event_type)""")
def _(t):
    d = daily(t)
    s = A.share_of_total(d, ["di"], "event_type", "value")
    spread = A.group_divergence(d, ["di"], "event_type", "value").select("di", "spread")
    fit = S.ols_trend(s, ["event_type"], "di", "share_pct").select("event_type", F.col("slope").alias("share_slope"), "p_value")
    r = S.pearson(s.join(spread, "di"), ["event_type"], "share_pct", "spread", tests=False).select("event_type", F.col("r").alias("spread_r"))
    return rounded(join_keys(fit, r, ["event_type"]), 6, "share_slope", "p_value", "spread_r")


@query("q13_blended_rate", """
WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS ym, year(l_shipdate) AS yr, l_returnflag AS k, sum(l_extendedprice * l_discount) AS wx, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT ym, yr, sum(wx) / sum(w) * 100 AS blended, sum(w) AS total, max(w) / sum(w) AS top_share FROM m GROUP BY 1, 2)
SELECT ym, round(blended, 8) AS blended, round(total, 2) AS total, round(top_share, 8) AS top_share, round(sum(total) OVER (PARTITION BY yr ORDER BY ym), 2) AS year_to_date FROM t""")
def _(t):
    li = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("ym"), F.year("l_shipdate").alias("yr"), "l_returnflag", "l_discount", "l_extendedprice")
    m = li.groupBy("ym", "yr", "l_returnflag").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("wx"), F.sum("l_extendedprice").alias("w"))
    r = m.groupBy("ym", "yr").agg((F.sum("wx") / F.sum("w") * 100).alias("blended"), F.sum("w").alias("total"), (F.max("w") / F.sum("w")).alias("top_share"))
    out = r.withColumn("year_to_date", F.sum("total").over(W.by_time(["yr"], "ym"))).drop("yr")
    return rounded(rounded(out, 8, "blended", "top_share"), 2, "total", "year_to_date")


@query("q14_contagion")
def _(t):
    """Daily returns, decayed volatility, breadth episodes, and correlation inside against before."""
    r = W.log_return(daily(t), ["event_type"], "di", "value", name="r")
    vol = W.ewma_variance(r, ["event_type"], "di", "r", window=10, min_obs=8).withColumns({"vol": F.sqrt("ewma_var") * (252 ** 0.5), "di": F.col("di").cast("bigint")})
    flags = G.threshold_flags(vol, ["event_type"], "vol", 1.1)
    index = G.breadth_index(flags, "di", "vol")
    eps = G.breadth_episodes(index, "di", "share", 0.4, None, None, 2, False)
    corr = W.mean_pair_corr(W.rolling_pair_corr(r.withColumn("di", F.col("di").cast("bigint")), "di", "event_type", "r", 10, 5), "di")
    members = G.episode_members(flags, eps, "di", "event_type", "vol")
    profile = G.episode_profile(index, members, eps, "di")
    out = profile.join(G.episode_effect(corr, eps, "di", "mean_r", 10), "episode", "left")
    return rounded(out, 6, "peak_breadth", "mean_breadth", "severity_ratio", "severity", "during", "calm", "surge")


@query("q15_occurrence_bias", f"""
WITH {MONTHLY}, g AS (SELECT yr, nation, sum(n) AS c FROM monthly GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY c) AS i FROM g)
SELECT yr, count(*) AS n_groups, CAST(sum(c) AS DOUBLE) AS n_total, round((2 * sum(i * c) - (count(*) + 1) * sum(c)) * 1.0 / (count(*) * sum(c)), 8) AS gini,
  round(-sum(c * 1.0 / tot * ln(c * 1.0 / tot)), 8) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY yr) AS tot FROM r) GROUP BY 1""")
def _(t):
    g = monthly(t).groupBy(F.col("yr").cast("bigint").alias("yr"), "nation").agg(F.sum("n").alias("c"))
    gini = A.gini(g, ["yr"], "c").select("yr", F.col("n").alias("n_groups"), "gini")
    ent = A.shannon_entropy(g, ["yr"], "nation", 2.718281828459045, "c").select("yr", "n_total", "entropy")
    return rounded(join_keys(gini, ent, ["yr"]), 8, "gini", "entropy")


@query("q16_bibliometrics", """
WITH y AS (SELECT o_custkey AS topic, count(*) FILTER (year(o_orderdate) <= 1996) AS a, count(*) FILTER (year(o_orderdate) >= 2000) AS b FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY a DESC, topic) AS rank_before, row_number() OVER (ORDER BY b DESC, topic) AS rank_after FROM y)
SELECT topic, a, b, rank_before, rank_after, rank_before - rank_after AS rank_change, CASE WHEN a < 2 AND b >= 2 THEN 'emerged' WHEN a >= 2 AND b < 2 THEN 'disappeared' WHEN a > 0 AND b > 0 AND pow(b * 1.0 / a, 0.25) - 1 > 0.02 THEN 'growing'
  WHEN a > 0 AND b > 0 AND pow(b * 1.0 / a, 0.25) - 1 < -0.02 THEN 'declining' ELSE 'stable' END AS category, round(CASE WHEN a > 0 AND b > 0 THEN pow(b * 1.0 / a, 0.25) - 1 END, 8) AS cagr FROM r""")
def _(t):
    y = t.orders.groupBy(F.col("o_custkey").alias("topic")).agg(F.count_if(F.year("o_orderdate") <= 1996).alias("a"), F.count_if(F.year("o_orderdate") >= 2000).alias("b"))
    ranked = R.rank_change(y, "topic", "a", "b")
    return ranked.withColumns({"category": K.growth_class(F.col("a"), F.col("b"), 4, 2), "cagr": F.round(S.growth_rate(F.col("a"), F.col("b"), 4.0), 8)})


@query("q17_attention_gap", """
WITH sci AS (SELECT l_partkey AS k, count(*) AS pubs, sum(l_quantity) AS q FROM lineitem GROUP BY 1), j AS (SELECT p_partkey, p_name, pubs, p_retailprice AS views FROM part JOIN sci ON k = p_partkey WHERE pubs >= 20),
p AS (SELECT *, (rank() OVER (ORDER BY pubs) - 1 + 0.5 * count(*) OVER (PARTITION BY pubs)) / count(*) OVER () AS sp, (rank() OVER (ORDER BY views) - 1 + 0.5 * count(*) OVER (PARTITION BY views)) / count(*) OVER () AS ap FROM j)
SELECT p_partkey, p_name, pubs, round(sp, 8) AS science_pct, round(ap, 8) AS attention_pct, round(sp - ap, 8) AS gap, CASE WHEN lower(p_name) LIKE '%ring%' THEN 'named' ELSE '' END AS flags FROM p ORDER BY round(sp - ap, 8) DESC, p_partkey LIMIT 30""")
def _(t):
    sci = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("pubs"))
    j = t.part.select("p_partkey", "p_name", F.col("p_retailprice").alias("views")).join(sci, "p_partkey").filter("pubs >= 20")
    ranked = S.percentile_rank_mid(S.percentile_rank_mid(j, [], "pubs", "science_pct"), [], "views", "attention_pct")
    ranked = ranked.withColumn("gap", F.round(F.col("science_pct") - F.col("attention_pct"), 8))
    flagged = B.flag_quality(ranked, {"named": F.lower("p_name").contains("ring")}).withColumn("flags", F.concat_ws("|", "flags"))
    return rounded(R.top_n(flagged, "gap", "p_partkey", 30).drop("views"), 8, "science_pct", "attention_pct")


@query("q18_attention_persistence", """
WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS yr, count(*) AS c FROM orders GROUP BY 1, 2), s AS (SELECT k, avg(c) FILTER (yr IN (1995, 1996)) AS pre, avg(c) FILTER (yr IN (1997, 1998)) AS peak, avg(c) FILTER (yr >= 1999) AS post FROM y GROUP BY 1),
m AS (SELECT k, 'surge' AS me FROM s WHERE pre >= 1 AND peak >= 2 AND peak / pre >= 1.5 UNION SELECT c_custkey, 'keyword' FROM customer WHERE contains(lower(c_mktsegment), 'build')),
u AS (SELECT k, string_agg(me, '|' ORDER BY me) AS methods FROM m GROUP BY 1)
SELECT methods, CASE WHEN 100 * (post - pre) / pre > 50 THEN 'retained' WHEN 100 * (post - pre) / pre > 10 THEN 'partially_retained' WHEN 100 * (post - pre) / pre >= -10 THEN 'snapped_back' ELSE 'declined' END AS attention, count(*) AS n FROM u JOIN s USING (k) GROUP BY 1, 2""")
def _(t):
    y = t.orders.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("c"))
    surge = S.surge_ratio(y, ["k"], "yr", "c", (1995, 1996), (1997, 1998), 1, 2, 1.5)
    words = E.keyword_match(t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment", F.array().cast("array<string>").alias("kws")), "c_mktsegment", "kws", ["build"])
    methods = R.merged_methods({"surge": surge, "keyword": words}, "k").select("k", F.concat_ws("|", "methods").alias("methods"))
    base = y.groupBy("k").agg(F.avg(F.when(F.col("yr").isin(1995, 1996), F.col("c"))).alias("pre"), F.avg(F.when(F.col("yr") >= 1999, F.col("c"))).alias("post"))
    both = methods.join(base, "k").withColumn("attention", K.attention_class(100 * (F.col("post") - F.col("pre")) / F.col("pre")))
    return both.groupBy("methods", "attention").agg(F.count(F.lit(1)).alias("n"))


@query("q19_web_evidence")
def _(t):
    """Pages to scores, consistency per language group, claims, near-duplicate removal, themes and their strength."""
    # parsed pages, claims and kept claims feed several branches each: cut the plan after them. Pages are written before they
    # are filtered: a filter would be pushed below the parser's projections and hold a copy of the whole parser a use of a column
    pages = stored(TX.scored_pages(t).drop("html")).filter("ok").withColumn("grp", F.concat_ws("-", F.lit("g"), F.floor(F.col("page_id") / 25).cast("string")))
    terms = T.key_terms(pages, "page_id", "text", keep=["grp"]).select("grp", "page_id", "term")
    cons = E.consistency(terms, "grp", "page_id").select("page_id", "consistency")
    scored = pages.join(cons, "page_id").withColumn("score", E.composite()).filter("score >= 3")
    claims = T.web_claims(scored, "page_id", "text", extra=["grp", "score"])
    claims = checkpointed(claims.withColumn("cid", F.col("page_id") * 100 + F.col("rank")))
    kept = checkpointed(E.dedup_near(claims, ["grp"], "cid", "claim"))
    ct = E.term_frequency(kept, "grp", "cid", "claim")
    dist = E.distinctive_terms(ct, "grp", "cid", ct.select("grp", F.lit("the").alias("term")).distinct())
    themes = E.grow_themes(E.cooccurrence(ct, dist, "grp", "cid"), dist, "grp")
    assigned = E.assign_themes(ct, themes, "grp", "cid").join(kept.select("grp", "cid", "page_id", "score"), ["grp", "cid"])
    return rounded(E.theme_strength(assigned, "grp", "page_id", "score"), 6, "mean_score", "evidence")


@query("q20_literature_agreement", f"""
WITH {TX.ABSTRACT_CLAIMS}, f(finding, fd, fv) AS (VALUES (0, 'increase', 12.5), (1, 'decrease', NULL), (2, NULL, 30.0))
SELECT finding, CASE WHEN fd IS NULL AND direction IS NULL THEN 'unclear' WHEN fd IS NULL OR direction IS NULL THEN 'related' WHEN fd <> direction THEN 'disagrees' WHEN fv IS NOT NULL AND value IS NOT NULL AND abs(fv - value) / greatest(abs(fv), abs(value)) > 0.5 THEN 'related' ELSE 'agrees' END AS agreement,
  count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM cl, f GROUP BY 1, 2""")
def _(t):
    claims = T.extract_claims(TX.abstracts(t), "p_partkey", "text")
    found = F.array(*[F.struct(F.lit(i).alias("finding"), *[c.alias(n) for n, c in E.parse_finding(F.lit(x)).items()]) for i, x in enumerate(TX.FINDINGS)])
    pairs = claims.select("value", "direction", "confidence", F.explode(found).alias("f"))
    verdict = E.agreement(F.col("f.direction"), F.col("f.value"), F.col("direction"), F.col("value"))
    return pairs.groupBy(F.col("f.finding").alias("finding"), verdict.alias("agreement")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("q21_signal_portfolio", f"""
WITH {SIGNAL}, b AS (SELECT as_of, k, ntile(5) OVER (PARTITION BY as_of ORDER BY composite DESC, k) AS bucket FROM sg),
nx AS (SELECT o_custkey AS k, 9500 + 250 * ((date_diff('day', DATE '1970-01-01', o_orderdate::DATE) - 9500) // 250) AS as_of, round(sum(o_totalprice) / 1e6, 6) AS r FROM orders WHERE date_diff('day', DATE '1970-01-01', o_orderdate::DATE) >= 9500 GROUP BY 1, 2)
SELECT as_of, round(avg(coalesce(r, 0)) FILTER (bucket = 1), 8) AS strategy, round(avg(coalesce(r, 0)), 8) AS equal_weight, avg(coalesce(r, 0)) FILTER (bucket = 1) > avg(coalesce(r, 0)) AS won, count(*) AS n FROM b LEFT JOIN nx USING (k, as_of) GROUP BY 1""")
def _(t):
    ranked = P.quantile_buckets(signals(t), ["as_of"], "composite", "k")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    nxt = (t.orders.filter(day >= DATES[0]).groupBy(F.col("o_custkey").alias("k"), (DATES[0] + 250 * F.floor((day - DATES[0]) / 250)).cast("int").alias("as_of"))
           .agg(F.round(F.sum("o_totalprice") / 1e6, 6).alias("r")))
    both = ranked.join(nxt, ["k", "as_of"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    top = F.avg(F.when(F.col("bucket") == 1, F.col("r")))
    out = both.groupBy("as_of").agg(top.alias("strategy"), F.avg("r").alias("equal_weight"), F.count(F.lit(1)).alias("n")).withColumn("won", F.col("strategy") > F.col("equal_weight"))
    return long_cols(rounded(out, 8, "strategy", "equal_weight"), "as_of")

"""Episode queries."""

from pyspark.sql import functions as F

from seriesloom.operators import episodes as E
from seriesloom.operators.joins import series_pairs
from seriesloom.operators.stats import ols_trend, pearson, spearman
from seriesloom.operators.windows import mean_pair_corr, rolling_event_counts, rolling_pair_corr
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import rounded
from seriesloom.plans.inputs import DAILY, HOURLY, MPRIO, daily, hourly, monthly_priority
from seriesloom.plans.windowing import long_cols, returns, seconds, windows_sql


def islands(src: str, key: str, t: str, cond: str, value: str) -> str:
    return f"""isl AS (SELECT {key}, {t} AS t, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {t}) - row_number() OVER (PARTITION BY {key}, ({cond}) ORDER BY {t}) AS g,
  ({cond}) AS ok, max({t}) OVER (PARTITION BY {key}) AS last_t FROM {src}),
runs AS (SELECT {key}, min(t) AS s, max(t) AS e, count(*) AS len, arg_min(v, (-abs(v), t)) AS peak, arg_min(t, (-abs(v), t)) AS peak_time, avg(v) AS mean_value, max(t) = max(last_t) AS ongoing
  FROM isl WHERE ok GROUP BY {key}, g)"""


@query("g01_episodes", f"""
WITH {HOURLY}, {islands('hourly', 'event_type', 'hi', 'value < 100', 'value')}
SELECT event_type, s AS "start", e AS "end", len AS length, peak, peak_time, round(mean_value, 6) AS mean_value, ongoing FROM runs WHERE len >= 3""")
def _(t):
    out = E.episodes(hourly(t), ["event_type"], "hi", F.col("value") < 100, "value", min_len=3)
    return long_cols(rounded(out, 6, "mean_value"), "start", "end", "peak_time")


@query("g01_episodes_raw", """
WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value < 40 ORDER BY event_id) AS g, event_id, value < 40 AS ok FROM events)
SELECT user_id, min(event_id) AS "start", max(event_id) AS "end", count(*) AS length FROM o WHERE ok GROUP BY user_id, g HAVING count(*) >= 4""")
def _(t):
    return E.episodes(t.events, ["user_id"], "event_id", F.col("value") < 40, min_len=4, n=None).drop("ongoing")


@query("g01_episodes_max_gap", """
WITH h AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS di FROM events GROUP BY 1, 2), j AS (SELECT *, di - row_number() OVER (PARTITION BY user_id ORDER BY di) AS g FROM h)
SELECT user_id, min(di) AS "start", max(di) AS "end", count(*) AS length FROM j GROUP BY user_id, g""")
def _(t):
    di = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    days = t.events.select("user_id", di.alias("di")).distinct()
    return E.episodes(days, ["user_id"], "di", F.lit(True), max_gap=1).drop("ongoing")


FLAGS = f"""{DAILY}, med AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM daily GROUP BY 1),
flags AS (SELECT daily.*, median, value > 1.1 * median AS flag FROM daily JOIN med USING (event_type)),
idx AS (SELECT di, count(value) AS n_series, count(*) FILTER (flag) AS n_flagged, count(*) FILTER (flag) * 1.0 / count(value) AS breadth FROM flags GROUP BY 1)"""


def flags(t):
    return long_cols(E.threshold_flags(daily(t), ["event_type"], "value", 1.1), "di")


def index(t):
    return E.breadth_index(flags(t), "di", "value")


@query("g02_threshold_flags", f"WITH {FLAGS} SELECT event_type, di, round(median, 4) AS median, flag FROM flags")
def _(t):
    return rounded(flags(t).select("event_type", "di", "median", "flag"), 4, "median")


@query("g03_breadth_index", f"WITH {FLAGS} SELECT di, n_series, n_flagged, round(breadth, 6) AS breadth FROM idx")
def _(t):
    return rounded(index(t), 6, "breadth")


EPS = FLAGS + """, ii AS (SELECT di, di - row_number() OVER (PARTITION BY breadth >= 0.4 ORDER BY di) AS g, breadth >= 0.4 AS ok FROM idx),
rr AS (SELECT min(di) AS s, max(di) AS e FROM ii WHERE ok GROUP BY g HAVING count(*) >= {before}), mm AS (SELECT *, CASE WHEN s - lag(e) OVER (ORDER BY s) <= {gap} THEN 0 ELSE 1 END AS f FROM rr),
m2 AS (SELECT *, sum(f) OVER (ORDER BY s) AS grp FROM mm), m3 AS (SELECT min(s) AS s, max(e) AS e FROM m2 GROUP BY grp),
eps AS (SELECT s AS "start", e AS "end", row_number() OVER (ORDER BY s) AS episode FROM m3 WHERE e - s >= {after})"""


def eps(t, before=1, gap=2, after=None):
    return long_cols(E.breadth_episodes(index(t), "di", "share", 0.4, before, after, gap, False), "episode", "start", "end")


@query("g04_merge_gap", f"WITH {EPS.format(before=1, gap=2, after=0)} SELECT \"start\", \"end\", episode FROM eps")
def _(t):
    return eps(t)


@query("g05_min_duration", f"WITH {EPS.format(before=2, gap=3, after=2)} SELECT \"start\", \"end\", episode FROM eps")
def _(t):
    return eps(t, before=2, gap=3, after=2)


@query("g05_calendar_preset", f"""
WITH {FLAGS}, ii AS (SELECT di, di - row_number() OVER (PARTITION BY n_flagged >= 3 ORDER BY di) AS g, n_flagged >= 3 AS ok FROM idx), rr AS (SELECT min(di) AS s, max(di) AS e FROM ii WHERE ok GROUP BY g),
m2 AS (SELECT *, sum(f) OVER (ORDER BY s) AS grp FROM (SELECT *, CASE WHEN s - lag(e) OVER (ORDER BY s) < 30 THEN 0 ELSE 1 END AS f FROM rr)), m3 AS (SELECT min(s) AS s, max(e) AS e FROM m2 GROUP BY grp)
SELECT s AS "start", e AS "end", row_number() OVER (ORDER BY s) AS episode FROM m3 WHERE e - s >= 10""")
def _(t):
    return long_cols(E.breadth_episodes(index(t), "di", **E.PRESETS["calendar"]), "episode", "start", "end")


MEMBERS = EPS.format(before=1, gap=2, after=0) + """, mem AS (SELECT episode, event_type, count(*) FILTER (flag) AS days, max(value) AS peak, avg(value) AS mean_value, max(median) AS median, max("end" - "start" + 1) AS duration
  FROM flags JOIN eps ON di BETWEEN "start" AND "end" GROUP BY 1, 2 HAVING count(*) FILTER (flag) > 0)"""


def members(t):
    return E.episode_members(flags(t), eps(t), "di", "event_type", "value")


@query("g06_episode_members", f"""
WITH {MEMBERS} SELECT episode, event_type, days, peak, round(mean_value, 6) AS mean_value, round(days * 1.0 / duration, 6) AS fraction, round(peak / median, 6) AS peak_ratio FROM mem""")
def _(t):
    return rounded(members(t).select("episode", "event_type", "days", "peak", "mean_value", "fraction", "peak_ratio"), 6, "mean_value", "fraction", "peak_ratio")


@query("g06_episode_profile", f"""
WITH {MEMBERS}, b AS (SELECT episode, max(breadth) AS pb, arg_min(di, (-breadth, di)) AS ps, avg(breadth) AS mb FROM idx JOIN eps ON di BETWEEN "start" AND "end" GROUP BY 1),
k AS (SELECT episode, count(*) AS n, avg(peak / median) AS sr FROM mem GROUP BY 1)
SELECT episode, "end" - "start" + 1 AS duration, round(pb, 6) AS peak_breadth, ps AS peak_slot, round(mb, 6) AS mean_breadth, n AS n_members, round(sr, 6) AS severity_ratio,
  round(pb * sqrt("end" - "start" + 1) * n, 6) AS severity, CASE WHEN "start" <= 6 AND "end" >= 0 THEN 'first_week' WHEN "start" <= 18 AND "end" >= 9 THEN 'middle' END AS known
FROM eps JOIN b USING (episode) JOIN k USING (episode)""")
def _(t):
    out = E.label_known(E.episode_profile(index(t), members(t), eps(t), "di"), [("first_week", 0, 6), ("middle", 9, 18)])
    return rounded(out.drop("start", "end"), 6, "peak_breadth", "mean_breadth", "severity_ratio", "severity")


@query("g07_episode_effect", f"""
WITH {EPS.format(before=1, gap=2, after=0)}, r0 AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY event_type ORDER BY di)) AS r FROM daily),
pw AS (SELECT a.di, corr(a.r, b.r) OVER w AS r, count(a.r + b.r) OVER w AS c, row_number() OVER w2 AS rn FROM r0 a JOIN r0 b ON a.di = b.di AND a.event_type < b.event_type
  WINDOW w AS (PARTITION BY a.event_type, b.event_type ORDER BY a.di ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY a.event_type, b.event_type ORDER BY a.di)),
m AS (SELECT di, avg(r) AS r FROM pw WHERE c >= 5 AND rn >= 10 GROUP BY 1),
d AS (SELECT episode, avg(r) AS during FROM eps JOIN m ON di BETWEEN "start" AND "end" GROUP BY 1), c AS (SELECT episode, avg(r) AS calm FROM eps JOIN m ON di BETWEEN greatest("start" - 8, 0) AND "start" - 1 GROUP BY 1)
SELECT episode, round(during, 5) AS during, round(calm, 5) AS calm, round(during - calm, 5) AS surge FROM eps LEFT JOIN d USING (episode) LEFT JOIN c USING (episode)""")
def _(t):
    m = mean_pair_corr(rolling_pair_corr(returns(t), "di", "event_type", "r", 10, 5), "di")
    return rounded(E.episode_effect(long_cols(m, "di"), eps(t), "di", "mean_r", 8), 5, "during", "calm", "surge")


@query("g08_network_density", f"""
WITH {EPS.format(before=1, gap=2, after=0)}, c AS (SELECT episode, a.event_type, b.event_type, corr(a.value, b.value) AS r FROM daily a JOIN daily b ON a.di = b.di AND a.event_type < b.event_type
  JOIN eps ON a.di BETWEEN "start" AND "end" GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT episode, round(avg(CASE WHEN abs(r) > 0.5 THEN 1.0 ELSE 0 END), 6) AS density, count(*) AS n_pairs FROM c GROUP BY 1""")
def _(t):
    pairs = E.within_episodes(series_pairs(long_cols(daily(t), "di"), ["di"], "event_type", "value"), eps(t), "di")
    corr = pearson(pairs, ["episode", "key_a", "key_b"], "x", "y", tests=False).filter("n >= 3")
    return rounded(E.network_density(corr, ["episode"]), 6, "density")


@query("g09_structural_trend", f"""
WITH {MEMBERS}, k AS (SELECT episode, avg(peak / median) AS sr FROM mem GROUP BY 1), r AS (SELECT episode, sr, rank() OVER (ORDER BY sr) AS rk FROM k)
SELECT count(*) AS n, CASE WHEN count(*) < 3 THEN 0 ELSE round(regr_slope(sr, episode), 6) END::DOUBLE AS slope, CASE WHEN count(*) < 3 THEN 0 ELSE round(corr(episode, rk), 6) END::DOUBLE AS rho FROM r""")
def _(t):
    prof = E.episode_profile(index(t), members(t), eps(t), "di").select("episode", F.col("severity_ratio").alias("sr"))
    rho = spearman(prof, [], "episode", "sr", n=1, tests=False).select(F.round("rho", 6)).scalar()
    return ols_trend(prof, [], "episode", "sr", tests=False).select("n", F.round("slope", 6).alias("slope")).withColumn("rho", rho)


@query("g09_metric_anomalies", f"""
WITH {DAILY}, m AS (SELECT event_type, quantile_cont(value, 0.5) AS md FROM daily GROUP BY 1)
SELECT event_type, di, CASE WHEN value > 1.2 * md THEN 'high' ELSE 'low' END AS kind FROM daily JOIN m USING (event_type) WHERE value > 1.2 * md OR value < 0.8 * md""")
def _(t):
    return long_cols(E.metric_anomalies(daily(t), ["event_type"], "value", 1.2, 0.8).select("event_type", "di", "kind"), "di")


LOW = f"""{MPRIO}, mp AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY priority) AS md FROM mprio), {islands('mp', 'priority', 'mi', 'value < md', 'value')}"""


@query("g10_run_length_stats", f"WITH {LOW} SELECT priority, count(*) AS n_runs, max(len) AS max_length, round(avg(len), 6) AS mean_length FROM runs GROUP BY 1")
def _(t):
    return rounded(E.run_length_stats(monthly_priority(t), ["priority"], "mi", "value"), 6, "mean_length")


@query("g10_runs_per_block", f"WITH {LOW} SELECT priority, CAST(floor(s / 24) * 24 AS BIGINT) AS block, count(*) AS n_runs FROM runs GROUP BY 1, 2")
def _(t):
    from seriesloom.operators.split import exact_quantiles, join_keys
    m = monthly_priority(t)
    m = join_keys(m, exact_quantiles(m, ["priority"], "value", {"md": 0.5}, n=1), ["priority"])
    return E.runs_per_block(E.episodes(m, ["priority"], "mi", F.col("value") < F.col("md")), ["priority"], "start", 24)


@query("g11_cycle_segments", f"""
WITH {MPRIO}, g(cycle, guide) AS (VALUES (1, 8), (2, 30), (3, 52), (4, 70)), v AS (SELECT priority, mi, round(value / 2e6) AS v FROM mprio),
nr AS (SELECT priority, cycle, mi, v, min(v) OVER (PARTITION BY priority, cycle) AS lo FROM v JOIN g ON abs(mi - guide) <= 6),
tie AS (SELECT *, row_number() OVER (PARTITION BY priority, cycle ORDER BY mi) - 1 AS r, count(*) OVER (PARTITION BY priority, cycle) AS c FROM nr WHERE v = lo),
mn AS (SELECT priority, cycle, mi AS min_time, v AS min_value, lead(mi) OVER (PARTITION BY priority ORDER BY cycle) AS next_min FROM tie WHERE r = c // 2)
SELECT mn.priority, cycle, min_time, min_value, next_min, arg_min(mi, (-v, mi)) AS max_time, max(v) AS max_value, sum(v) AS total, count(*) AS n,
  round(CAST(arg_min(mi, (-v, mi)) - min_time AS DOUBLE) / nullif(next_min - arg_min(mi, (-v, mi)), 0), 6) AS asymmetry
FROM mn JOIN v ON v.priority = mn.priority AND mi >= min_time AND (next_min IS NULL OR mi < next_min) GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    m = monthly_priority(t).withColumn("v", F.round(F.col("value") / 2e6))
    out = E.cycle_segments(m, ["priority"], "mi", "v", [(1, 8), (2, 30), (3, 52), (4, 70)], 6).drop("rise", "fall")
    return long_cols(rounded(out, 6, "asymmetry"), "min_time", "next_min", "max_time")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("g12_conditional_response", f"""
WITH {DAILY}, p AS (SELECT di, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error, max(value) FILTER (event_type = 'purchase') AS purchase,
  max(value) FILTER (event_type = 'signup') AS signup, max(value) FILTER (event_type = 'view') AS "view" FROM daily GROUP BY 1),
d AS (SELECT di, click - lag(click) OVER w AS click, error - lag(error) OVER w AS error, purchase - lag(purchase) OVER w AS purchase, signup - lag(signup) OVER w AS signup, "view" - lag("view") OVER w AS "view" FROM p WINDOW w AS (ORDER BY di)),
h AS (SELECT CASE WHEN di < 15 THEN 'early' ELSE 'late' END AS part, unnest(['error', 'purchase', 'signup', 'view']) AS series, unnest([error, purchase, signup, "view"]) AS change FROM d WHERE click < -50)
SELECT part, series, count(*) AS n, round(avg(change), 6) AS mean_change, count(*) FILTER (change > 0) AS n_up, round(quantile_cont(change, 0.5), 6) AS median_change FROM h WHERE change IS NOT NULL GROUP BY 1, 2""")
def _(t):
    from seriesloom.operators.windows import by_time
    wide = daily(t).groupBy("di").pivot("event_type", TYPES).agg(F.max("value"))
    d = wide.select("di", *[(F.col(c) - F.lag(c).over(by_time([], "di"))).alias(c) for c in TYPES])
    out = E.conditional_response(d, F.col("click") < -50, TYPES[1:], F.when(F.col("di") < 15, "early").otherwise("late"))
    return rounded(out, 6, "mean_change", "median_change")


STORM = windows_sql(3, 1) + """, sw AS (SELECT *, coalesce(lead(start_s) OVER (PARTITION BY event_type ORDER BY i), end_s) AS stop_s, i - row_number() OVER (PARTITION BY event_type, z >= 1 ORDER BY i) AS g FROM wz),
st AS (SELECT event_type, min(start_s) AS start_s, max(stop_s) AS stop_s, max(n) AS peak_n, max(z) AS peak_z FROM sw WHERE z >= 1 GROUP BY event_type, g)"""


@query("g13_rate_storms", f"""
WITH {STORM} SELECT st.event_type, round(start_s, 3) AS start_s, round(max(stop_s), 3) AS stop_s, max(peak_n) AS peak_n, round(max(peak_z), 6) AS peak_z, count(s) AS n_notable
FROM st LEFT JOIN ev ON ev.event_type = st.event_type AND s BETWEEN start_s AND stop_s AND value >= 120 GROUP BY st.event_type, start_s""")
def _(t):
    ev = seconds(t)
    storms = E.rate_storms(rolling_event_counts(ev, ["event_type"], "s", 3, 1), ["event_type"], 1.0)
    notable = E.storm_members(storms, ev, ["event_type"], "s", "value", 120.0).select("event_type", "start_s", "n_notable")
    out = storms.join(notable, ["event_type", "start_s"], "left").withColumn("n_notable", F.coalesce("n_notable", F.lit(0).cast("bigint")))
    return long_cols(rounded(rounded(out, 3, "start_s", "stop_s"), 6, "peak_z"), "peak_n")

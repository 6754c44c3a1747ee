"""Spectral queries."""

from pyspark.sql import functions as F

from seriesloom.operators import spectral as H
from seriesloom.operators.windows import autocorrelation
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import rounded
from seriesloom.plans.inputs import HOURLY, MPRIO, hourly, monthly_priority
from seriesloom.plans.windowing import ACF, long_cols


def mega(t):
    """Monthly value per priority in millions."""
    return monthly_priority(t).withColumn("v", F.col("value") / 1e6)


# Every step of the series, missing ones as 0 after mean removal.
DENSE = f"""{MPRIO}, sp AS (SELECT priority, min(mi) AS i0, max(mi) - min(mi) + 1 AS n, avg(value / 1e6) AS m FROM mprio GROUP BY 1),
st AS (SELECT priority, i0, n, m, unnest(range(0, n)) AS i FROM sp), dn AS (SELECT st.priority, st.n AS n, i, coalesce(value / 1e6 - m, 0) AS x FROM st LEFT JOIN mprio p ON p.priority = st.priority AND p.mi = i0 + i)"""


@query("h01_periodogram", f"""
WITH {DENSE}, d AS (SELECT priority, n, i, x, 0.5 - 0.5 * cos(2 * pi() * i / n) AS w FROM dn), k AS (SELECT unnest(range(1, 100)) AS k),
s AS (SELECT priority, k, n, sum(x * w * cos(2 * pi() * k * i / n)) AS re, sum(x * w * sin(2 * pi() * k * i / n)) AS im, sum(w * w) AS ww FROM d, k WHERE k <= n // 2 GROUP BY ALL)
SELECT priority, k AS f_idx, round(k * 12.0 / n, 8) AS freq, round(CASE WHEN 2 * k = n THEN 1 ELSE 2 END * (re * re + im * im) / (12 * ww), 5) AS power FROM s""")
def _(t):
    out = H.periodogram(mega(t), ["priority"], "mi", "v").drop("period")
    return long_cols(rounded(rounded(out, 8, "freq"), 5, "power"), "f_idx")


@query("h02_welch_psd", f"""
WITH {DENSE}, sg AS (SELECT unnest([0, 1, 2, 3]) AS seg), a AS (SELECT priority, seg, i - seg * 16 AS j, x AS v FROM dn, sg WHERE i >= seg * 16 AND i < seg * 16 + 32 AND seg * 16 + 32 <= n),
d AS (SELECT priority, seg, j, v - avg(v) OVER (PARTITION BY priority, seg) AS x, 0.5 - 0.5 * cos(2 * pi() * j / 32) AS w FROM a), k AS (SELECT unnest(range(1, 17)) AS k),
s AS (SELECT priority, seg, k, sum(x * w * cos(2 * pi() * k * j / 32)) AS re, sum(x * w * sin(2 * pi() * k * j / 32)) AS im, sum(w * w) AS ww FROM d, k GROUP BY ALL)
SELECT priority, k AS f_idx, count(*) AS n_segments, round(avg(CASE WHEN k = 16 THEN 1 ELSE 2 END * (re * re + im * im) / (12 * ww)), 5) AS power FROM s GROUP BY 1, 2""")
def _(t):
    out = H.welch_psd(mega(t), ["priority"], "mi", "v", 32).select("priority", "f_idx", "n_segments", "power")
    return long_cols(rounded(out, 5, "power"), "f_idx")


HOURS = f"""{HOURLY}, sp AS (SELECT event_type, min(hi) AS i0, max(hi) - min(hi) + 1 AS n, avg(value) AS m FROM hourly GROUP BY 1),
st AS (SELECT event_type, i0, n, m, unnest(range(0, n)) AS i FROM sp),
dn AS (SELECT st.event_type, st.n, i, coalesce(value - m, 0) AS x FROM st LEFT JOIN hourly h ON h.event_type = st.event_type AND h.hi = i0 + i)"""


def _welch_hours(nperseg: int) -> str:
    half = nperseg // 2
    return f"""
WITH {HOURS}, sg AS (SELECT unnest(range(0, 40)) AS seg), a AS (SELECT event_type, seg, i - seg * {half} AS j, x AS v FROM dn, sg
  WHERE i >= seg * {half} AND i < seg * {half} + {nperseg} AND seg * {half} + {nperseg} <= n),
d AS (SELECT event_type, seg, j, v - avg(v) OVER (PARTITION BY event_type, seg) AS x, 0.5 - 0.5 * cos(2 * pi() * j / {nperseg}) AS w FROM a),
k AS (SELECT unnest(range(1, {half + 1})) AS k),
s AS (SELECT event_type, seg, k, sum(x * w * cos(2 * pi() * k * j / {nperseg})) AS re, sum(x * w * sin(2 * pi() * k * j / {nperseg})) AS im, sum(w * w) AS ww
      FROM d, k GROUP BY ALL)
SELECT event_type, k AS f_idx, count(*) AS n_segments, round(avg(CASE WHEN k = {half} THEN 1 ELSE 2 END * (re * re + im * im) / (24 * ww)), 4) AS power
FROM s GROUP BY 1, 2"""


def _hours(t, nperseg):
    out = H.welch_psd(hourly(t), ["event_type"], "hi", "value", nperseg, 24.0).select("event_type", "f_idx", "n_segments", "power")
    return long_cols(rounded(out, 4, "power"), "f_idx")


@query("h02_welch_360", _welch_hours(360))
def _(t):
    return _hours(t, 360)


@query("h02_welch_512", _welch_hours(512))
def _(t):
    return _hours(t, 512)


@query("h03_lomb_scargle", f"""
WITH {HOURLY}, e AS (SELECT event_type, hi / 24.0::DOUBLE AS t, value - avg(value) OVER (PARTITION BY event_type) AS x FROM hourly),
g AS (SELECT k, pow(10, log10(2) + (log10(150) - log10(2)) * k / 1999) AS p FROM (SELECT unnest(range(0, 2000)) AS k)),
m AS (SELECT event_type, k, p, sum(x * cos(2 * pi() * t / p)) AS xc, sum(x * sin(2 * pi() * t / p)) AS xs, sum(pow(cos(2 * pi() * t / p), 2)) AS cc, sum(pow(sin(2 * pi() * t / p), 2)) AS ss,
  sum(cos(2 * pi() * t / p) * sin(2 * pi() * t / p)) AS cs, sum(x * x) AS xx FROM e, g GROUP BY 1, 2, 3), q AS (SELECT *, atan2(2 * cs, cc - ss) / 2 AS a FROM m)
SELECT event_type, k AS f_idx, round((pow(xc * cos(a) + xs * sin(a), 2) / (pow(cos(a), 2) * cc + 2 * cos(a) * sin(a) * cs + pow(sin(a), 2) * ss)
  + pow(xs * cos(a) - xc * sin(a), 2) / (pow(cos(a), 2) * ss - 2 * cos(a) * sin(a) * cs + pow(sin(a), 2) * cc)) / xx, 6) AS power FROM q""")
def _(t):
    e = hourly(t).select("event_type", "value", (F.col("hi") / 24).alias("t"))
    out = H.lomb_scargle(e, ["event_type"], "t", "value", H.period_grid(2, 150, 2000)).select("event_type", F.col("f_idx").cast("bigint").alias("f_idx"), "power")
    return rounded(out, 6, "power")


@query("h03_user_spectra", """
WITH e AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS t, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events),
g AS (SELECT k, pow(10, log10(0.5) + (log10(30) - log10(0.5)) * k / 399) AS p FROM (SELECT unnest(range(0, 400)) AS k)),
m AS (SELECT user_id, k, p, sum(x * cos(2 * pi() * t / p)) AS xc, sum(x * sin(2 * pi() * t / p)) AS xs, sum(pow(cos(2 * pi() * t / p), 2)) AS cc, sum(pow(sin(2 * pi() * t / p), 2)) AS ss,
  sum(cos(2 * pi() * t / p) * sin(2 * pi() * t / p)) AS cs, sum(x * x) AS xx FROM e, g GROUP BY 1, 2, 3), q AS (SELECT *, atan2(2 * cs, cc - ss) / 2 AS a FROM m)
SELECT user_id, k AS f_idx, round(p, 8) AS period, round((pow(xc * cos(a) + xs * sin(a), 2) / (pow(cos(a), 2) * cc + 2 * cos(a) * sin(a) * cs + pow(sin(a), 2) * ss)
  + pow(xs * cos(a) - xc * sin(a), 2) / (pow(cos(a), 2) * ss - 2 * cos(a) * sin(a) * cs + pow(sin(a), 2) * cc)) / xx, 6) AS power FROM q""")
def _(t):
    """The raw, uneven events of every user."""
    e = t.events.select("user_id", "value", ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 86400e6).alias("t"))
    out = H.lomb_scargle(e, ["user_id"], "t", "value", H.period_grid(0.5, 30, 400))
    return rounded(rounded(long_cols(out, "f_idx"), 6, "power"), 8, "period")


def _spaced_apart(distance: int) -> str:
    """Of `tops` (priority, i, v) those that no higher one has already kept away."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY v DESC, i DESC) AS r FROM tops),
g(priority, r, kept) AS (SELECT DISTINCT priority, 0::BIGINT, []::BIGINT[] FROM o UNION ALL
  SELECT o.priority, o.r, CASE WHEN len(list_filter(kept, lambda s: abs(s - o.i) < {distance})) = 0 THEN list_append(kept, o.i) ELSE kept END
  FROM g JOIN o ON o.priority = g.priority AND o.r = g.r + 1),
apart AS (SELECT priority, unnest(arg_max(kept, r)) AS i FROM g GROUP BY 1)"""


@query("h04_spectral_peaks", f"""
WITH RECURSIVE {DENSE}, d AS (SELECT priority, n, i, x, 0.5 - 0.5 * cos(2 * pi() * i / n) AS w FROM dn), k AS (SELECT unnest(range(1, 100)) AS k),
s AS (SELECT priority, k, n, sum(x * w * cos(2 * pi() * k * i / n)) AS re, sum(x * w * sin(2 * pi() * k * i / n)) AS im, sum(w * w) AS ww FROM d, k WHERE k <= n // 2 GROUP BY ALL),
f AS (SELECT priority, k AS i, n / (12.0 * k) AS period, CASE WHEN 2 * k = n THEN 1 ELSE 2 END * (re * re + im * im) / (12 * ww) AS v FROM s),
tops AS (SELECT * FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM f WINDOW w AS (PARTITION BY priority ORDER BY i)) WHERE v > a AND v > b),
{_spaced_apart(5)},
near AS (SELECT t.priority, t.i, coalesce(max(j.i) FILTER (j.i < t.i AND j.v > t.v), 0) AS l, coalesce(min(j.i) FILTER (j.i > t.i AND j.v > t.v), 1000) AS r
  FROM tops t JOIN f j ON j.priority = t.priority GROUP BY 1, 2),
lows AS (SELECT b.priority, b.i, min(j.v) FILTER (j.i > b.l AND j.i <= b.i) AS lo, min(j.v) FILTER (j.i >= b.i AND j.i < b.r) AS hi FROM near b JOIN f j ON j.priority = b.priority GROUP BY 1, 2),
m AS (SELECT priority, max(v) AS m FROM f GROUP BY 1),
p AS (SELECT priority, i, period, v, v - greatest(lo, hi) AS prominence FROM tops JOIN apart USING (priority, i) JOIN lows USING (priority, i) JOIN m USING (priority) WHERE v - greatest(lo, hi) >= 0.1 * m),
q AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY prominence DESC, i) AS rank FROM p)
SELECT priority, rank, round(period::DOUBLE, 6) AS period, round(v, 6) AS power, round(prominence, 6) AS prominence FROM q WHERE rank <= 10""")
def _(t):
    spec = H.periodogram(mega(t), ["priority"], "mi", "v")
    return rounded(H.spectral_peaks(spec, ["priority"], "f_idx"), 6, "period", "power", "prominence")


@query("h04_acf_peaks", f"""
WITH RECURSIVE {ACF.replace("range(0, 37)", "range(0, 61)")}, f AS (SELECT priority, lag, acf AS v, row_number() OVER (PARTITION BY priority ORDER BY lag) AS i FROM acf),
tops AS (SELECT * FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM f WINDOW w AS (PARTITION BY priority ORDER BY i)) WHERE v > a AND v > b AND v >= 0.05),
{_spaced_apart(6)}
SELECT priority, lag, round(v, 6) AS acf FROM tops JOIN apart USING (priority, i)""")
def _(t):
    acf = autocorrelation(monthly_priority(t), ["priority"], "mi", "value", 60)
    return rounded(H.acf_peaks(acf, ["priority"], 6, 0.05), 6, "acf")


SCALES = range(6, 121)
MORLET = f"""{MPRIO}, x AS (SELECT priority, mi, value / 1e6 - avg(value / 1e6) OVER (PARTITION BY priority) AS x FROM mprio), sc AS (SELECT unnest(range(6, 121))::DOUBLE AS s),
cw AS (SELECT a.priority, s, a.mi, 2 * pi() * s / 6.0 / 12.0 AS period, pow(sum(b.x * pow(pi(), -0.25) * cos(6.0 * (b.mi - a.mi) / s) * exp(-pow((b.mi - a.mi) / s, 2) / 2)) / sqrt(s), 2)
  + pow(sum(b.x * pow(pi(), -0.25) * sin(6.0 * (b.mi - a.mi) / s) * exp(-pow((b.mi - a.mi) / s, 2) / 2)) / sqrt(s), 2) AS power
  FROM x a, sc, x b WHERE a.priority = b.priority AND abs(b.mi - a.mi) <= floor(3 * s) GROUP BY a.priority, s, a.mi)"""


def wave(t):
    return H.morlet_power(mega(t), ["priority"], "mi", "v", SCALES)


@query("h05_morlet_power", f"WITH {MORLET} SELECT priority, s AS scale, mi AS step, round(period, 6) AS period, round(power, 5) AS power FROM cw")
def _(t):
    return rounded(rounded(wave(t), 5, "power"), 6, "period")


@query("h06_dominant_period", f"""
WITH {MORLET}, b AS (SELECT priority, mi AS step, arg_max(period, power) AS d, max(power) AS p FROM cw WHERE period BETWEEN 2 AND 7 GROUP BY 1, 2)
SELECT priority, step, round(d, 6) AS dominant, round(p, 5) AS peak_power, round(CASE WHEN count(*) OVER w = 12 THEN avg(d) OVER w END, 6) AS smoothed FROM b
WINDOW w AS (PARTITION BY priority ORDER BY step ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def _(t):
    return rounded(rounded(H.dominant_period(wave(t), ["priority"], 2, 7, 12), 6, "dominant", "smoothed"), 5, "peak_power")


@query("h07_band_power", f"""
WITH {MORLET}, b AS (SELECT priority, mi, avg(power) AS p FROM cw WHERE period BETWEEN 2 AND 7 GROUP BY 1, 2)
SELECT priority, CAST(mi // 24 AS BIGINT) AS epoch, round(avg(p), 5) AS mean_power, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) > 12""")
def _(t):
    band = H.band_power(wave(t), ["priority"], 2, 7)
    return rounded(H.epoch_power(band, ["priority"], F.floor(F.col("step") / 24)), 5, "mean_power")


@query("h07_envelope", f"""
WITH {MORLET} SELECT priority, mi AS step, round(avg(power), 5) AS band_power, round(sqrt(avg(power)), 5) AS envelope FROM cw WHERE period BETWEEN 2 AND 7 GROUP BY 1, 2""")
def _(t):
    return rounded(H.band_power(wave(t), ["priority"], 2, 7), 5, "band_power", "envelope")

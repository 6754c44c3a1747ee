"""Ordered-series operators.

Unless stated otherwise a series has one row per key and calendar step, so plain windows are bounded by the calendar.
Raw event rows go through `operators.split`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.aggregates import ratio
from seriesloom.operators.joins import series_pairs
from seriesloom.operators.split import exact_quantiles, join_keys, neighbours, with_group_stats


def by_time(keys: Sequence[str], time: str):
    """W(k, t); without keys the series is a single bounded one."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(time)


def delta(df: DataFrame, keys: Sequence[str], time: str, value: str, tie: str, max_gap_seconds: float | None = None,
          name: str = "delta") -> DataFrame:
    """Change against the previous raw row of the key; NULL over a gap longer than `max_gap_seconds`."""
    out = neighbours(df, keys, time, tie, before={value: "__pv", time: "__pt"})
    change = F.col(value) - F.col("__pv")
    if max_gap_seconds is not None:
        gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__pt").cast("timestamp"))) / 1e6
        change = F.when(gap <= max_gap_seconds, change)
    return out.withColumn(name, change).drop("__pv", "__pt")


def log_return(df: DataFrame, keys: Sequence[str], time: str, value: str, otherwise: float | None = None,
               name: str = "log_return") -> DataFrame:
    """ln(x / previous x) where both are positive, else NULL or `otherwise`."""
    prev = F.lag(value).over(by_time(keys, time))
    both = (F.col(value) > 0) & (prev > 0)
    return df.withColumn(name, F.when(both, F.log(F.when(both, F.col(value) / prev))).otherwise(
        F.when(prev.isNotNull(), F.lit(otherwise)) if otherwise is not None else F.lit(None)))


def forward_fill(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    w = by_time(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def rolling_std(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int = 30, min_obs: int = 20,
                scale: float = math.sqrt(252), name: str = "rolling_std") -> DataFrame:
    """Sample standard deviation of the last n rows times `scale`, only after n rows and with `min_obs` values."""
    w = by_time(keys, time)
    frame = w.rowsBetween(-(n - 1), 0)
    ready = (F.row_number().over(w) > n) & (F.count(value).over(frame) >= min_obs)
    return df.withColumn(name, F.when(ready, F.stddev_samp(value).over(frame) * scale))


def ewma_variance(df: DataFrame, keys: Sequence[str], time: str, value: str, decay: float = 0.94, window: int = 30,
                  seed: str = "sample_variance", min_obs: int = 15, name: str = "ewma_var") -> DataFrame:
    """v_t = decay * v_(t-1) + (1 - decay) * r_t^2, carried over NULLs.

    seed: `sample_variance` of the first `window` rows from the first value, placed on the last of them, or
    `mean_square` of rows 2 .. window + 1, placed on the first row. The recursion is unrolled: within blocks of
    valid rows the sum is a running sum of rescaled squares, and two blocks back weigh less than 1e-24, so every
    value is a window sum plus the totals of the two blocks before.
    """
    w = by_time(keys, time)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    block = max(int(27 / -math.log(decay)), 1)
    r = F.col(value).cast("double")
    s = df.withColumn("__rn", F.row_number().over(w))
    first = F.min(F.when(r.isNotNull(), F.col("__rn"))).over(whole)
    if seed == "sample_variance":
        lead_in = F.col("__rn").between(F.col("__first"), F.col("__first") + window - 1)
        s = s.withColumns({"__first": first, "__size": F.max("__rn").over(whole)})
        used = F.when(lead_in, r)
        s = s.withColumns({"__v0": F.when(F.count(used).over(whole) >= min_obs, F.var_samp(used).over(whole)),
                           "__at": F.least(F.col("__first") + window - 1, F.col("__size"))})
    else:
        used = F.when(F.col("__rn").between(2, window + 1), r)
        s = s.withColumns({"__v0": F.avg(used * used).over(whole), "__at": F.lit(1)})
    live = F.col("__rn") > F.col("__at")
    sq = F.coalesce(F.when(live, r * r), F.lit(0.0))
    s = s.withColumn("__i", F.count(F.when(live, r)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumns({"__b": F.floor(F.greatest(F.col("__i") - 1, F.lit(0)) / block),
                       "__p": F.greatest(F.col("__i") - 1, F.lit(0)) % block})
    lam = F.lit(decay)
    inside = (Window.partitionBy(*keys, "__b")).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__in", F.sum(F.when(live & r.isNotNull(), sq * F.pow(lam, -F.col("__p").cast("double"))).otherwise(0.0)).over(inside)
                     * F.pow(lam, F.col("__p").cast("double")))
    totals = s.groupBy(*keys, "__b").agg(F.max_by("__in", F.col("__rn")).alias("__t"))
    bw = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__b")
    totals = totals.select(*keys, "__b", (F.coalesce(F.lag("__t", 1).over(bw), F.lit(0.0))
                                          + F.pow(lam, F.lit(float(block))) * F.coalesce(F.lag("__t", 2).over(bw), F.lit(0.0))).alias("__carry"))
    s = join_keys(s, totals, [*keys, "__b"])
    var = (F.pow(lam, F.col("__i").cast("double")) * F.col("__v0")
           + (1 - decay) * (F.col("__in") + F.pow(lam, (F.col("__p") + 1).cast("double")) * F.col("__carry")))
    return s.withColumn(name, F.when(F.col("__rn") >= F.col("__at"), var)).select(*df.columns, name)


def rolling_mean_min(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int, name: str) -> DataFrame:
    """Smallest n-row running mean per key (partial windows left out)."""
    w = by_time(keys, time)
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(value).over(frame) == n
    return (df.withColumn("__m", F.when(full, F.avg(value).over(frame))).groupBy(*keys).agg(F.min("__m").alias(name)))


def rolling_stat(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int, stat: str = "std") -> DataFrame:
    """std (sample) or mean over n rows, labelled with the middle time of each full window."""
    w = by_time(keys, time)
    frame = w.rowsBetween(-(n - 1), 0)
    agg = F.stddev_samp(value) if stat == "std" else F.avg(value)
    full = F.count(value).over(frame) == n
    return (df.select(*keys, F.nth_value(time, n // 2 + 1).over(frame).alias("center"), agg.over(frame).alias(f"rolling_{stat}"), full.alias("__f"))
            .filter("__f").drop("__f"))


def rolling_ols(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int) -> DataFrame:
    """Slope and R2 over every full window of n rows."""
    frame = by_time(keys, time).rowsBetween(-(n - 1), 0)
    x, y = F.col(time).cast("double"), F.col(value).cast("double")
    cols = {"count": F.count(value), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y), "syy": F.sum(y * y)}
    m = df.select(*keys, time, F.min(time).over(frame).alias("start"), *[c.over(frame).alias(f"__{k}") for k, c in cols.items()])
    m = m.filter(F.col("__count") == n)
    sxx = F.col("__sxx") - F.col("__sx") * F.col("__sx") / n
    syy = F.col("__syy") - F.col("__sy") * F.col("__sy") / n
    sxy = F.col("__sxy") - F.col("__sx") * F.col("__sy") / n
    r2 = F.least(F.coalesce(ratio(sxy * sxy, sxx * syy), F.lit(0.0)), F.lit(1.0))
    t = F.signum(sxy) * F.sqrt(r2 * (n - 2) / ((1 - r2) + 1e-20))
    return m.select(*keys, "start", F.col(time).alias("end"), ratio(sxy, sxx).alias("slope"), r2.alias("r2"), t.alias("t"))


def rolling_event_counts(df: DataFrame, keys: Sequence[str], seconds: str, width_days: float, step_days: float) -> DataFrame:
    """Counts in windows of `width_days` every `step_days` from the first event of the key, and z over its windows.

    Each event is counted into the few windows that hold it; windows without events are added as zeros.
    """
    width, step = width_days * 86400.0, step_days * 86400.0
    span = df.groupBy(*keys).agg(F.min(seconds).alias("t0"), F.max(seconds).alias("t1"))
    last = F.floor((F.col("t1") - F.col("t0") - width) / step)
    span = span.withColumn("last", last.cast("int")).filter("last >= 0")
    rows = join_keys(df.select(*keys, seconds), span, list(keys)) if keys else \
        df.select(seconds).withColumn("__s", span.agg(F.first(F.struct("*"))).scalar()).select(seconds, "__s.*")
    age = F.col(seconds) - F.col("t0")
    lo = F.greatest(F.lit(0), (F.floor((age - width) / step) + 1).cast("int"))
    hi = F.least(F.col("last"), F.floor(age / step).cast("int"))
    hits = rows.filter(lo <= hi).select(*keys, F.explode(F.sequence(lo, hi)).alias("window")).groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(*keys, "t0", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("window"))
    full = join_keys(grid, hits, [*keys, "window"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    z = ratio(F.col("n") - F.avg("n").over(w), F.stddev_pop("n").over(w))
    return full.select(*keys, "window", (F.col("t0") + F.col("window") * step).alias("start_s"),
                       (F.col("t0") + F.col("window") * step + width).alias("end_s"), "n", z.alias("z"))


def centered_variance(df: DataFrame, keys: Sequence[str], time: str, value: str, half: int, threshold: float) -> DataFrame:
    """Population variance and mean size above a threshold over rows -half .. half - 1; full windows only."""
    frame = by_time(keys, time).rowsBetween(-half, half - 1)
    size = F.abs(value)
    big = F.when(size > threshold, size)
    full = F.count(F.lit(1)).over(frame) == 2 * half
    return (df.select(*keys, time, F.var_pop(value).over(frame).alias("running_var"),
                      F.coalesce(F.avg(big).over(frame), F.lit(0.0)).alias("running_amp"), full.alias("__f")).filter("__f").drop("__f"))


def rolling_pair_corr(df: DataFrame, slot: str, key: str, value: str, n: int, min_obs: int, fill_zero: bool = False) -> DataFrame:
    """Correlation of every series pair over the last n slots; pairs with fewer common values stay out.

    Moments are windowed sums, since windowed corr fails on zero variance. `fill_zero` treats missing values as 0.
    """
    pairs = series_pairs(df, [slot], key, value)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ok = x.isNotNull() & y.isNotNull()
    if fill_zero:
        x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        use = F.lit(True)
    else:
        use = ok
    frame = Window.partitionBy("key_a", "key_b").orderBy(slot).rowsBetween(-(n - 1), 0)

    def s(c: Column) -> Column:
        return F.sum(F.when(use, c)).over(frame)

    m = pairs.select(slot, "key_a", "key_b", F.count(F.when(ok, 1)).over(frame).alias("c"), F.count(F.when(use, 1)).over(frame).alias("m"),
                     s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"),
                     F.row_number().over(Window.partitionBy("key_a", "key_b").orderBy(slot)).alias("rn"))
    c = F.col("m")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / c, F.col("syy") - F.col("sy") * F.col("sy") / c
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / c
    r = F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.when((vx > 1e-12) & (vy > 1e-12), vx * vy)))
    return m.filter((F.col("c") >= min_obs) & (F.col("rn") >= n)).select(slot, "key_a", "key_b", r.alias("r"))


def mean_pair_corr(rolling: DataFrame, slot: str, group_of: Column | None = None) -> DataFrame:
    """Mean correlation per slot, overall and by pair group (for example within and across regions)."""
    by = [slot] + ([group_of.alias("pair_group")] if group_of is not None else [])
    return rolling.groupBy(*by).agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_pairs"))


def autocorrelation(df: DataFrame, keys: Sequence[str], step: str, value: str, max_lag: int) -> DataFrame:
    """Biased autocorrelation r(lag), r(0) = 1, missing = 0 after mean removal; `step` is an integer position.

    Each row meets itself `lag` steps later through an equi-join on (key, step): n x max_lag rows, no pairs beyond.
    """
    rows = with_group_stats(df.select(*keys, step, value), keys, __m=F.avg(value))
    x = rows.select(*keys, F.col(step).alias("__t"), F.coalesce(F.col(value) - F.col("__m"), F.lit(0.0)).alias("x"))
    power = x.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("p"))
    later = x.select(*keys, F.col("__t").alias("__u"), F.col("x").alias("y"))
    lagged = x.select(*keys, "x", F.col("__t"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).withColumn("__u", F.col("__t") + F.col("lag"))
    prod = join_keys(lagged, later, [*keys, "__u"]).groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    out = join_keys(prod, power, list(keys)) if keys else prod.withColumn("p", power.scalar())
    return out.select(*keys, "lag", ratio(F.col("s"), F.col("p")).alias("acf"))


def decorrelation(acf: DataFrame, keys: Sequence[str], max_lag: int) -> DataFrame:
    """Last lag before the first sign change of the autocorrelation, `max_lag` without one."""
    nxt = F.lead("acf").over(by_time(keys, "lag"))
    flip = acf.withColumn("__f", F.signum("acf") != F.signum(nxt))
    return flip.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__f"), F.col("lag"))), F.lit(max_lag)).alias("decorrelation"))


def year_over_year(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Difference and percent against the previous year; NULL when that year is missing."""
    w = by_time(keys, year)
    prev = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w))
    return df.select(*keys, year, value, (F.col(value) - prev).alias("change"), (100 * ratio(F.col(value) - prev, prev)).alias("change_pct"))


def first_last_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int) -> DataFrame:
    """Means of the first and the last n rows and their difference."""
    up, down = by_time(keys, time), (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(time))
    r = df.withColumns({"__a": F.row_number().over(up), "__z": F.row_number().over(down)})
    m = r.groupBy(*keys).agg(F.avg(F.when(F.col("__a") <= n, F.col(value))).alias("first_mean"),
                             F.avg(F.when(F.col("__z") <= n, F.col(value))).alias("last_mean"))
    return m.withColumn("change", F.col("last_mean") - F.col("first_mean"))


def z_anomaly(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 2.0, min_n: int = 10) -> DataFrame:
    """Rows at least `threshold` population standard deviations from the key mean."""
    s = with_group_stats(df, keys, __m=F.avg(value), __s=F.stddev_pop(value), __n=F.count(value))
    z = ratio(F.col(value) - F.col("__m"), F.col("__s"))
    return (s.filter(F.col("__n") >= min_n).withColumn("z", z).filter(F.abs("z") >= threshold).drop("__m", "__s", "__n"))


def local_z(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str = "local_z") -> DataFrame:
    """Running 3-row mean against the key mean in sample standard deviations."""
    frame = by_time(keys, time).rowsBetween(-1, 1)
    s = with_group_stats(df, keys, __m=F.avg(value), __s=F.stddev_samp(value))
    local = F.avg(value).over(frame)
    return s.withColumn(name, ratio(local - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def compound_return(spans: DataFrame, returns: DataFrame, keys: Sequence[str], span_id: str, start: str, end: str,
                    month: str, value: str) -> DataFrame:
    """prod(1 + r) - 1 over the months [start, end] (integers); only `end` when start is NULL; missing months count 0."""
    months = spans.select(*keys, span_id, F.explode(F.sequence(F.coalesce(start, end), F.col(end))).alias(month))
    hit = join_keys(months, returns.select(*keys, month, value), [*keys, month], "left")
    return hit.groupBy(*keys, span_id).agg((F.exp(F.sum(F.coalesce(F.log1p(value), F.lit(0.0)))) - 1).alias("compound"))


def forward_return(df: DataFrame, keys: Sequence[str], time: str, value: str, horizons: Sequence[int]) -> DataFrame:
    """prod(1 + r) - 1 over the next h rows from the current one; NULL when fewer remain."""
    w = by_time(keys, time)
    out = {}
    for h in horizons:
        frame = w.rowsBetween(0, h - 1)
        out[f"fwd_{h}"] = F.when(F.count(value).over(frame) == h, F.exp(F.sum(F.log1p(value)).over(frame)) - 1)
    return df.withColumns(out)


def variability(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """CV, p90/p10 (at most 999), IQR/median and flashiness sum|change|/sum(x)."""
    step = F.abs(F.col(value) - F.lag(value).over(by_time(keys, time)))
    m = df.withColumn("__d", step).groupBy(*keys).agg(
        F.count(value).alias("n"), ratio(F.stddev_pop(value), F.avg(value)).alias("cv"), ratio(F.sum("__d"), F.sum(value)).alias("flashiness"))
    q = exact_quantiles(df, keys, value, {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    both = join_keys(m, q, list(keys))
    return both.select(*keys, "n", "cv", F.coalesce(F.least(ratio(F.col("p90"), F.col("p10")), F.lit(999.0)), F.lit(999.0)).alias("p90_p10"),
                       ratio(F.col("p75") - F.col("p25"), F.col("p50")).alias("iqr_median"), "flashiness")


def seasonal_contrast(seasons: DataFrame, keys: Sequence[str], year: str, season: str, value: str, north: Column) -> DataFrame:
    """Summer minus winter mean per key and year; the seasons swap in the southern hemisphere."""
    summer = F.when(north, "JJA").otherwise("DJF")
    winter = F.when(north, "DJF").otherwise("JJA")
    m = seasons.groupBy(*keys, year).agg(F.max(F.when(F.col(season) == summer, F.col(value))).alias("summer"),
                                         F.max(F.when(F.col(season) == winter, F.col(value))).alias("winter"))
    return m.filter(F.col("summer").isNotNull() & F.col("winter").isNotNull()).withColumn("contrast", F.col("summer") - F.col("winter"))


def season_extremes(trends: DataFrame, keys: Sequence[str], season: str, slope: str) -> DataFrame:
    """Fastest and slowest season and their ratio (99 when the slowest trend is 0)."""
    return trends.groupBy(*keys).agg(
        F.min_by(season, F.struct(-F.col(slope), F.col(season))).alias("fastest"), F.min_by(season, F.struct(F.col(slope), F.col(season))).alias("slowest"),
        F.max(slope).alias("__a"), F.min(slope).alias("__b")).withColumn(
        "asymmetry", F.coalesce(ratio(F.col("__a"), F.col("__b")), F.lit(99.0))).drop("__a", "__b")


def first_breach(flags: DataFrame, onsets: DataFrame, key: str, row: str, flag: str, onset_id: str, onset: str,
                 reach: int = 30, min_series: int = 3) -> DataFrame:
    """First flagged row of each series within `reach` rows of every onset, and its lead over the upper median breach.

    Flagged rows meet onsets on a row bucket of the reach, so only nearby rows are compared.
    """
    size = 2 * reach + 1
    lo, hi = F.floor((F.col(onset) - reach) / size), F.floor((F.col(onset) + reach) / size)
    o = onsets.select(onset_id, onset, F.explode(F.sequence(lo, hi)).alias("__b"))
    f = flags.filter(F.col(flag)).select(key, row, F.floor(F.col(row) / size).alias("__b"))
    hits = f.join(o, "__b").filter(F.abs(F.col(row) - F.col(onset)) <= reach)
    first = hits.groupBy(onset_id, key).agg(F.min(row).alias("breach"))
    w = Window.partitionBy(onset_id)
    ranked = first.withColumns({"__r": F.row_number().over(w.orderBy("breach", key)) - 1, "n_breached": F.count(F.lit(1)).over(w)})
    middle = F.max(F.when(F.col("__r") == F.floor(F.col("n_breached") / 2), F.col("breach"))).over(w)
    return (ranked.withColumn("lead", middle - F.col("breach")).filter(F.col("n_breached") >= min_series)
            .withColumn("position", F.col("__r") + 1).drop("__r"))


def lead_ranking(breaches: DataFrame, key: str, onset_id: str) -> DataFrame:
    """Mean, median and spread of leads per series, how often it was first and among the first three."""
    m = breaches.groupBy(key).agg(F.count(F.lit(1)).alias("n_onsets"), F.avg("lead").alias("mean_lead"), F.stddev_pop("lead").alias("spread"),
                                  F.count_if(F.col("position") == 1).alias("times_first"), F.count_if(F.col("position") <= 3).alias("times_top3"))
    return join_keys(m, exact_quantiles(breaches, [key], "lead", {"median_lead": 0.5}), [key])

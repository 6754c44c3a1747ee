"""Group aggregations over keyed observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import half_hour_slot, season, season_year
from seriesloom.operators.split import exact_quantiles, join_keys, neighbours, value_positions


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def period_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, unit: str, at_least: int = 1,
                digits: int = 4) -> DataFrame:
    """Mean per key and calendar period (`month`, `quarter`, `year`, `day`), only where `at_least` values exist."""
    start = F.date_trunc(unit, F.col(time)).cast("date")
    return (df.groupBy(*keys, start.alias("period")).agg(F.count(value).alias("n"),
                                                         F.round(F.avg(value), digits).alias("mean_value"))
            .filter(F.col("n") >= at_least))


def season_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, december_to_next: bool = True,
                at_least: int = 1) -> DataFrame:
    return (df.groupBy(*keys, season_year(F.col(time), december_to_next).alias("season_year"),
                       season(F.col(time)).alias("season"))
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean_value")).filter(F.col("n") >= at_least))


def describe(df: DataFrame, keys: Sequence[str], value: str, population: bool = False) -> DataFrame:
    """n, mean, std, min, max, exact p5 .. p95, IQR and CV per key.

    Moments come from one partial aggregate; quantiles from value counts, so no key buffers its values.
    """
    std = F.stddev_pop(value) if population else F.stddev_samp(value)
    moments = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), std.alias("std"),
                                    F.min(value).alias("min"), F.max(value).alias("max"))
    quantiles = exact_quantiles(df, keys, value, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return join_keys(moments, quantiles, keys, "left").withColumns({
        "iqr": F.col("p75") - F.col("p25"), "cv": ratio(F.col("std"), F.col("mean"))})


def exceedance_count(df: DataFrame, keys: Sequence[str], period: str, value: str, threshold: float | None = None,
                     percentile: float | None = None, baseline: Column | None = None, above: bool = True,
                     min_baseline: int = 1, min_valid: int = 1) -> DataFrame:
    """Rows beyond a threshold per key and period: a fixed one, or a percentile of each key's baseline rows."""
    if threshold is not None:
        rows = df.withColumn("threshold", F.lit(float(threshold)))
    else:
        base = df.filter(baseline) if baseline is not None else df
        enough = (base.groupBy(*keys).agg(F.count(value).alias("__n")).filter(F.col("__n") >= min_baseline).drop("__n"))
        cut = exact_quantiles(base, keys, value, {"threshold": percentile})
        rows = join_keys(df, cut.join(enough, list(keys), "left_semi"), keys)
    beyond = F.col(value) > F.col("threshold") if above else F.col(value) < F.col("threshold")
    return (rows.groupBy(*keys, period).agg(F.count(value).alias("n_valid"), F.count_if(beyond).alias("n_beyond"),
                                            F.max("threshold").alias("threshold"))
            .filter(F.col("n_valid") >= min_valid))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: Column, weight: Column) -> DataFrame:
    used = value.isNotNull() & weight.isNotNull()
    return df.groupBy(*keys).agg(
        ratio(F.sum(F.when(used, value * weight)), F.sum(F.when(used, weight))).alias("weighted_mean"),
        F.count_if(used).alias("n"))


def share_of_total(df: DataFrame, period: Sequence[str], category: str, value: str) -> DataFrame:
    """Share of each category within its period, in percent. Categories per period are few after the sum."""
    sums = df.groupBy(*period, category).agg(F.sum(value).alias("total"))
    whole = F.sum("total").over(Window.partitionBy(*period))
    return sums.withColumn("share_pct", 100.0 * ratio(F.col("total"), whole))


def climatology_anomaly(df: DataFrame, keys: Sequence[str], month: str, value: str, base: Column) -> DataFrame:
    """Value minus the mean of the same calendar month over the base rows; NULL where the base has none."""
    norm = df.filter(base).groupBy(*keys, month).agg(F.avg(value).alias("normal"))
    return join_keys(df, norm, [*keys, month], "left").withColumn("anomaly", F.col(value) - F.col("normal"))


def diurnal_profile(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Mean per key and half-hour slot (0-47)."""
    return (df.groupBy(*keys, half_hour_slot(F.col(time)).alias("slot"))
            .agg(F.avg(value).alias("mean_value"), F.count(value).alias("n")))


def profile_extremes(profile: DataFrame, keys: Sequence[str], value: str = "mean_value") -> DataFrame:
    """Lowest and highest slot of each profile (the earlier slot on ties) and the range."""
    low, high = F.struct(F.col(value), F.col("slot")), F.struct(-F.col(value), F.col("slot"))
    return profile.groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.min_by("slot", low).alias("low_slot"),
        F.min_by("slot", high).alias("high_slot"), (F.max(value) - F.min(value)).alias("value_range"))


def profile_features(profile: DataFrame, keys: Sequence[str], slices: dict[str, tuple[int, int]],
                     value: str = "mean_value", slot: str = "slot") -> DataFrame:
    """Means of slot slices [lo, hi), steepest step between slots, and ratios against the first two slices.

    A profile has at most 48 slots per key, so its window is bounded.
    """
    w = Window.partitionBy(*keys).orderBy(slot)
    step = profile.withColumn("step", F.col(value) - F.lag(value).over(w))
    means = {n: F.avg(F.when((F.col(slot) >= lo) & (F.col(slot) < hi), F.col(value))) for n, (lo, hi) in slices.items()}
    out = step.groupBy(*keys).agg(F.max("step").alias("max_ramp"), *[c.alias(n) for n, c in means.items()])
    first, second = list(slices)[:2]
    return out.withColumns({"belly_peak_ratio": ratio(F.col(first), F.col(second)),
                            "dip_depth": F.col(second) - F.col(first)})


def bin_stats(df: DataFrame, x: str, y: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of y over bins of x with the given width; `center` is the middle of the bin."""
    binned = df.filter(F.col(x).isNotNull()).withColumn("bin", F.floor(F.col(x) / width))
    by = [*keys, "bin"]
    moments = binned.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
    q = exact_quantiles(binned, by, y, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return join_keys(moments, q, by, "left").withColumn("center", F.col("bin") * width + width / 2)


def histogram(df: DataFrame, keys: Sequence[str], value: str, scale: int = 10) -> DataFrame:
    """Bins of width 1/scale with count, count at or above the bin, and its log10. Bins per key are few."""
    bins = (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, F.floor(F.col(value) * scale).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    down = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("bin"))
    at_least = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
    return bins.select(*keys, "bin", "n", at_least.alias("n_at_least"), F.log10(at_least).alias("log_n"))


def histogram_2d(df: DataFrame, keys: Sequence[str], x: str, y: str, x_edges: tuple[float, float, int],
                 y_edges: tuple[float, float, int]) -> DataFrame:
    """Counts on log10 x log10 bins; edges are (low, high, bins) in log10 units and outside rows are dropped."""
    def slot(c: str, e: tuple[float, float, int]) -> Column:
        return F.width_bucket(F.log10(c), F.lit(float(e[0])), F.lit(float(e[1])), F.lit(e[2]))

    inside = (df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, slot(x, x_edges).alias("xb"), slot(y, y_edges).alias("yb"))
              .filter(F.col("xb").between(1, x_edges[2]) & F.col("yb").between(1, y_edges[2])))
    return inside.groupBy(*keys, "xb", "yb").agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence, rest: str | None = None) -> DataFrame:
    """Counts of every row value for each fixed column level; empty cells are 0. Long form (row, level, n).

    `rest` names one more level for all rows of other levels and of none, so that the cells sum to the table.
    """
    levels = [str(v) for v in levels]
    named = F.col(column).cast("string")
    if rest is not None:
        named, levels = F.when(named.isin(levels), named).otherwise(rest), [*levels, rest]
    wide = df.select(row, named.alias("__level")).groupBy(row).pivot("__level", levels).agg(F.count(F.lit(1)))
    return wide.fillna(0, levels).unpivot(row, levels, "level", "n")


def shannon_entropy(df: DataFrame, keys: Sequence[str], category: str, base: float = 2.0,
                    count: str | None = None) -> DataFrame:
    """-sum p log p over categories per key, 0 with fewer than two categories; base 2 or e."""
    n = F.sum(count) if count else F.count(F.lit(1))
    cat = df.groupBy(*keys, category).agg(n.cast("double").alias("n")).filter(F.col("n") > 0)
    # log(total) - sum(n log n)/total needs one pass over the category counts
    total = F.sum("n")
    nat = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    return cat.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_categories"), total.alias("n_total"), nat.alias("nat")) \
        .select(*keys, "n_categories", "n_total",
                F.when(F.col("n_categories") > 1, F.col("nat") / F.log(F.lit(float(base)))).otherwise(0.0).alias("entropy"))


def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient per key from value counts and their positions; 0 when empty or all zero."""
    pos = value_positions(df, keys, value)
    n, before, v = F.col("n"), F.col("n_before"), F.col(value)
    ranks = n * before + n * (n + 1) / 2
    out = pos.groupBy(*keys).agg(F.max("n_total").alias("n"), F.sum(v * n).alias("total"), F.sum(v * ranks).alias("w"))
    g = ratio(2 * F.col("w") - (F.col("n") + 1) * F.col("total"), F.col("n") * F.col("total"))
    return out.select(*keys, "n", F.coalesce(g, F.lit(0.0)).alias("gini"))


def group_divergence(df: DataFrame, period: Sequence[str], group: str, value: str) -> DataFrame:
    """Spread between groups per period: population std, range, highest and lowest group (first name on ties)."""
    return df.groupBy(*period).agg(
        F.stddev_pop(value).alias("spread"), (F.max(value) - F.min(value)).alias("value_range"),
        F.min_by(group, F.struct(-F.col(value), F.col(group))).alias("highest"),
        F.min_by(group, F.struct(F.col(value), F.col(group))).alias("lowest"), F.count(value).alias("n_groups"))


def event_gaps(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Days since the previous event of the key."""
    sec = df.withColumn("__s", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    prev = neighbours(sec, keys, "__s", tie, before={"__s": "__p"})
    return prev.withColumn("gap_days", (F.col("__s") - F.col("__p")) / 86400.0).drop("__s", "__p")


def dispersion_of_gaps(df: DataFrame, keys: Sequence[str], time: str, tie: str, at_least: int = 2) -> DataFrame:
    """Statistics of inter-event times: CV above 1.2 is clustered, below 0.8 quasi-periodic."""
    gaps = event_gaps(df, keys, time, tie).filter(F.col("gap_days").isNotNull())
    m = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("gap_days").alias("mean_days"),
                                F.stddev_pop("gap_days").alias("std_days")).filter(F.col("n_gaps") >= at_least)
    q = exact_quantiles(gaps, keys, "gap_days", {"median_days": 0.5})
    cv = ratio(F.col("std_days"), F.col("mean_days"))
    return join_keys(m, q, keys).withColumns({"cv": cv, "dispersion": cv * cv}).withColumn(
        "pattern", F.when(F.col("cv") > 1.2, "clustered").when(F.col("cv") < 0.8, "quasi-periodic")
        .otherwise("approximately_poisson"))


def significance_summary(df: DataFrame, label: Sequence[str], slope: str, p: str, alpha: float = 0.05) -> DataFrame:
    sig = F.col(p) < alpha
    return df.groupBy(*label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sig).alias("n_significant"),
        (100.0 * F.count_if(sig) / F.count(F.lit(1))).alias("pct_significant"),
        F.count_if(F.col(slope) > 0).alias("n_up"), F.count_if(F.col(slope) < 0).alias("n_down"),
        F.avg(slope).alias("mean_slope"))


def calendar_densify(counts: DataFrame, keys: Sequence[str], step: str, n: str) -> DataFrame:
    """Zero rows for every missing integer step between the first and the last of each key."""
    spans = counts.groupBy(*keys).agg(F.min(step).alias("__a"), F.max(step).alias("__b"))
    full = spans.select(*keys, F.explode(F.sequence("__a", "__b")).alias(step))
    return join_keys(full, counts.select(*keys, step, n), [*keys, step], "left").withColumn(
        n, F.coalesce(n, F.lit(0)))


def category_totals(df: DataFrame, period: Sequence[str], category: str, value: str) -> DataFrame:
    """Total per period and a map of category totals."""
    cat = df.groupBy(*period, category).agg(F.sum(value).alias("v"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(category).alias("k"), F.round("v", 2).alias("v"))))
    return cat.groupBy(*period).agg(F.round(F.sum("v"), 2).alias("total"), F.map_from_entries(entries).alias("by_category"))


def cumulative_share_point(df: DataFrame, keys: Sequence[str], step: str, value: str, shares: dict[str, float]) -> DataFrame:
    """First step (day of year, bounded per key) where the running total reaches each share of the key total."""
    up = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum(value).over(Window.partitionBy(*keys))
    run = df.select(*keys, step, F.sum(value).over(up).alias("run"), whole.alias("whole"))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("run") >= s * F.col("whole"), F.col(step))).alias(c)
                                    for c, s in shares.items()])


def duplicates(df: DataFrame, content: str, row_id: str) -> DataFrame:
    """Groups of rows with the same content, keyed by digest so that long texts are not shuffled."""
    return (df.groupBy(F.sha2(F.col(content), 256).alias("digest"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id")).filter(F.col("n") > 1))


def distinct_periods(df: DataFrame, keys: Sequence[str], year: str, month: str, first_last: str,
                     min_years: int = 0) -> DataFrame:
    """Distinct years and months with data, record start and end, only keys with `min_years` years.

    Two grouped passes instead of distinct aggregates keep the shuffle at one row per key and month.
    """
    months = df.groupBy(*keys, year, month).agg(F.min(first_last).alias("a"), F.max(first_last).alias("b"))
    years = months.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("m"), F.min("a").alias("a"), F.max("b").alias("b"))
    return (years.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_years"), F.sum("m").alias("n_months"),
                                     F.min("a").alias("record_start"), F.max("b").alias("record_end"))
            .filter(F.col("n_years") >= min_years))


def grouped_count(df: DataFrame, where: Column, dims: Sequence[str]) -> DataFrame:
    return df.filter(where).groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))

"""Runs of a condition (gaps and islands), their merging, members and effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.aggregates import ratio
from seriesloom.operators.joins import first_overlap
from seriesloom.operators.split import exact_quantiles, join_keys, neighbours, running_sums, with_group_stats
from seriesloom.operators.windows import by_time


def episodes(df: DataFrame, keys: Sequence[str], time: str, cond: Column, value: str | None = None, min_len: int = 1,
             max_gap: float | None = None, n: int | None = 1) -> DataFrame:
    """Maximal runs of rows where `cond` holds: start, end, length in rows, peak (first largest |value|), mean.

    A run is identified by the number of interrupting rows before it. `max_gap` also breaks a run where numeric
    `time` jumps by more. `time` is unique per key; n = 1 is for calendar-bounded series, None for raw rows.
    `ongoing` marks a run that reaches the last row of its key.
    """
    keys = list(keys)
    rows = df.withColumn("__ok", F.coalesce(cond, F.lit(False)))
    if max_gap is not None:
        if n == 1:
            rows = rows.withColumn("__pt", F.lag(time).over(by_time(keys, time)))
        else:
            rows = neighbours(rows, keys, time, before={time: "__pt"}, n=n)
        rows = rows.withColumn("__jump", F.coalesce(F.col(time) - F.col("__pt") > max_gap, F.lit(False))).drop("__pt")
        breaks = F.when(F.col("__ok"), 0).otherwise(1) + F.when(F.col("__jump"), 1).otherwise(0)
    else:
        breaks = F.when(F.col("__ok"), 0).otherwise(1)
    run = running_sums(rows, keys, time, {"b": breaks}, totals=False, n=n)
    if max_gap is not None:
        run = run.withColumn("b_before", F.col("b_before") + F.when(F.col("__jump"), 1).otherwise(0))
    last = df.groupBy(*keys).agg(F.max(time).alias("__last"))
    aggs = [F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("length")]
    if value:
        first_peak = F.struct(-F.abs(value), F.col(time))
        aggs += [F.min_by(value, first_peak).alias("peak"), F.min_by(time, first_peak).alias("peak_time"), F.avg(value).alias("mean_value")]
    out = run.filter("__ok").groupBy(*keys, "b_before").agg(*aggs).drop("b_before").filter(F.col("length") >= min_len)
    out = join_keys(out, last, keys) if keys else out.withColumn("__last", last.scalar())
    return out.withColumn("ongoing", F.col("end") == F.col("__last")).drop("__last")


def threshold_flags(df: DataFrame, keys: Sequence[str], value: str, factor: float = 2.0, method: str = "linear",
                    usable: Column | None = None, n: int | None = 1) -> DataFrame:
    """Flag values above `factor` times the key's own median; `usable` limits the rows behind the median.

    n = 1 is for calendar-bounded series, None for raw rows.
    """
    base = df.filter(usable) if usable is not None else df
    med = exact_quantiles(base, keys, value, {"median": 0.5}, method, n)
    return join_keys(df, med, list(keys), "left").withColumn("flag", F.col(value) > factor * F.col("median"))


def breadth_index(flags: DataFrame, slot: str, value: str, flag: str = "flag") -> DataFrame:
    """Per slot: series with a value, flagged series, and their share."""
    return flags.groupBy(slot).agg(F.count(value).alias("n_series"), F.count_if(F.col(flag)).alias("n_flagged")).withColumn(
        "breadth", F.coalesce(ratio(F.col("n_flagged"), F.col("n_series")), F.lit(0.0)))


def merge_gap(runs: DataFrame, keys: Sequence[str], gap: float, strict: bool = False, start: str = "start", end: str = "end") -> DataFrame:
    """Join runs whose distance (start minus previous end) is at most `gap`, or below it when `strict`."""
    w = by_time(keys, start)
    dist = F.col(start) - F.lag(end).over(w)
    apart = dist >= gap if strict else dist > gap
    ids = F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("__g", ids).groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def min_duration(runs: DataFrame, at_least: float, offset: float = 0, start: str = "start", end: str = "end") -> DataFrame:
    """Runs with end - start + offset >= at_least."""
    return runs.filter(F.col(end) - F.col(start) + offset >= at_least)


# Named parameter sets of breadth episodes: unit of the limit, limit, minimum length before/after merging, merge gap.
PRESETS = {
    "calendar": dict(by="count", limit=3, before=None, after=10, gap=30, strict=True),
    "rows": dict(by="share", limit=0.15, before=5, after=None, gap=30, strict=False),
    "loose": dict(by="share", limit=0.25, before=None, after=None, gap=20, strict=False),
}


def breadth_episodes(index: DataFrame, slot: str, by: str, limit: float, before: int | None, after: float | None,
                     gap: float, strict: bool) -> DataFrame:
    """Runs of slots whose flagged count or share reaches `limit`, filtered and merged in the preset's order."""
    cond = F.col("n_flagged" if by == "count" else "breadth") >= limit
    runs = episodes(index, [], slot, cond, min_len=before or 1).select("start", "end")
    merged = merge_gap(runs, [], gap, strict)
    kept = min_duration(merged, after) if after is not None else merged
    order = Window.partitionBy(F.lit(0)).orderBy("start")
    return kept.withColumn("episode", F.row_number().over(order))


def within_episodes(rows: DataFrame, eps: DataFrame, slot: str, episode: str = "episode") -> DataFrame:
    """Rows tagged with the episode whose [start, end] holds their integer slot: an equi-join on the slots it covers."""
    covered = eps.select(episode, F.explode(F.sequence("start", "end")).alias(slot))
    return rows.join(covered, slot)


def episode_members(flags: DataFrame, eps: DataFrame, slot: str, key: str, value: str, median: str = "median") -> DataFrame:
    """Per episode and series: flagged rows, their share of the duration, peak, mean and peak over median."""
    inside = within_episodes(flags, eps, slot)
    m = inside.groupBy("episode", key).agg(F.count_if(F.col("flag")).alias("days"), F.max(value).alias("peak"), F.avg(value).alias("mean_value"),
                                           F.max(median).alias("median")).filter("days > 0")
    length = eps.select("episode", (F.col("end") - F.col("start") + 1).alias("duration"))
    return m.join(length, "episode").withColumns({"fraction": F.col("days") / F.col("duration"), "peak_ratio": ratio(F.col("peak"), F.col("median"))})


def episode_profile(index: DataFrame, members: DataFrame, eps: DataFrame, slot: str) -> DataFrame:
    """Duration, peak and mean breadth, first peak slot, affected series and both severities of every episode."""
    b = within_episodes(index, eps, slot).groupBy("episode").agg(
        F.max("breadth").alias("peak_breadth"), F.min_by(slot, F.struct(-F.col("breadth"), F.col(slot))).alias("peak_slot"), F.avg("breadth").alias("mean_breadth"))
    m = members.groupBy("episode").agg(F.count(F.lit(1)).alias("n_members"), F.avg("peak_ratio").alias("severity_ratio"))
    out = eps.join(b, "episode").join(m, "episode", "left").withColumn("duration", F.col("end") - F.col("start") + 1)
    return out.withColumn("severity", F.col("peak_breadth") * F.sqrt("duration") * F.coalesce("n_members", F.lit(0)))


def label_known(eps: DataFrame, periods: Sequence[tuple], start: str = "start", end: str = "end") -> DataFrame:
    return eps.withColumn("known", first_overlap(F.col(start), F.col(end), periods))


def episode_effect(metric: DataFrame, eps: DataFrame, slot: str, value: str, calm_rows: int = 120) -> DataFrame:
    """Mean of a metric inside each episode, in the `calm_rows` slots before it, and the difference."""
    inside = within_episodes(metric, eps, slot).groupBy("episode").agg(F.avg(value).alias("during"))
    lead_in = eps.select("episode", F.greatest(F.col("start") - calm_rows, F.lit(0)).alias("start"), (F.col("start") - 1).alias("end")).filter("end >= start")
    calm = within_episodes(metric, lead_in, slot).groupBy("episode").agg(F.avg(value).alias("calm"))
    return (eps.select("episode").join(inside, "episode", "left").join(calm, "episode", "left")
            .withColumn("surge", F.col("during") - F.col("calm")))


def network_density(corr: DataFrame, by: Sequence[str], threshold: float = 0.5, absolute: bool = True, r: str = "r") -> DataFrame:
    """Share of series pairs whose correlation passes the threshold."""
    strong = F.abs(r) > threshold if absolute else F.col(r) > threshold
    return corr.groupBy(*by).agg(F.avg(strong.cast("double")).alias("density"), F.count(F.lit(1)).alias("n_pairs"))


def metric_anomalies(df: DataFrame, keys: Sequence[str], value: str, high: float = 1.5, low: float = 0.5,
                     n: int | None = 1) -> DataFrame:
    """Rows above `high` or below `low` times the median of their key (n as in threshold_flags)."""
    med = exact_quantiles(df, keys, value, {"__med": 0.5}, n=n)
    both = join_keys(df, med, list(keys)) if keys else df.withColumn("__med", med.scalar())
    kind = F.when(F.col(value) > high * F.col("__med"), "high").when(F.col(value) < low * F.col("__med"), "low")
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).drop("__med")


def run_length_stats(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Runs below the key's median: number, longest and mean length."""
    med = exact_quantiles(df, keys, value, {"__med": 0.5}, n=1)
    runs = episodes(join_keys(df, med, list(keys)), keys, time, F.col(value) < F.col("__med"))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.max("length").alias("max_length"), F.avg("length").alias("mean_length"))


def runs_per_block(runs: DataFrame, keys: Sequence[str], start: str, size: int) -> DataFrame:
    """Number of runs starting in each block of `size` steps."""
    return runs.groupBy(*keys, (F.floor(F.col(start) / size) * size).cast("bigint").alias("block")).agg(F.count(F.lit(1)).alias("n_runs"))


def cycle_segments(df: DataFrame, keys: Sequence[str], time: str, value: str, guides: Sequence[tuple[int, float]], reach: float) -> DataFrame:
    """Cycles between minima found near guide times: the middle of tied minima, the first maximum before the next
    minimum, rise and fall times, asymmetry and the total of the value."""
    keys = list(keys)
    from seriesloom.functions.literals import explode_matches
    near = explode_matches(df.filter(F.col(value).isNotNull()), [(int(i), float(g)) for i, g in guides], ["cycle", "guide"],
                           lambda g: F.abs(F.col(time) - g["guide"]) <= reach)
    near = with_group_stats(near, [*keys, "cycle"], __low=F.min(value)).filter(F.col(value) == F.col("__low"))
    w = Window.partitionBy(*keys, "cycle")
    tied = near.withColumns({"__r": F.row_number().over(w.orderBy(time)) - 1, "__c": F.count(F.lit(1)).over(w)})
    minima = tied.filter(F.col("__r") == F.floor(F.col("__c") / 2)).select(*keys, "cycle", F.col(time).alias("min_time"), F.col(value).alias("min_value"))
    minima = minima.withColumn("next_min", F.lead("min_time").over(by_time(keys, "cycle")))
    # every row belongs to the latest minimum at or before it, so segments come from an ordered union, not a range join
    tags = minima.select(*keys, F.col("min_time").alias(time), F.lit(None).cast("double").alias(value),
                         F.struct("cycle", "min_time", "min_value", "next_min").alias("__m"))
    rows = df.select(*keys, time, F.col(value).cast("double").alias(value), F.lit(None).cast(tags.schema["__m"].dataType).alias("__m"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(time, F.col("__m").isNull())
    seg = rows.unionByName(tags).withColumn("__m", F.last("__m", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seg = seg.filter(F.col("__m").isNotNull() & F.col(value).isNotNull()).select(*keys, time, value, "__m.*")
    top = F.struct(-F.col(value), F.col(time))
    out = seg.groupBy(*keys, "cycle", "min_time", "min_value", "next_min").agg(
        F.min_by(time, top).alias("max_time"), F.max(value).alias("max_value"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    rise, fall = F.col("max_time") - F.col("min_time"), F.col("next_min") - F.col("max_time")
    return out.withColumns({"rise": rise, "fall": fall, "asymmetry": ratio(rise, fall)})


def conditional_response(deltas: DataFrame, trigger: Column, series: Sequence[str], split: Column | None = None,
                         method: str = "linear") -> DataFrame:
    """Mean and median change of every other series over the rows where `trigger` holds, overall or by `split`.

    `deltas` is wide: one change column per series.
    """
    hit = deltas.filter(trigger).withColumn("part", split if split is not None else F.lit("all"))
    long = hit.select("part", *series).unpivot("part", list(series), "series", "change").filter(F.col("change").isNotNull())
    m = long.groupBy("part", "series").agg(F.count(F.lit(1)).alias("n"), F.avg("change").alias("mean_change"), F.count_if(F.col("change") > 0).alias("n_up"))
    return join_keys(m, exact_quantiles(long, ["part", "series"], "change", {"median_change": 0.5}, method), ["part", "series"])


def rate_storms(windows: DataFrame, keys: Sequence[str], z_min: float = 2.0) -> DataFrame:
    """Consecutive windows with z >= z_min: from the first start to the start of the window after the run (or the end
    of the last window), with the largest count and z. Input is the output of rolling_event_counts."""
    w = by_time(keys, "window")
    nxt = windows.withColumn("stop_s", F.coalesce(F.lead("start_s").over(w), F.col("end_s")))
    run = running_sums(nxt.withColumn("__ok", F.coalesce(F.col("z") >= z_min, F.lit(False))), keys, "window",
                       {"b": F.when(F.col("__ok"), 0).otherwise(1)}, totals=False, n=1)
    return run.filter("__ok").groupBy(*keys, "b_before").agg(
        F.min("start_s").alias("start_s"), F.max("stop_s").alias("stop_s"), F.max("n").alias("peak_n"), F.max("z").alias("peak_z")).drop("b_before")


def storm_members(storms: DataFrame, events: DataFrame, keys: Sequence[str], seconds: str, size: str, at_least: float) -> DataFrame:
    """Events of at least the given size inside each storm, matched on the days it spans."""
    s = storms.withColumn("__d", F.explode(F.sequence(F.floor(F.col("start_s") / 86400), F.floor(F.col("stop_s") / 86400))))
    e = events.filter(F.col(size) >= at_least).withColumn("__d", F.floor(F.col(seconds) / 86400))
    hit = join_keys(s, e, [*keys, "__d"]).filter(F.col(seconds).between(F.col("start_s"), F.col("stop_s")))
    return hit.groupBy(*keys, "start_s").agg(F.count(F.lit(1)).alias("n_notable"), F.max(size).alias("largest"))

"""Sentinels, profiles, coverage, cuts, flags, reject reasons and named periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.literals import explode_matches


def clean_sentinels(df: DataFrame, columns: Sequence[str], missing: Column | None = None,
                    at_most: float | None = None, negative: bool = False) -> DataFrame:
    """NULL out non-finite values and the sentinels described by `at_most` or `negative` or an own predicate."""

    def rule(c: str) -> Column:
        x = F.col(c)
        bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        if at_most is not None:
            bad = bad | (x <= at_most)
        if negative:
            bad = bad | (x < 0)
        if missing is not None:
            bad = bad | missing
        return F.when(~bad, x)

    return df.withColumns({c: rule(c) for c in columns})


def profile_quality(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
                    between: tuple[str, str, str, float] | None = None) -> DataFrame:
    """Rows, first and last time, nulls and extremes per value column; `between` = (low, mid, high, slack) counts
    rows whose mid value leaves [low - slack, high + slack]."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")]
    for v in values:
        nulls = F.count_if(F.col(v).isNull())
        aggs += [nulls.alias(f"{v}_nulls"), (100.0 * nulls / F.count(F.lit(1))).alias(f"{v}_null_pct"),
                 F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    if between:
        low, mid, high, slack = between
        out = (F.col(mid) < F.col(low) - slack) | (F.col(mid) > F.col(high) + slack)
        aggs.append(F.count_if(out).alias("range_violations"))
    return df.groupBy(*keys).agg(*aggs)


def covered_mean(df: DataFrame, keys: Sequence[str], value: str, at_least: int) -> DataFrame:
    """Mean and count per group, only for groups with `at_least` valid values."""
    return (df.groupBy(*keys).agg(F.count(value).alias("n_valid"), F.avg(value).alias("mean_value"))
            .filter(F.col("n_valid") >= at_least))


def quality_cuts(df: DataFrame, value: str, err_up: str, err_down: str, low: float, high: float,
                 max_fraction: float = 0.20) -> DataFrame:
    """Keep values in [low, high] whose fractional error is small or unknown; add inverse-variance weights."""
    frac = (F.when(F.col(err_up).isNotNull() & F.col(err_down).isNotNull(),
                   F.greatest(F.abs(err_up), F.abs(err_down)) / F.col(value))
            .when(F.col(err_up).isNotNull(), F.abs(err_up) / F.col(value)))
    kept = df.filter((F.col(value) > 0) & F.col(value).between(low, high)).withColumn("frac_err", frac)
    kept = kept.filter(F.col("frac_err").isNull() | (F.col("frac_err") <= max_fraction))
    sigma = F.col("frac_err") * F.col(value)
    return kept.withColumn("weight", F.when(F.col("frac_err") > 0, 1.0 / (sigma * sigma)).otherwise(1.0))


def flag_quality(df: DataFrame, flags: dict[str, Column], name: str = "flags") -> DataFrame:
    """Array of the names of all rules that hold."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in flags.items()])))


def reject_reason(rules: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """Name of the first failing rule; NULL conditions do not fail."""
    out = None
    for name, failing in rules:
        hit = F.coalesce(failing, F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(kept))


def skip_accounting(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.groupBy(reject_reason(rules).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def period_slice(df: DataFrame, time: str, periods: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Repeat each row for every named period [lo, hi] that holds its `time` (a year or other number)."""
    return explode_matches(df, periods, ["period", "lo", "hi"],
                           lambda p: (F.col(time) >= p["lo"]) & (F.col(time) <= p["hi"]))

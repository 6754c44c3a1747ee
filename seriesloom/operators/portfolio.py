"""Signals with decay, quantile buckets, benchmarks, comparisons, configuration grids and scenario projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.aggregates import ratio
from seriesloom.operators.split import row_positions
from seriesloom.operators.windows import by_time


def signals_as_of(scores: DataFrame, key: str, day: str, kind: str, score: str, dates: Sequence[int], buffer_days: int = 2,
                  half_life: float = 90.0, max_age: int | None = None) -> DataFrame:
    """Signal of every key at each rebalance date: decayed mean per kind, then the equal-weight composite.

    A score counts from `day` + buffer; its weight halves every `half_life` days. `day` is an integer day number and
    the dates are a fixed list, so a score visits its own later dates by projection and is summed map-side.
    """
    start = F.col(day) + buffer_days
    ahead = F.array(*[F.lit(int(d)) for d in sorted(dates)])

    def weight(age: Column) -> Column:
        return F.exp(-F.log(F.lit(2.0)) * age / half_life)

    if max_age is None:
        # scores due at the same first date are summed once, with weights relative to it, before they visit later dates
        first = F.get(F.filter(ahead, lambda d: d >= start), F.lit(0))
        due = scores.select(key, kind, score, start.alias("__s"), first.alias("__first")).filter(F.col("__first").isNotNull())
        w = weight(F.col("__first") - F.col("__s"))
        due = due.groupBy(key, kind, "__first").agg(F.sum(F.col(score) * w).alias("__sw"), F.sum(w).alias("__w"))
        live = due.select("*", F.explode(F.filter(ahead, lambda d: d >= F.col("__first"))).alias("as_of"))
        fade = weight(F.col("as_of") - F.col("__first"))
        per_kind = live.groupBy("as_of", key, kind).agg((F.sum(F.col("__sw") * fade) / F.sum(F.col("__w") * fade)).alias("signal"))
    else:
        later = F.filter(ahead, lambda d: (d >= start) & (d - start <= max_age))
        live = scores.select(key, kind, score, start.alias("__s"), F.explode(later).alias("as_of"))
        w = weight(F.col("as_of") - F.col("__s"))
        per_kind = live.groupBy("as_of", key, kind).agg((F.sum(F.col(score) * w) / F.sum(w)).alias("signal"))
    return per_kind.groupBy("as_of", key).agg(F.avg("signal").alias("composite"), F.count(F.lit(1)).alias("n_kinds"))


def quantile_buckets(df: DataFrame, by: Sequence[str], score: str, tie: str, n_buckets: int = 5, descending: bool = True,
                     name: str = "bucket") -> DataFrame:
    """ntile per group from distributed row numbers: the first n mod q buckets hold one row more."""
    pos = row_positions(df, by, score, tie, descending, "__p", "__n")
    size, extra, i = F.floor(F.col("__n") / n_buckets), F.col("__n") % n_buckets, F.col("__p") - 1
    wide = extra * (size + 1)
    bucket = F.when(i < wide, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - wide) / F.greatest(size, F.lit(1)))) + 1
    return pos.withColumn(name, bucket.cast("int")).drop("__p", "__n")


def signal_ranks(df: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """Position of each key per date, largest score first."""
    return row_positions(df, by, score, tie, True, "rank")


def equal_weight(returns: DataFrame, month: str, value: str) -> DataFrame:
    return returns.groupBy(month).agg(F.avg(value).alias("ew_return"), F.count(value).alias("n_members"))


def performance(series: DataFrame, keys: Sequence[str], value: str, years: Column, periods_per_year: int = 12) -> DataFrame:
    """Total and annualised return and the mean/std ratio scaled to a year (0 without variance)."""
    m = series.groupBy(*keys).agg(F.count(value).alias("n"), (F.exp(F.sum(F.log1p(value))) - 1).alias("total_return"), F.avg(value).alias("__m"),
                                  F.stddev_samp(value).alias("__s"))
    sharpe = F.coalesce(ratio(F.col("__m"), F.col("__s")) * (periods_per_year ** 0.5), F.lit(0.0))
    return m.select(*keys, "n", "total_return", (F.pow(1 + F.col("total_return"), 1 / years) - 1).alias("annualised"), sharpe.alias("sharpe"))


def comparison(strategy: DataFrame, benchmark: DataFrame, period: str, value: str, bench: str, start_value: float = 10000.0) -> DataFrame:
    """Both returns per period, whether the strategy won, and both running account values. Periods are calendar-bounded."""
    both = strategy.select(period, F.col(value).alias("strategy")).join(benchmark.select(period, F.col(bench).alias("benchmark")), period, "left")
    both = both.withColumn("benchmark", F.coalesce("benchmark", F.lit(0.0)))
    w = by_time([], period).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({"won": F.col("strategy") > F.col("benchmark"), "equity": start_value * F.exp(F.sum(F.log1p("strategy")).over(w)),
                             "benchmark_equity": start_value * F.exp(F.sum(F.log1p("benchmark")).over(w))})


def drawdown(equity: DataFrame, period: str, value: str) -> DataFrame:
    """Largest fall below the running maximum."""
    w = by_time([], period).rowsBetween(Window.unboundedPreceding, 0)
    fall = equity.select((F.col(value) / F.max(value).over(w) - 1).alias("d"))
    return fall.agg(F.min("d").alias("max_drawdown"))


def grid_summary(results: DataFrame, dims: Sequence[str], metric: str) -> DataFrame:
    """Mean of a metric for each value of each dimension, as grouping sets of one dimension at a time."""
    sets = [[F.col(d)] for d in dims]
    return results.groupingSets(sets, *dims).agg(F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n"))


def scenario_grid(base: DataFrame, outstanding: str, spread: Column, maturity: int, scenarios: Sequence[tuple[str, float]], years: Sequence[int],
                  era_end: int, era_years: int) -> DataFrame:
    """Yearly repricing cost per scenario: the share of an era's debt still outstanding under uniform issuance over
    `maturity` years, times the rate spread shifted by the scenario."""
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(d)).alias("delta"), F.lit(y).alias("yr")) for n, d in scenarios for y in years])
    grid = base.select("*", F.inline(cells))
    since = F.col("yr") - era_end
    alive = F.size(F.filter(F.sequence(since, since + era_years - 1), lambda y: y < maturity))
    share = F.when(since < maturity, alive / float(maturity)).otherwise(0.0)
    return grid.withColumns({"remaining_share": share, "cost": F.col(outstanding) * share * (spread + F.col("delta")) / 100})


def debt_projection(base: DataFrame, amount: str, growth: str, rate: str, years: Sequence[int], origin: int, step: float = 0.15, cap: float = 4.5) -> DataFrame:
    """Debt growing at a fixed rate, an effective rate rising by `step` a year up to `cap`, and the interest."""
    rows = base.select("*", F.explode(F.array(*[F.lit(y) for y in years])).alias("yr"))
    out = F.col("yr") - origin
    debt = F.col(amount) * F.pow(1 + F.col(growth), out)
    eff = F.least(F.col(rate) + step * out, F.lit(cap))
    return rows.withColumns({"projected_debt": debt, "projected_rate": eff, "projected_interest": debt * eff / 100})

"""Trend tests, correlations, group comparisons and model fits over keyed series and samples.

Everything reduces to moment sums or to value positions, both of which combine map-side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.pvalues import p_value, t_critical
from seriesloom.operators.aggregates import ratio
from seriesloom.operators.pairs import pair_moments
from seriesloom.operators.split import (join_keys, running_sums, value_positions, with_group_stats)
from seriesloom.session import stored


# ---- linear trends -------------------------------------------------------------------------------------------

def line_aggs(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """Aggregates every line fit needs."""
    return [F.regr_count(y, x).alias(f"{prefix}n"), F.regr_sxx(y, x).alias(f"{prefix}sxx"),
            F.regr_syy(y, x).alias(f"{prefix}syy"), F.regr_sxy(y, x).alias(f"{prefix}sxy"),
            F.regr_avgx(y, x).alias(f"{prefix}mx"), F.regr_avgy(y, x).alias(f"{prefix}my")]


def line_columns(prefix: str = "") -> dict[str, Column]:
    """slope, intercept, r2, std_err and t from the aggregates; flat or vertical data give zeros."""
    n, sxx, syy, sxy, mx, my = (F.col(f"{prefix}{c}") for c in ("n", "sxx", "syy", "sxy", "mx", "my"))
    slope = F.coalesce(ratio(sxy, sxx), F.lit(0.0))
    r2 = F.least(F.coalesce(ratio(sxy * sxy, sxx * syy), F.lit(0.0)), F.lit(1.0))
    df = F.nullif(F.greatest(n - 2, F.lit(0)), F.lit(0))
    return {f"{prefix}slope": slope, f"{prefix}intercept": my - slope * mx, f"{prefix}r2": r2,
            f"{prefix}std_err": F.sqrt(ratio((1 - r2) * syy, sxx) / df),
            f"{prefix}t": F.signum(sxy) * F.sqrt(r2 * df / ((1 - r2) + 1e-20))}


def ols_trend(df: DataFrame, keys: Sequence[str], x: str, y: str, scale: float = 1.0, min_points: int = 3,
              tests: bool = True) -> DataFrame:
    """Least-squares line per key: slope (times `scale`), intercept, R2, standard error, p and 95 % interval.

    Keys with fewer than `min_points` points get slope 0 and p 1. scale = 10 gives units per decade for yearly x.
    """
    fit = df.groupBy(*keys).agg(*line_aggs(F.col(x).cast("double"), F.col(y).cast("double")))
    fit = fit.withColumns(line_columns())
    few = F.col("n") < min_points
    base = [*keys, "n", F.when(few, 0.0).otherwise(F.col("slope") * scale).alias("slope"), "intercept",
            F.when(few, 0.0).otherwise(F.col("r2")).alias("r2"),
            F.when(few, 0.0).otherwise(F.col("std_err") * scale).alias("std_err")]
    if not tests:
        return fit.select(*base)
    fit = fit.select(*base, p_value("t", F.col("t"), F.col("n") - 2).alias("__p"),
                     t_critical(F.col("n") - 2).alias("__tc"))
    half = F.coalesce(F.col("__tc") * F.col("std_err"), F.lit(0.0))
    return fit.withColumns({"p_value": F.coalesce(F.when(F.col("n") < min_points, 1.0).otherwise(F.col("__p")), F.lit(1.0)),
                            "ci_lower": F.col("slope") - half, "ci_upper": F.col("slope") + half}).drop("__p", "__tc")


def concordance(df: DataFrame, keys: Sequence[str], x: str, y: str, n: int | None = None) -> DataFrame:
    """S = concordant minus discordant pairs per key, exactly, without forming pairs; equal x do not count.

    n = 1 is for calendar-bounded series.
    """
    return _pair_signs(_placed(df, keys, x, y, n), keys, n)


def _placed(df: DataFrame, keys: Sequence[str], x: str, y: str, n: int | None) -> DataFrame:
    """x, `__y` (a double), the position `__i` on x and the rows `n` of the key."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pos = value_positions(both, keys, x, n=n).select(*keys, x, F.col("n_before").alias("__i"), F.col("n_total").alias("n"))
    return join_keys(both.select(*keys, x, F.col(y).cast("double").alias("__y")), pos, [*keys, x])


def _pair_signs(rows: DataFrame, keys: Sequence[str], n: int | None) -> DataFrame:
    """S of placed rows. Two rows are compared at the highest bit where their positions differ, so grouping by (bit,
    higher bits) splits all pairs once; inside such a group S follows from running counts over y. The work is N log N rows.
    """
    keys = list(keys)
    top = F.length(F.bin(F.col("n"))) - 1
    bits = rows.select(*keys, "__y", "__i", F.explode(F.sequence(F.lit(0), top)).alias("__l"))
    high = F.call_function("shiftright", F.col("__i"), F.col("__l") + 1)
    bit = F.call_function("shiftright", F.col("__i"), F.col("__l")).bitwiseAND(F.lit(1))
    cells = bits.groupBy(*keys, "__l", high.alias("__h"), "__y").agg(
        F.sum(1 - bit).alias("c0"), F.sum(bit).alias("c1"))
    run = running_sums(cells, [*keys, "__l", "__h"], "__y", {"z": F.col("c0")}, n=n)
    s = F.sum(F.col("c1") * (2 * F.col("z_before") + F.col("c0") - F.col("z_total")))
    return run.groupBy(*keys).agg(s.cast("bigint").alias("s"))


def tie_terms(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per key: n, pairs tied on `value`, and the cubic tie sums used by rank-test variances."""
    t = F.col("t")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    return counts.groupBy(*keys).agg(
        F.sum("t").alias(f"{name}_n"), F.sum(t * (t - 1) / 2).alias(f"{name}_pairs"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}_v0"), F.sum(t * (t - 1) * (t - 2)).alias(f"{name}_v2"),
        F.sum(t * t * t - t).alias(f"{name}_cube"))


def mann_kendall(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int | None = 1,
                 tests: bool = True) -> DataFrame:
    """S, tau, tie-corrected z with continuity correction, and p. Fewer than 4 points give zeros and p 1.

    The default treats the series as calendar-bounded; pass n = None for raw rows with hot keys.
    """
    s = concordance(df, keys, time, value, n)
    ties = tie_terms(df.filter(F.col(time).isNotNull()), keys, value, "y")
    m = F.col("y_n")
    out = join_keys(ties, s, list(keys), "left") if keys else ties.withColumn("s", s.scalar())
    var = (m * (m - 1) * (2 * m + 5) - F.col("y_v0")) / 18.0
    few = m < 4
    z = F.when(few | (var <= 0), 0.0).otherwise((F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt(var))
    out = out.select(*keys, m.cast("bigint").alias("n"), F.when(few, 0).otherwise(F.col("s")).cast("bigint").alias("s"),
                     F.when(few, 0.0).otherwise(F.col("s") / (m * (m - 1) / 2)).alias("tau"),
                     F.coalesce(z, F.lit(0.0)).alias("z"))
    if not tests:
        return out
    out = out.withColumn("p_value", F.when(F.col("n") < 4, 1.0).otherwise(p_value("normal", F.col("z"))))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def sen_slope(df: DataFrame, keys: Sequence[str], x: str, y: str, scale: float = 1.0, digits: int = 6, in_task: int = 1024) -> DataFrame:
    """Median of pairwise slopes per key, times `scale`; 0 with fewer than two distinct x.

    Keys with up to `in_task` points, such as any series of calendar periods, form their slopes lag by lag inside one task,
    which holds at most in_task^2 / 2 numbers. Longer ones go through `median_slope`, which never forms a pair.
    """
    keys = list(keys)
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    sizes = df.groupBy(*keys).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))
    long = sizes.filter(F.col("n") > in_task)
    picked = _slopes_in_task(join_keys(points, sizes.filter(F.col("n") <= in_task).select(*keys), keys, "left_semi") if keys
                             else points.filter(sizes.scalar() <= in_task), keys)
    if not long.isEmpty():
        rows = join_keys(points, long.select(*keys), keys, "left_semi") if keys else points
        picked = picked.unionByName(median_slope(rows, keys, "__x", "__y", 10.0 ** -(digits + 3) / abs(scale or 1.0)).select(*keys, "slope"))
    slope = F.round(F.coalesce("slope", F.lit(0.0)) * scale, digits)
    out = join_keys(sizes, picked, keys, "left") if keys else sizes.withColumn("slope", picked.select("slope").scalar())
    return out.select(*keys, "n", slope.alias("sen_slope"))


def _slopes_in_task(points: DataFrame, keys: list[str]) -> DataFrame:
    schema = T.StructType([*points.select(*keys).schema.fields, T.StructField("slope", T.DoubleType())])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf.sort_values("__x")
        a, b = pts["__x"].to_numpy(float), pts["__y"].to_numpy(float)
        slopes = []
        for lag in range(1, len(a)):
            dx = a[lag:] - a[:-lag]
            ok = dx != 0
            slopes.append((b[lag:] - b[:-lag])[ok] / dx[ok])
        flat = np.concatenate(slopes) if slopes else np.empty(0)
        return pd.DataFrame([[*key[:len(keys)], float(np.median(flat)) if len(flat) else 0.0]], columns=schema.names)

    return points.groupBy(*keys).applyInPandas(fit, schema)


def median_slope(df: DataFrame, keys: Sequence[str], x: str, y: str, width: float, n: int | None = None, rounds: int = 60) -> DataFrame:
    """Median of pairwise slopes of keys of any length, to within `width` (or 2^-45 of its size), without forming pairs.

    A slope below theta is a discordant pair of y - theta * x over x, so `_pair_signs` ranks any theta among all slopes in N log
    N rows. Brackets around the two middle ranks start from quantiles of slopes of random pairs and shrink for all keys at
    once: every round ranks two values beside the interpolated rank and seven even steps. State is one row a key.
    """
    keys = list(keys)
    rows = stored(_placed(df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__v")), keys, "__x", "__v", n)
                        .withColumnRenamed("__y", "__v"))
    halves = F.pmod(F.xxhash64("__x", "__v"), F.floor(F.col("n") / 2) + 1)
    ends = rows.groupBy(*keys, halves.alias("__b")).agg(*[f(F.struct("__x", "__v")).alias(a) for f, a in ((F.min, "lo"), (F.max, "hi"))])
    guess = ratio(F.col("hi.__v") - F.col("lo.__v"), F.col("hi.__x") - F.col("lo.__x"))
    drawn = ends.select(*keys, guess.alias("g")).groupBy(*keys).agg(
        F.percentile_approx("g", [0.02, 0.25, 0.42, 0.5, 0.58, 0.75, 0.98], 1000).alias("q"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    same_x = tie_terms(rows, keys, "__x", "x")
    both = rows.groupBy(*keys, "__x", "__v").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("both"))
    facts = join_keys(join_keys(same_x.select(*keys, F.col("x_n").alias("m"), "x_pairs"), both, keys), drawn, keys)
    pairs = (F.col("m") * (F.col("m") - 1) / 2 - F.col("x_pairs")).cast("bigint")
    span = F.coalesce(F.greatest(F.col("g1") - F.col("g0"), F.abs("g1")), F.lit(0.0)) + width
    facts = facts.select(*keys, "both", pairs.alias("pairs"), span.alias("span"),
                         F.coalesce(F.array_distinct(F.concat("q", F.array("g0", "g1"))), F.array(F.lit(0.0))).alias("tries"))
    state = facts.filter(F.col("pairs") > 0)
    state = state.withColumns({"r_a": F.floor((F.col("pairs") - 1) / 2), "r_b": F.floor(F.col("pairs") / 2),
                               **{f"{c}_{t}": F.lit(None).cast("double") for t in "ab" for c in ("lo", "hi", "c", "d")}})
    state = stored(state)
    for turn in range(rounds):
        open_ = state.filter(F.size("tries") > 0)
        if open_.isEmpty():
            break
        state = stored(_narrowed(rows, state, keys, n, width, turn))
    middle = [(F.coalesce(f"lo_{t}", f"hi_{t}") + F.coalesce(f"hi_{t}", f"lo_{t}")) / 2 for t in "ab"]
    return state.select(*keys, "pairs", ((middle[0] + middle[1]) / 2).alias("slope"))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], n: int | None, width: float, turn: int) -> DataFrame:
    """Rank the tried values of every open key and draw its brackets in."""
    tried = state.filter(F.size("tries") > 0).select(*keys, F.explode("tries").alias("__theta"))
    by = [*keys, "__theta"]
    turned = join_keys(rows, tried, keys) if keys else rows.withColumn("__t", state.select("tries").scalar()).select("*", F.explode("__t").alias("__theta")).drop("__t")
    turned = turned.withColumn("__y", F.col("__v") - F.col("__theta") * F.col("__x"))
    signs = join_keys(_pair_signs(turned, by, n), tie_terms(turned, by, "__y", "z").select(*by, "z_pairs"), by)
    ranked = join_keys(signs, state.select(*keys, "pairs", "both", "r_a", "r_b"), keys) if keys else signs.withColumns(
        {c: state.select(c).scalar() for c in ("pairs", "both", "r_a", "r_b")})
    ties = F.greatest(F.col("z_pairs") - F.col("both"), F.lit(0.0))
    below = (F.col("pairs") - ties - F.col("s")) / 2
    ranked = ranked.select(*keys, "r_a", "r_b", F.col("__theta").alias("at"), below.alias("lt"), (below + ties).alias("le"))
    found = []
    for t in "ab":
        low, high = F.when(F.col("lt") <= F.col(f"r_{t}"), F.col("at")), F.when(F.col("le") > F.col(f"r_{t}"), F.col("at"))
        found += [F.max(low).alias(f"__lo_{t}"), F.max_by("lt", low).alias(f"__c_{t}"), F.min(high).alias(f"__hi_{t}"), F.min_by("le", high).alias(f"__d_{t}")]
    new = ranked.groupBy(*keys).agg(*found)
    both = join_keys(state, new, keys, "left") if keys else state.withColumns({c: new.select(c).scalar() for c in new.columns})
    for t in "ab":
        up = F.coalesce(F.col(f"__lo_{t}") > F.col(f"lo_{t}"), F.col(f"__lo_{t}").isNotNull())
        down = F.coalesce(F.col(f"__hi_{t}") < F.col(f"hi_{t}"), F.col(f"__hi_{t}").isNotNull())
        both = both.withColumns({f"lo_{t}": F.when(up, F.col(f"__lo_{t}")).otherwise(F.col(f"lo_{t}")), f"c_{t}": F.when(up, F.col(f"__c_{t}")).otherwise(F.col(f"c_{t}")),
                                 f"hi_{t}": F.when(down, F.col(f"__hi_{t}")).otherwise(F.col(f"hi_{t}")), f"d_{t}": F.when(down, F.col(f"__d_{t}")).otherwise(F.col(f"d_{t}"))})
    far = F.col("span") * float(4 ** min(turn, 200))

    def tries(t: str) -> Column:
        lo, hi, r = F.col(f"lo_{t}"), F.col(f"hi_{t}"), F.col(f"r_{t}")
        gap = hi - lo
        at = lo + gap * F.greatest(F.least((r + 0.5 - F.col(f"c_{t}")) / F.greatest(F.col(f"d_{t}") - F.col(f"c_{t}"), F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
        inner = F.filter(F.array(at - gap / 64, at + gap / 64, *[lo + gap * (i / 8) for i in range(1, 8)]), lambda v: (v > lo) & (v < hi))
        done = gap <= F.greatest(F.lit(width), F.greatest(F.abs(lo), F.abs(hi)) * 2.0**-45)
        return (F.when(lo.isNull(), F.array(hi - far)).when(hi.isNull(), F.array(lo + far))
                .when(done, F.array().cast("array<double>")).otherwise(inner))

    same = F.col("lo_a").eqNullSafe(F.col("lo_b")) & F.col("hi_a").eqNullSafe(F.col("hi_b"))
    return both.withColumn("tries", F.when(same, tries("a")).otherwise(F.array_distinct(F.concat(tries("a"), tries("b"))))).select(*state.columns)


def kendall_tau_b(df: DataFrame, keys: Sequence[str], x: str, y: str, n: int | None = 1, tests: bool = True) -> DataFrame:
    """tau-b with ties on both sides and its asymptotic p."""
    keys = list(keys)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = join_keys(join_keys(tie_terms(both, keys, x, "x"), tie_terms(both, keys, y, "y"), keys),
                    concordance(both, keys, x, y, n), keys)
    m, s = F.col("x_n"), F.col("s")
    pairs = m * (m - 1) / 2
    tau = ratio(s, F.sqrt((pairs - F.col("x_pairs")) * (pairs - F.col("y_pairs"))))
    var = ((m * (m - 1) * (2 * m + 5) - F.col("x_v0") - F.col("y_v0")) / 18
           + 2 * F.col("x_pairs") * F.col("y_pairs") / (m * (m - 1))
           + F.coalesce(ratio(F.col("x_v2") * F.col("y_v2"), 9 * m * (m - 1) * (m - 2)), F.lit(0.0)))
    out = out.select(*keys, m.cast("bigint").alias("n"), "s", tau.alias("tau_b"), ratio(s, F.sqrt(var)).alias("z"))
    return out.withColumn("p_value", p_value("normal", F.col("z"))) if tests else out


# ---- correlation ---------------------------------------------------------------------------------------------

def corr_columns(n: Column, sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column]:
    """r (0 for zero variance) and its t statistic."""
    r = F.coalesce(ratio(sxy, F.sqrt(sxx * syy)), F.lit(0.0))
    return r, r * F.sqrt((n - 2) / ((1 - r * r) + 1e-20))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3, tests: bool = True) -> DataFrame:
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return _correlated(df.groupBy(*keys).agg(*line_aggs(xs, ys)), keys, min_n, tests)


def _correlated(m: DataFrame, keys: Sequence[str], min_n: int, tests: bool) -> DataFrame:
    r, tstat = corr_columns(F.col("n"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    few = F.col("n") < min_n
    out = m.select(*keys, "n", F.when(few, 0.0).otherwise(r).alias("r"), F.when(~few, tstat).alias("t"))
    if not tests:
        return out.drop("t")
    p = F.coalesce(p_value("t", F.col("t"), F.col("n") - 2), F.lit(1.0))
    return out.withColumn("p_value", p).drop("t")


def pearson_matrix(df: DataFrame, slot: Sequence[str], key: str, value: str, tests: bool = True) -> DataFrame:
    """r and p for every pair of series over their common slots, from `pair_moments`. Pairs without a common value are left out."""
    return _correlated(pair_moments(df, slot, key, value), ["key_a", "key_b"], 3, tests)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, n: int | None = None) -> DataFrame:
    """Attach the average rank of `value` within its key to every row."""
    pos = value_positions(df, keys, value, n=n)
    ranks = pos.select(*keys, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(name))
    return join_keys(df, ranks, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, n: int | None = None, tests: bool = True) -> DataFrame:
    """Pearson correlation of average ranks; fewer than 3 rows give 0."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(both, keys, x, "__rx", n), keys, y, "__ry", n)
    return pearson(ranked, keys, "__rx", "__ry", tests=tests).withColumnRenamed("r", "rho")


def percentile_rank_mid(df: DataFrame, keys: Sequence[str], value: str, name: str = "pct_rank") -> DataFrame:
    """(rows below + half the equal rows) / rows, attached to every row."""
    pos = value_positions(df, keys, value)
    pct = pos.select(*keys, value, ((F.col("n_before") + 0.5 * F.col("n")) / F.col("n_total")).alias(name))
    return join_keys(df, pct, [*keys, value])


# ---- group comparisons ---------------------------------------------------------------------------------------

def mann_whitney_u(df: DataFrame, group: str, value: str, groups: Sequence, tests: bool = True) -> DataFrame:
    """U, tie-corrected z and p for every pair of the listed groups.

    Value counts of a group are repeated once per pair it belongs to and ordered jointly; no observation pairs exist.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    pairs = [(a, b) for i, a in enumerate(groups) for b in list(groups)[i + 1:]]
    pair = F.array(*[F.struct(F.lit(a).alias("group_a"), F.lit(b).alias("group_b")) for a, b in pairs])
    mine = F.filter(pair, lambda p: (p["group_a"] == F.col(group)) | (p["group_b"] == F.col(group)))
    spread = counts.select(group, value, "c", F.inline(mine))
    is_a = F.col(group) == F.col("group_a")
    by = ["group_a", "group_b"]
    cells = spread.groupBy(*by, value).agg(F.sum(F.when(is_a, F.col("c")).otherwise(0)).alias("ca"),
                                           F.sum(F.when(is_a, 0).otherwise(F.col("c"))).alias("cb"))
    run = running_sums(cells, by, value, {"a": F.col("ca"), "b": F.col("cb")})
    t = (F.col("ca") + F.col("cb")).cast("double")
    out = run.groupBy(*by).agg(F.max("a_total").alias("n_a"), F.max("b_total").alias("n_b"),
                               F.sum(F.col("ca") * (F.col("b_before") + 0.5 * F.col("cb"))).alias("u"),
                               F.sum(t * t * t - t).alias("cube"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    m = na + nb
    sd = F.sqrt(na * nb / 12 * ((m + 1) - F.col("cube") / (m * (m - 1))))
    dev = F.abs(F.col("u") - na * nb / 2)
    out = out.select(*by, "n_a", "n_b", "u", ratio(F.greatest(dev - 0.5, F.lit(0.0)), sd).alias("z"),
                     ratio(F.col("u") - na * nb / 2 - 0.5, sd).alias("z_greater"))
    if not tests:
        return out
    return out.withColumns({"p_value": p_value("normal", F.col("z")),
                            "p_greater": p_value("normal_greater", F.col("z_greater"))})


def kruskal_wallis(df: DataFrame, group: str, value: str, min_size: int = 3, tests: bool = True) -> DataFrame:
    """H with tie factor over all groups of at least `min_size` rows; one result row."""
    known = df.filter(F.col(value).isNotNull())
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_size).select(group)
    rows = known.join(sizes, group, "left_semi").groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    pos = value_positions(rows, [], value, weight=F.col("c"))
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    ties = pos.agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("c")).scalar()
    ranked = rows.join(pos.select(value, rank.alias("rank")), value)
    per = ranked.groupBy(group).agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    out = per.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("m"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    out = out.withColumn("cube", ties)
    m = F.col("m")
    h = (12 / (m * (m + 1)) * F.col("q") - 3 * (m + 1)) / (1 - F.col("cube") / (m * m * m - m))
    out = out.select("n_groups", m.cast("bigint").alias("n"), h.alias("h"))
    return out.withColumn("p_value", p_value("chi2", F.col("h"), F.col("n_groups") - 1)) if tests else out


def t_two_sample(df: DataFrame, keys: Sequence[str], value: str, first: Column, second: Column,
                 tests: bool = True) -> DataFrame:
    """Equal-variance t test between the rows matching `first` and `second`."""
    a, b = F.when(first, F.col(value)), F.when(second, F.col(value))
    m = df.groupBy(*keys).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"),
                              F.avg(b).alias("mean_b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / (na + nb - 2)
    m = m.withColumn("t", ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled * (1 / na + 1 / nb)))).drop("va", "vb")
    return m.withColumn("p_value", p_value("t", F.col("t"), na + nb - 2)) if tests else m


def t_one_sample(df: DataFrame, keys: Sequence[str], value: str, mean: float, tests: bool = True) -> DataFrame:
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("sd"))
    m = m.withColumn("t", ratio(F.col("mean_value") - mean, F.col("sd") / F.sqrt("n"))).drop("sd")
    return m.withColumn("p_value", p_value("t", F.col("t"), F.col("n") - 1)) if tests else m


def ks_distance(df: DataFrame, keys: Sequence[str], value: str, model: str, start: float = 0.0,
                both_sides: bool = True) -> DataFrame:
    """Largest distance between the empirical CDF and a model CDF, with the 95 % critical value 1.36/sqrt(n).

    model: `exponential` (rate from the mean above `start`) or `gutenberg_richter` (b from the mean above `start`
    with bin width 0.1, upper side only in the original definition: both_sides=False).
    """
    rows = df.filter(F.col(value) >= start)
    pos = value_positions(rows, keys, value)
    per_key = {"__mean": F.sum(F.col(value) * F.col("n")) / F.sum("n")}
    pos = with_group_stats(pos, keys, **per_key)
    excess = F.col(value) - start
    if model == "exponential":
        cdf = 1 - F.exp(-excess / (F.col("__mean") - start))
    else:
        b = math.log10(math.e) / (F.col("__mean") - start + 0.05)
        cdf = 1 - F.pow(F.lit(10.0), -b * excess)
    upper = F.abs((F.col("n_before") + F.col("n")) / F.col("n_total") - cdf)
    lower = F.abs(cdf - F.col("n_before") / F.col("n_total"))
    d = F.max(F.greatest(upper, lower) if both_sides else upper)
    return pos.groupBy(*keys).agg(F.max("n_total").alias("n"), d.alias("d")).withColumn(
        "critical", 1.36 / F.sqrt("n")).withColumn("passes", F.col("d") < F.col("critical"))


# ---- breaks, curves, model choice ----------------------------------------------------------------------------

def rate_comparison(df: DataFrame, keys: Sequence[str], x: str, y: str, cut: Column, min_side: int = 10,
                    tests: bool = True, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Slopes before and from `cut`, their difference and its z; keys with too few points on a side are left out."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    early, late = xs < cut, xs >= cut
    if lo is not None:
        early, late = early & (xs >= lo), late & (xs < hi)
    fit = df.groupBy(*keys).agg(*line_aggs(F.when(early, xs), F.when(early, ys), "pre_"),
                                *line_aggs(F.when(late, xs), F.when(late, ys), "post_"))
    fit = fit.filter((F.col("pre_n") >= min_side) & (F.col("post_n") >= min_side))
    fit = fit.withColumns({**line_columns("pre_"), **line_columns("post_")})
    diff = F.col("post_slope") - F.col("pre_slope")
    se = F.sqrt(F.col("pre_std_err") * F.col("pre_std_err") + F.col("post_std_err") * F.col("post_std_err"))
    out = fit.select(*keys, "pre_n", "post_n", "pre_slope", "post_slope", diff.alias("change"),
                     F.coalesce(ratio(diff, se), F.lit(0.0)).alias("z"))
    return out.withColumn("p_difference", p_value("normal", F.col("z"))) if tests else out


def breakpoint_scan(df: DataFrame, keys: Sequence[str], x: str, y: str, cuts: Sequence[float], min_side: int = 10,
                    window: float | None = None, tests: bool = True) -> DataFrame:
    """rate_comparison at every candidate cut; the cut with the largest |z| (smallest p) per key, first on ties."""
    tried = df.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    lo = F.col("cut") - window if window else None
    hi = F.col("cut") + window if window else None
    scan = rate_comparison(tried, [*keys, "cut"], x, y, F.col("cut"), min_side, False, lo, hi)
    best = scan.groupBy(*keys).agg(
        F.min_by(F.struct("cut", "pre_slope", "post_slope", "change", "z"), F.struct(-F.abs("z"), F.col("cut"))).alias("b"),
        F.count(F.lit(1)).alias("n_tested")).select(*keys, "n_tested", "b.*")
    return best.withColumn("p_difference", p_value("normal", F.col("z"))) if tests else best


def quadratic_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 10, tests: bool = True) -> DataFrame:
    """Centred y = a + b t + c t^2: acceleration 2c, its error, AIC/BIC against the line and RSS reduction.

    Centring needs the mean of x per key; the rest are second moments of (t, t^2, y) in one aggregate.
    """
    rows = with_group_stats(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, __mx=F.avg(F.col(x).cast("double")))
    t = F.col(x) - F.col("__mx")
    q, v = t * t, F.col(y).cast("double")
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx(v, t).alias("tt"), F.regr_sxx(v, q).alias("qq"), F.regr_syy(v, t).alias("yy"),
        F.regr_sxy(v, t).alias("ty"), F.regr_sxy(v, q).alias("qy"), F.regr_sxy(q, t).alias("tq"))
    return _quadratic_columns(m.filter(F.col("n") >= min_points), keys, tests)


def _quadratic_columns(m: DataFrame, keys: Sequence[str], tests: bool) -> DataFrame:
    tt, qq, yy, ty, qy, tq, n = (F.col(c) for c in ("tt", "qq", "yy", "ty", "qy", "tq", "n"))
    free = qq - ratio(tq * tq, tt)
    c = ratio(qy - ratio(tq * ty, tt), free)
    m = m.withColumns({"c": c, "free": free}).withColumn("b", ratio(ty - F.col("c") * tq, tt))
    m = m.withColumns({"rss_q": yy - F.col("b") * ty - F.col("c") * qy, "rss_l": yy - ratio(ty * ty, tt)})
    m = m.withColumn("se_c", F.sqrt(ratio(F.col("rss_q"), (n - 3) * F.col("free"))))

    def criteria(rss: Column, k: int) -> tuple[Column, Column]:
        minus2ll = n * (F.log(2 * math.pi * rss / n) + 1)
        return 2 * k + minus2ll, k * F.log(n) + minus2ll

    aic_q, bic_q = criteria(F.col("rss_q"), 3)
    aic_l, bic_l = criteria(F.col("rss_l"), 2)
    out = m.select(*keys, "n", (2 * F.col("c")).alias("acceleration"), (2 * F.col("se_c")).alias("acceleration_se"),
                   F.col("b").alias("slope_at_mean"), aic_q.alias("aic_quadratic"), aic_l.alias("aic_linear"),
                   bic_q.alias("bic_quadratic"), bic_l.alias("bic_linear"),
                   (100 * ratio(F.col("rss_l") - F.col("rss_q"), F.col("rss_l"))).alias("rss_reduction_pct"))
    if not tests:
        return out
    return out.withColumn("p_value", p_value("t", ratio(F.col("acceleration"), F.col("acceleration_se")), F.col("n") - 3))


def model_selection(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Linear, quadratic and ln(x + 1) fits: R2, RSS, AIC, BIC per model, differences to the best and a best flag."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    lx = F.log(xs + 1)
    rows = with_group_stats(df.filter(xs.isNotNull() & ys.isNotNull()), keys, __mx=F.avg(xs))
    t = xs - F.col("__mx")
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_syy(ys, t).alias("yy"), F.regr_sxx(ys, t).alias("tt"), F.regr_sxy(ys, t).alias("ty"),
        F.regr_sxx(ys, t * t).alias("qq"), F.regr_sxy(ys, t * t).alias("qy"), F.regr_sxy(t * t, t).alias("tq"),
        F.regr_sxx(ys, lx).alias("ll"), F.regr_sxy(ys, lx).alias("ly"))
    tt, qq, yy, ty, qy, tq = (F.col(c) for c in ("tt", "qq", "yy", "ty", "qy", "tq"))
    c = ratio(qy - ratio(tq * ty, tt), qq - ratio(tq * tq, tt))
    fits = {"linear": (yy - ratio(ty * ty, tt), 2), "quadratic": (yy - ratio(ty * ty, tt) - c * (qy - ratio(tq * ty, tt)), 3),
            "logarithmic": (yy - ratio(F.col("ly") * F.col("ly"), F.col("ll")), 2)}
    n = F.col("n")
    models = F.array(*[F.struct(
        F.lit(name).alias("model"), rss.alias("rss"), (1 - ratio(rss, yy)).alias("r2"),
        (n * F.log(rss / n) + 2 * k).alias("aic"), (n * F.log(rss / n) + k * F.log(n)).alias("bic"))
        for name, (rss, k) in fits.items()])
    out = m.select(*keys, "n", F.inline(models))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return out.withColumns({"delta_aic": F.col("aic") - F.min("aic").over(w), "delta_bic": F.col("bic") - F.min("bic").over(w)}) \
        .withColumn("best", F.col("delta_aic") == 0)


def decadal_rates(df: DataFrame, keys: Sequence[str], x: str, y: str, span: int = 10, min_points: int = 7,
                  tests: bool = True) -> DataFrame:
    """Line per non-overlapping block of `span`; the first block starts after the first x of the key."""
    rows = with_group_stats(df, keys, __first=F.min(x))
    block = (F.floor(F.col(x) / span) * span).cast("bigint")
    rows = rows.withColumn("block", block).filter(F.col("block") > F.col("__first"))
    return ols_trend(rows, [*keys, "block"], x, y, min_points=min_points, tests=tests).filter(F.col("n") >= min_points)


# ---- event catalogues ----------------------------------------------------------------------------------------

def completeness(df: DataFrame, keys: Sequence[str], mag: str, correction: float = 0.2, bin_width: float = 0.1) -> DataFrame:
    """Magnitude bin with most events (the lower on ties) plus the correction."""
    per = round(1 / bin_width)
    bins = df.filter(F.col(mag).isNotNull()).groupBy(*keys, F.floor(F.col(mag) * per).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    top = F.min_by("b", F.struct(-F.col("c"), F.col("b")))
    return bins.groupBy(*keys).agg(F.round(top / per + correction, 1).alias("mc"), F.sum("c").alias("n_total"))


def b_value(df: DataFrame, keys: Sequence[str], mag: str, min_events: int = 20, bin_width: float = 0.1) -> DataFrame:
    """Aki maximum-likelihood b above the completeness magnitude, its uncertainty and a."""
    mc = completeness(df, keys, mag, bin_width=bin_width).filter(F.col("n_total") >= min_events)
    above = join_keys(df, mc, list(keys)).filter(F.col(mag) >= F.col("mc"))
    m = above.groupBy(*keys).agg(F.max("mc").alias("mc"), F.max("n_total").alias("n_total"), F.count(F.lit(1)).alias("n"),
                                 F.avg(mag).alias("mean_mag"), F.var_samp(mag).alias("v"), F.max(mag).alias("max_mag"))
    b = ratio(F.lit(math.log10(math.e)), F.col("mean_mag") - F.col("mc") + bin_width / 2)
    m = m.filter(F.col("n") >= 10).withColumn("b", b)
    return m.select(*keys, "mc", "n_total", "n", "mean_mag", "max_mag", "b",
                    (2.30 * F.col("b") * F.col("b") * F.sqrt(F.col("v") / F.col("n"))).alias("b_uncertainty"),
                    (F.log10("n") + F.col("b") * F.col("mc")).alias("a"))


def window_ids(position: Column, width: int, step: int) -> Column:
    """Starts (multiples of `step`, not negative) of all windows [s, s + width) that hold an integer position."""
    first = F.greatest(F.lit(0), F.ceil((position - width + 1) / step))
    last = F.floor(position / step)
    return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda i: i * step)


def poisson_trend(counts: DataFrame, keys: Sequence[str], x: str, n: str, scale: float = 10.0, steps: int = 25) -> DataFrame:
    """Log-linear rate exp(a + b x) by Newton steps, likelihood ratio against a constant rate, percent per `scale`.

    Takes one count per period and key, so a key is as long as the calendar and fits one row as an array, over which
    each step sums the score and the information.
    """
    one = counts.groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(n).cast("double").alias("k"))).alias("s"),
                                    F.avg(x).alias("mx"), F.log(F.greatest(F.avg(n), F.lit(1e-12))).alias("base"), F.count(F.lit(1)).cast("double").alias("n_periods"))
    one = one.withColumn("s", F.transform("s", lambda p: F.struct((p["x"] - F.col("mx")).alias("t"), p["k"].alias("k"))))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("g0", "g1", "h00", "h01", "h11")])

    def rate(a: Column, b: Column, t: Column) -> Column:
        return F.exp(F.least(F.greatest(a + b * t, F.lit(-700.0)), F.lit(700.0)))

    def moved(c: Column) -> Column:
        at = F.transform("s", lambda p: F.struct(p["t"].alias("t"), p["k"].alias("k"), rate(c["a"], c["b"], p["t"]).alias("mu")))

        def add(m: Column, p: Column) -> Column:
            off, tm = p["k"] - p["mu"], p["t"] * p["mu"]
            return F.struct((m["g0"] + off).alias("g0"), (m["g1"] + p["t"] * off).alias("g1"), (m["h00"] + p["mu"]).alias("h00"),
                            (m["h01"] + tm).alias("h01"), (m["h11"] + p["t"] * tm).alias("h11"))

        def solve(m: Column) -> Column:
            det = m["h00"] * m["h11"] - m["h01"] * m["h01"]
            new = F.struct((c["a"] + (m["g0"] * m["h11"] - m["g1"] * m["h01"]) / det).alias("a"), (c["b"] + (m["g1"] * m["h00"] - m["g0"] * m["h01"]) / det).alias("b"))
            return F.when(det > 0, new).otherwise(c)

        return F.aggregate(at, zero, add, solve)

    start = F.struct(F.col("base").alias("a"), F.lit(0.0).alias("b"))
    fit = one.withColumn("c", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda c, _: moved(c)))
    gain = F.aggregate("s", F.lit(0.0), lambda m, p: m + p["k"] * (F.col("c.a") + F.col("c.b") * p["t"] - F.col("base")) - rate(F.col("c.a"), F.col("c.b"), p["t"]) + F.exp("base"))
    out = fit.select(*keys, "n_periods", F.col("c.b").alias("rate"), F.greatest(2 * gain, F.lit(0.0)).alias("lr"))
    return out.withColumns({"pct_per_scale": (F.exp(F.col("rate") * scale) - 1) * 100,
                            "p_value": p_value("chi2", F.col("lr"), F.lit(1.0))})


def omori_fit(times: DataFrame, keys: Sequence[str], t: str, min_events: int = 15, refine: bool = True,
              c_grid: Sequence[float] | None = None, p_grid: Sequence[float] | None = None,
              attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """K, c, p of the decay K/(t + c)^p by a profiled likelihood grid, log-likelihood and AIC.

    For fixed (c, p) the best K is N over the integral, so the data enter only through sum(log(t + c)): one aggregate column
    per c of a fixed grid, then the p grid is column algebra on one row a key. Times are summed up where they arise and never
    shuffled themselves. `refine` repeats both around the best grid point, which is looked up by key, or by `attach`: it gives
    the times of the keys in a table, with its other columns, where these can be joined before the times arise.
    """
    c_grid = list(c_grid or np.round(np.logspace(-3, 1, 25), 6))
    p_grid = list(p_grid or np.round(np.arange(0.4, 2.61, 0.05), 2))
    rows = times.filter(F.col(t) > 0).select(*keys, t)
    first = _omori_grid(rows, keys, t, min_events, [F.lit(float(c)) for c in c_grid], F.array(*[F.lit(float(p)) for p in p_grid]))
    if not refine:
        return first
    # written, so that its size is known and the rows need not move to meet it
    best = stored(first.select(*keys, F.col("c").alias("__c"), F.col("p").alias("__p")))
    near = attach(best).filter(F.col(t) > 0) if attach else join_keys(rows, best, list(keys))
    fine_c = [F.col("__c") * float(1.04 ** i) for i in range(-10, 11)]
    fine_p = F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda i: F.col("__p") + i * 0.005)
    return _omori_grid(near, keys, t, min_events, fine_c, fine_p, ["__c", "__p"])


def _omori_grid(rows: DataFrame, keys: Sequence[str], t: str, min_events: int, cs: Sequence[Column], ps: Column, around: Sequence[str] = ()) -> DataFrame:
    """Best point of the grid per key; `around` names columns that are the same for all rows of a key."""
    logs = [F.sum(F.log(F.col(t) + c)).alias(f"__s{i}") for i, c in enumerate(cs)]
    sums = rows.groupBy(*keys, *around).agg(F.count(F.lit(1)).alias("n"), F.max(t).alias("t_end"), *logs).filter(F.col("n") >= min_events)
    points = F.array(*[F.struct(c.alias("c"), F.col(f"__s{i}").alias("slog")) for i, c in enumerate(cs)])
    per_c = sums.select(*keys, "n", "t_end", ps.alias("ps"), F.inline(points))
    grid = per_c.select(*keys, "c", "n", "t_end", "slog", F.explode("ps").alias("p"))
    c, p, end = F.col("c"), F.col("p"), F.col("t_end")
    q = 1 - p
    integral = F.when(F.abs(q) < 1e-9, F.log((end + c) / c)).otherwise(
        (F.pow(end + c, q) - F.pow(c, q)) / F.when(F.abs(q) < 1e-9, 1.0).otherwise(q))
    k = F.col("n") / integral
    ll = F.col("n") * F.log(k) - p * F.col("slog") - F.col("n")
    return grid.withColumns({"rate_k": k, "log_likelihood": ll}).groupBy(*keys).agg(
        F.max_by(F.struct("n", "rate_k", "c", "p", "log_likelihood"), F.struct(F.round("log_likelihood", 8), -p, -c)).alias("b")) \
        .select(*keys, "b.*").withColumn("aic", 6 - 2 * F.col("log_likelihood"))


#: Stretches of a sequence whose times are counted before they are ranked.
ERROR_BINS = 256


def omori_errors(times: DataFrame, fits: DataFrame, keys: Sequence[str], t: str, attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Distance between the observed and the fitted cumulative counts of each sequence (KS form).

    Times are counted where they arise, by stretches of their sequence: what is shuffled is a row a key and stretch. Counts and
    first and last times bound the distance within a stretch from above, and are distances themselves at its ends. Only
    times of stretches whose bound exceeds the largest of these are formed again and ranked. `attach` is that of `omori_fit`.
    """
    keys = list(keys)
    attach = attach or (lambda known: join_keys(times.select(*keys, t), known, keys))

    def mass(end: Column) -> Column:
        q = 1 - F.col("p")
        near = F.abs(q) < 1e-9
        return F.when(near, F.log((end + F.col("c")) / F.col("c"))).otherwise(
            (F.pow(end + F.col("c"), q) - F.pow(F.col("c"), q)) / F.when(near, 1.0).otherwise(q))

    def cdf(x: Column) -> Column:
        return mass(x) / mass(F.col("t_end"))

    curve, total = ["c", "p", "t_end", "n_total"], F.col("n_total")
    fitted = stored(fits.select(*keys, "c", "p"))
    spans = attach(fitted).filter(F.col(t) > 0).groupBy(*keys, "c", "p").agg(F.max(t).alias("t_end"), F.count(F.lit(1)).alias("n_total"))
    spans = stored(spans)
    stretch = F.floor(F.sqrt(F.col(t) / F.col("t_end")) * ERROR_BINS)
    counts = attach(spans).filter(F.col(t) > 0).groupBy(*keys, *curve, stretch.alias("__bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    # at most ERROR_BINS + 1 rows a key
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    low, high = F.col("n_before") / total, (F.col("n_before") + F.col("n")) / total
    ends = F.greatest(F.abs(cdf(F.col("first")) - low), F.abs(high - cdf(F.col("last"))))
    bound = F.greatest(high - cdf(F.col("first")), cdf(F.col("last")) - low) + 1e-9
    bounded = counts.withColumns({"__d": ends, "__most": bound})
    open_ = F.when(F.col("first") < F.col("last"), F.struct("__most", F.col("__bin").alias("bin"), "n_before"))
    per_key = bounded.groupBy(*keys, *curve).agg(F.max("__d").alias("__d"), F.collect_list(open_).alias("__open"))
    per_key = stored(per_key.withColumn("__open", F.map_from_entries(F.transform(
        F.filter("__open", lambda b: b["__most"] >= F.col("__d")), lambda b: F.struct(b["bin"], b["n_before"])))))
    inside = attach(per_key.filter(F.size("__open") > 0).select(*keys, *curve, "__open")).filter(F.col(t) > 0).withColumn("n_before", F.try_element_at("__open", stretch))
    values = inside.filter(F.col("n_before").isNotNull()).groupBy(*keys, *curve, "n_before", t).agg(F.count(F.lit(1)).alias("n"))
    smaller = Window.partitionBy(*keys, "n_before").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("n_before", F.col("n_before") + F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    d = F.greatest(F.abs((F.col("n_before") + F.col("n")) / total - cdf(F.col(t))), F.abs(cdf(F.col(t)) - F.col("n_before") / total))
    exact = values.groupBy(*keys).agg(F.max(d).alias("__exact"))
    return join_keys(per_key, exact, keys, "left").select(*keys, total.alias("n"), F.greatest("__d", "__exact").alias("ks"))


def baths_law(pairs: DataFrame, mains: DataFrame, main_id: str, main_mag: str, mag: str) -> DataFrame:
    """Main magnitude minus the largest following magnitude per main event."""
    top = pairs.groupBy(main_id).agg(F.max(mag).alias("largest"), F.count(F.lit(1)).alias("n_after"))
    return join_keys(mains, top, [main_id]).withColumn("gap", F.col(main_mag) - F.col("largest"))


# ---- densities and valleys -----------------------------------------------------------------------------------

#: Values that a task lays against the grid at once.
KDE_BLOCK = 256


def weighted_kde(df: DataFrame, keys: Sequence[str], value: str, weight: Column, bandwidth: float, low: float,
                 high: float, points: int = 1000) -> DataFrame:
    """Gaussian density on a fixed grid in log10 units.

    Equal values are combined first. A task sums its distinct values over the grid as matrix blocks of bounded size and hands on
    one row a key and grid point, so what is shuffled does not grow with the values.
    """
    step = (high - low) / (points - 1)
    mass = df.filter(F.col(value) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    shares = with_group_stats(mass, keys, __total=F.sum("w")).select(
        *keys, F.log10(F.col(value)).cast("double").alias("__lv"), (F.col("w") / F.col("__total")).cast("double").alias("__share"))
    at, scale, keys = low + np.arange(points) * step, bandwidth * math.sqrt(2 * math.pi), list(keys)

    def sums(batches):
        held = {}
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]
            lv, share = pdf["__lv"].to_numpy(), pdf["__share"].to_numpy()
            for key, rows in groups:
                if not len(rows):
                    continue
                first, total = held.setdefault(str(key), (pdf[keys].iloc[rows[:1]], np.zeros(points)))
                rows = rows[np.argsort(lv[rows], kind="stable")]
                for i in range(0, len(rows), KDE_BLOCK):
                    block = rows[i:i + KDE_BLOCK]
                    # 39 bandwidths away exp(-z * z / 2) is 0 in double precision
                    a, b = np.searchsorted(at, [lv[block[0]] - 39 * bandwidth, lv[block[-1]] + 39 * bandwidth])
                    z = (lv[block, None] - at[a:b]) / bandwidth
                    z *= z
                    z *= -0.5
                    total[a:b] += (share[block, None] * np.exp(z, out=z)).sum(axis=0)
        for first, total in held.values():
            out = first.iloc[np.zeros(points, dtype=int)].reset_index(drop=True)
            yield out.assign(g=np.arange(points, dtype=np.int32), part=total / scale)

    kinds = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField("g", T.IntegerType()), T.StructField("part", T.DoubleType())])
    hits = shares.mapInPandas(sums, kinds).groupBy(*keys, "g").agg(F.sum("part").alias("density"))
    every = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")
    grid = mass.select(*keys).distinct().select(*keys, every) if keys else df.sparkSession.range(1).select(every)
    return join_keys(grid, hits, [*keys, "g"], "left").select(
        *keys, "g", F.coalesce("density", F.lit(0.0)).alias("density"), F.pow(F.lit(10.0), low + F.col("g") * step).alias("x"))


def valley_detect(curve: DataFrame, keys: Sequence[str], grid: str = "g", x: str = "x", density: str = "density",
                  reach: int = 5, min_gap: float = 0.08) -> DataFrame:
    """Two tallest peaks more than `min_gap` apart in log10(x), the lowest point between them, its depth against their
    mean and its width at half depth (log10).

    A peak exceeds every value within `reach` grid points; with fewer than two such peaks three points are enough.
    Where the lowest density stretches over several grid points, the valley is the middle of its longest run: between
    two masses far apart the density is 0 in double precision, and its logarithm is lowest half way.
    Curves have grid length, so windows are bounded.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w, d = by.orderBy(grid), F.col(density)

    def tops(k: int) -> Column:
        return (d > F.max(density).over(w.rowsBetween(-k, -1))) & (d > F.max(density).over(w.rowsBetween(1, k)))

    marked = curve.withColumns({"__wide": F.coalesce(tops(reach), F.lit(False)), "__near": F.coalesce(tops(3), F.lit(False))})
    marked = marked.withColumn("__enough", F.count_if("__wide").over(by) >= 2)
    peaks = marked.filter(F.when(F.col("__enough"), F.col("__wide")).otherwise(F.col("__near"))).select(*keys, grid, F.log10(x).alias("__lx"), x, density)
    tallest = F.struct(density, grid)
    peaks = peaks.withColumn("__p1", F.max_by(F.struct(grid, "__lx", x, density), tallest).over(by))
    apart = F.abs(F.col("__lx") - F.col("__p1.__lx")) > min_gap
    two = peaks.groupBy(*keys).agg(F.any_value("__p1").alias("a"), F.max_by(F.struct(grid, "__lx", x, density), F.when(apart, tallest)).alias("b")).filter(F.col("b").isNotNull())
    first = F.col(f"a.{grid}") < F.col(f"b.{grid}")
    lo, hi = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    ends = two.select(*keys, lo[grid].alias("g1"), hi[grid].alias("g2"), lo[x].alias("peak_low"), hi[x].alias("peak_high"),
                      lo[density].alias("low_density"), hi[density].alias("high_density"))
    inner = join_keys(curve, ends, keys) if keys else curve.withColumn("__e", ends.agg(F.first(F.struct("*"))).scalar()).select("*", "__e.*")
    inner = inner.filter(F.col(grid).between(F.col("g1"), F.col("g2")))
    names = ["peak_low", "peak_high", "low_density", "high_density"]
    inner = inner.withColumn("__floor", d == F.min(density).over(by))
    flat = Window.partitionBy(*keys, "__floor")
    inner = inner.withColumn("__run", F.when(F.col("__floor"), F.col(grid) - F.row_number().over(flat.orderBy(grid))))
    run = Window.partitionBy(*keys, "__floor", "__run")
    inner = inner.withColumns({"__long": F.when(F.col("__floor"), F.count(F.lit(1)).over(run)), "__from": F.min(grid).over(run)})
    off = F.abs(2 * (F.col(grid) - F.col("__from")) - F.col("__long") + 1)
    inner = inner.withColumn("__v", F.min_by(F.struct(grid, x, density), F.when(F.col("__floor"), F.struct(-F.col("__long"), off, grid))).over(by))
    mean = (F.col("low_density") + F.col("high_density")) / 2
    vd = F.col(f"__v.{density}")
    above = d >= vd + (mean - vd) / 2
    left = F.max(F.when(above & (F.col(grid) <= F.col(f"__v.{grid}")), F.log10(x)))
    right = F.min(F.when(above & (F.col(grid) >= F.col(f"__v.{grid}")), F.log10(x)))
    out = inner.groupBy(*keys, *names).agg(F.any_value("__v").alias("v"), (right - left).alias("width_log"))
    return out.select(*keys, *names, F.col(f"v.{x}").alias("valley"), F.col(f"v.{density}").alias("valley_density"),
                      (1 - ratio(F.col(f"v.{density}"), mean)).alias("depth"), "width_log")


def weighted_line_fit(df: DataFrame, keys: Sequence[str], x: Column, y: Column, sigma: Column) -> DataFrame:
    """Line with 1/sigma^2 weights: slope, intercept, their errors and chi-square."""
    w = 1 / (sigma * sigma)
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
                              F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    s, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("s", "sx", "sy", "sxx", "sxy", "syy"))
    delta = s * sxx - sx * sx
    slope, intercept = ratio(s * sxy - sx * sy, delta), ratio(sxx * sy - sx * sxy, delta)
    out = m.withColumns({"slope": slope, "intercept": intercept, "slope_se": F.sqrt(ratio(s, delta)), "intercept_se": F.sqrt(ratio(sxx, delta))})
    chi2 = syy - F.col("intercept") * sy - F.col("slope") * sxy
    return out.select(*keys, "n", "slope", "intercept", "slope_se", "intercept_se", chi2.alias("chi2"))


# ---- scores and growth ---------------------------------------------------------------------------------------

def skill_scores(df: DataFrame, keys: Sequence[str], observed: Column, model: Column, low: Column | None = None,
                 high: Column | None = None) -> DataFrame:
    """Bias, RMSE, MAE, share of observations inside [low, high], counts above and below the model."""
    diff = model - observed
    aggs = [F.count(diff).alias("n"), F.avg(diff).alias("bias"), F.sqrt(F.avg(diff * diff)).alias("rmse"),
            F.avg(F.abs(diff)).alias("mae"), F.count_if(observed > model).alias("n_above"), F.count_if(observed < model).alias("n_below")]
    if low is not None:
        aggs.append((100.0 * F.count_if(observed.between(low, high)) / F.count(diff)).alias("pct_inside"))
    return df.groupBy(*keys).agg(*aggs)


def growth_rate(first: Column, last: Column, years: float) -> Column:
    """Compound yearly growth, NULL when either end is not positive."""
    return F.when((first > 0) & (last > 0), F.pow(last / F.when(first > 0, first), F.lit(1.0 / years)) - 1)


def growth_metrics(df: DataFrame, keys: Sequence[str], year: str, value: str, first: int, middle: int, last: int) -> DataFrame:
    """Growth between three years: rate, difference, ratio, doubling time, rates before/after the middle, change."""
    at = {n: F.sum(F.when(F.col(year) == y, F.col(value))) for n, y in (("v0", first), ("v1", middle), ("v2", last))}
    m = df.groupBy(*keys).agg(*[c.alias(n) for n, c in at.items()])
    g = growth_rate(F.col("v0"), F.col("v2"), last - first)
    m = m.withColumns({"cagr": g, "growth": F.col("v2") - F.col("v0"), "growth_ratio": ratio(F.col("v2"), F.col("v0")),
                       "cagr_before": growth_rate(F.col("v0"), F.col("v1"), middle - first),
                       "cagr_after": growth_rate(F.col("v1"), F.col("v2"), last - middle)})
    return m.withColumns({"doubling_time": F.when(F.col("cagr") > 0, math.log(2) / F.log(1 + F.col("cagr"))),
                          "acceleration": F.col("cagr_after") - F.col("cagr_before")})


def annualised(df: DataFrame, keys: Sequence[str], year: str, months: str, total: str) -> DataFrame:
    """Yearly totals; a year with fewer than 12 months is scaled up and cut to an integer."""
    scaled = F.floor(F.col(total) * 12 / F.col(months))
    return df.withColumn("annual", F.when(F.col(months) < 12, scaled).otherwise(F.floor(F.col(total))).cast("bigint"))


def revealed_advantage(df: DataFrame, place: str, topic: str, count: str | None = None, min_count: int = 1) -> DataFrame:
    """(topic share in place) / (topic share overall)."""
    n = F.sum(count) if count else F.count(F.lit(1))
    cells = df.groupBy(place, topic).agg(n.cast("double").alias("n"))
    by_place = cells.groupBy(place).agg(F.sum("n").alias("n_place"))
    by_topic = cells.groupBy(topic).agg(F.sum("n").alias("n_topic"))
    whole = cells.agg(F.sum("n")).scalar()
    out = join_keys(join_keys(cells, by_place, [place]), by_topic, [topic]).withColumn("__all", whole)
    rca = (F.col("n") / F.col("n_place")) / (F.col("n_topic") / F.col("__all"))
    return out.filter(F.col("n") >= min_count).select(place, topic, "n", rca.alias("rca"))


def surge_ratio(df: DataFrame, keys: Sequence[str], year: str, value: str, base: tuple[int, int], peak: tuple[int, int],
                min_base: float, min_peak: float, min_ratio: float = 1.5) -> DataFrame:
    """Mean over the peak years against the base years, with minimum sizes and ratio."""
    b = F.avg(F.when(F.col(year).between(*base), F.col(value)))
    p = F.avg(F.when(F.col(year).between(*peak), F.col(value)))
    m = df.groupBy(*keys).agg(b.alias("base_mean"), p.alias("peak_mean"))
    m = m.withColumn("surge", ratio(F.col("peak_mean"), F.col("base_mean")))
    return m.filter((F.col("base_mean") >= min_base) & (F.col("peak_mean") >= min_peak) & (F.col("surge") >= min_ratio))


def period_attention(df: DataFrame, keys: Sequence[str], month: str, value: str, periods: dict[str, tuple[int, int]],
                     min_pre: float = 0.0) -> DataFrame:
    """Means of the named month ranges, peak month, dividend, retention and half-life in months.

    `periods` holds pre, peak, transition and post as inclusive month numbers; means skip zero months and the peak is
    sought in peak and transition. The half-life is the first later month at or below half the excess over the pre
    mean. Series are monthly without holes, hence bounded; keys whose pre mean is below `min_pre` are left out.
    """
    used = F.col(value) > 0
    m = {n: F.coalesce(F.avg(F.when(used & F.col(month).between(lo, hi), F.col(value))), F.lit(0.0))
         for n, (lo, hi) in periods.items()}
    in_peak = F.col(month).between(*periods["peak"]) | F.col(month).between(*periods["transition"])
    top = F.min_by(F.struct(F.col(month).alias("mi"), F.col(value).cast("double").alias("v")),
                   F.when(in_peak, F.struct(-F.col(value), F.col(month))))
    stats = df.groupBy(*keys).agg(*[c.alias(f"{n}_mean") for n, c in m.items()], top.alias("__top"))
    stats = stats.filter(F.col("pre_mean") >= min_pre).withColumns(
        {"peak_month": F.col("__top.mi"), "peak_value": F.col("__top.v")}).drop("__top")
    pre, post, peak = F.col("pre_mean"), F.col("post_mean"), F.col("peak_mean")
    stats = stats.withColumns({"peak_ratio": ratio(F.col("peak_value"), pre), "dividend_pct": 100 * ratio(post - pre, pre),
                               "retention": F.coalesce(ratio(post, peak), F.lit(0.0))})
    after = join_keys(df.select(*keys, month, value), stats.select(*keys, "peak_month", "peak_value", "pre_mean"), list(keys))
    excess = F.col("peak_value") - F.col("pre_mean")
    fell = after.filter((F.col(month) > F.col("peak_month")) & (excess > 0) & (F.col(value) <= F.col("pre_mean") + excess * 0.5))
    half = fell.groupBy(*keys).agg(F.min(F.col(month) - F.col("peak_month")).alias("half_life"))
    return join_keys(stats, half, list(keys), "left")


def composite_index(*parts: Column) -> Column:
    """Sum of signed parts over the sum of their sizes, 0 without any."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    size = sum((F.abs(F.coalesce(p, F.lit(0.0))) for p in parts), F.lit(0.0))
    return F.coalesce(ratio(total, size), F.lit(0.0))


def harmonic_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, periods: Sequence[float], tests: bool = True) -> DataFrame:
    """Best mean + sinusoid over a grid of periods: amplitude, phase, R2 and F against the mean.

    Each period is a linear fit, so every key and period needs one set of moment sums. Series are calendar-bounded.
    """
    grid = F.array(*[F.lit(float(p)) for p in periods])
    rows = df.filter(F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                                                 F.explode(grid).alias("period"))
    a = 2 * math.pi * F.col("x") / F.col("period")
    c, s, v = F.cos(a), F.sin(a), F.col("y")
    m = rows.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx(v, c).alias("cc"), F.regr_sxx(v, s).alias("ss"), F.regr_sxy(s, c).alias("cs"),
        F.regr_sxy(v, c).alias("cy"), F.regr_sxy(v, s).alias("sy"), F.regr_syy(v, c).alias("yy"))
    cc, ss, cs, cy, sy, yy = (F.col(k) for k in ("cc", "ss", "cs", "cy", "sy", "yy"))
    det = cc * ss - cs * cs
    m = m.withColumns({"a": ratio(cy * ss - sy * cs, det), "b": ratio(sy * cc - cy * cs, det)})
    m = m.withColumn("rss", yy - F.col("a") * cy - F.col("b") * sy)
    best = m.groupBy(*keys).agg(F.min_by(F.struct("period", "n", "a", "b", "rss", "yy"), F.struct("rss", "period")).alias("f")).select(*keys, "f.*")
    f_stat = ratio((F.col("yy") - F.col("rss")) / 2, F.col("rss") / (F.col("n") - 3))
    out = best.select(*keys, "n", "period", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("amplitude"),
                      F.atan2(-F.col("b"), F.col("a")).alias("phase"), (1 - ratio(F.col("rss"), F.col("yy"))).alias("r2"), f_stat.alias("f_stat"))
    return out.withColumn("p_value", p_value("f", F.col("f_stat"), F.lit(2.0), F.col("n") - 3)) if tests else out

"""Sorting, limits, rankings and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.split import row_positions, running_sums


def top_n(df: DataFrame, metric: str, tie: str, n: int, ascending: bool = False) -> DataFrame:
    """First n rows by metric, missing metric last, ties by `tie`. Every task keeps n rows before the merge."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(order, tie).limit(n)


def rank_change(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Positions by two metrics (largest first, ties by key) and how many places the key moved up."""
    then = row_positions(df, [], before, key, True, "rank_before")
    now = row_positions(then, [], after, key, True, "rank_after")
    return now.withColumn("rank_change", F.col("rank_before") - F.col("rank_after"))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each group. The row_number filter is pushed below the shuffle as a group limit, so a hot
    group sends at most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def arg_row(df: DataFrame, keys: Sequence[str], metric: str, tie: str, columns: Sequence[str], largest: bool = True) -> DataFrame:
    """Columns of the row with the largest or smallest metric per key; the smaller tie value wins."""
    m = -F.col(metric) if largest else F.col(metric)
    return df.groupBy(*keys).agg(F.min_by(F.struct(metric, tie, *columns), F.struct(m, F.col(tie))).alias("r")).select(*keys, "r.*")


def interleave(df: DataFrame, group: str, key: str, group_order: Sequence[str]) -> DataFrame:
    """Round-robin order over groups: `turn` counts within the group by key, groups follow the given order."""
    numbered = running_sums(df, [group], key, {"turn": F.lit(1)}, totals=False).withColumnRenamed("turn_before", "turn")
    place = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.col(group))
    return numbered.withColumn("place", F.when(place == 0, len(group_order) + 1).otherwise(place).cast("int"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def remaining(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done, list(keys), "left_anti")


def merged_methods(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of id sets with the sorted list of the methods that found each id."""
    tagged = None
    for name, part in parts.items():
        one = part.select(key).distinct().withColumn("method", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(key).agg(F.array_sort(F.collect_set("method")).alias("methods"))

"""Small constant tables as array literals: a range lookup against them is a projection, not a join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_array(rows: Sequence[Sequence], names: Sequence[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def matching_rows(rows: Sequence[Sequence], names: Sequence[str], cond: Callable[[Column], Column]) -> Column:
    """The constant rows that satisfy `cond(row)` for the current record, in list order."""
    return F.filter(rows_array(rows, names), cond)


def explode_matches(df: DataFrame, rows: Sequence[Sequence], names: Sequence[str],
                    cond: Callable[[Column], Column]) -> DataFrame:
    """Range join with a fixed list: one output row per matching constant row, whose fields become columns."""
    return df.select("*", F.inline(matching_rows(rows, names, cond)))


def first_match(rows: Sequence[Sequence], names: Sequence[str], cond: Callable[[Column], Column],
                field: str, default: str | None = None) -> Column:
    """The `field` of the first matching constant row, else `default`."""
    hit = F.get(matching_rows(rows, names, cond), F.lit(0))[field]
    return F.coalesce(hit, F.lit(default)) if default is not None else hit


def ladder(x: Column, steps: Sequence[tuple[float, object]], default: object) -> Column:
    """CASE x >= bound THEN result ... ELSE default, tested in the given order."""
    out = None
    for bound, result in steps:
        out = F.when(x >= bound, F.lit(result)) if out is None else out.when(x >= bound, F.lit(result))
    return out.otherwise(F.lit(default))


def ranges(x: Column, steps: Sequence[tuple[float, float, str]], default: str | None = None) -> Column:
    """The label of the half-open range [lo, hi) that holds x."""
    out = None
    for lo, hi, label in steps:
        hit = (x >= lo) & (x < hi)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))

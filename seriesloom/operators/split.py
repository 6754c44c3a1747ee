"""Ordered computations that stay distributed when one key holds a large part of the rows.

A plain ``Window.partitionBy(key).orderBy(x)`` sends a whole key to one task. The helpers here cut the order axis
into global quantile segments first, work inside (key, segment) and carry a one-row summary per segment forward.
A segment holds about 1/n of *all* rows, so no (key, segment) group can be much larger than that, except where an order
value that itself fills several segments has no tie column to cut it by. Summaries hold at most 3n rows per key. Series already aggregated to calendar periods do not need this: their length is bounded by
the calendar, and the windowed operators use plain windows on them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import segments

SEG = "__seg"


def with_segment(df: DataFrame, order: str, n: int | None = None, tie: str | None = None, descending: bool = False,
                 nulls_last: bool = False) -> DataFrame:
    """Add the range segment of `order`: the number of global quantile bounds strictly below it (0 .. n-1).

    The bounds come from one `percentile_approx` inside a scalar subquery; the lookup is a binary search in
    log2(n) steps over the bounds array. Bounds only set the balance, never the result, so they may be rough. Without
    `tie`, NULL order values fall into segment 0.

    With `tie`, rows are segmented by (`order`, `tie`): a value that fills m > 1 bounds is cut into m segments at global
    quantiles of `tie`, and so are NULLs, into n. Segments then number at most 3n and ascend in the wanted direction of
    `order` (NULLs at the end asked for), ties always ascending.
    """
    n = n or segments(df.sparkSession)
    if tie is None:
        return _ranged(df, order, n, SEG)
    out = _ranged(_ranged(df, order, n, SEG, "__filled"), tie, n, "__sub")
    missing = F.col(order).isNull()
    parts = F.when(missing, n).otherwise(F.col("__filled"))
    place = F.when(parts > 1, F.floor(F.col("__sub") * parts / n)).otherwise(0)
    side = F.when(F.lit(descending), F.when(parts > 1, place).otherwise(n)).otherwise(F.when(parts > 1, place + 1).otherwise(0))
    range_ = F.when(missing, n + 1 if nulls_last else -n - 1).otherwise(-F.col(SEG) if descending else F.col(SEG))
    return out.withColumn(SEG, range_.cast("bigint") * (2 * n + 2) + side).drop("__filled", "__sub")


def _ranged(df: DataFrame, order: str, n: int, name: str, filled: str | None = None) -> DataFrame:
    """Number of quantile bounds below `order`; `filled` names an optional count of the bounds equal to it."""
    numeric = _numeric(df, order)
    probs = [i / n for i in range(1, n)]
    bounds = df.select(numeric.alias("o")).agg(
        F.percentile_approx("o", probs, max(1000, 4 * n)).alias("b")).scalar()
    out = df.withColumns({"__bounds": bounds, "__order": numeric})
    out = out.withColumn(name, _climb(n, F.lit(0), lambda at: F.get("__bounds", at) < F.col("__order")))
    if filled and _kept_apart(df, order):
        # Rows are cut by `tie` only where all of them have one value, which a rough number of a text does not prove.
        sure = F.abs("__order") < float(1 << 53)
        reach = _climb(n, F.col(name), lambda at: (F.get("__bounds", at) == F.col("__order")) & sure)
        out = out.withColumn(filled, reach - F.col(name))
    elif filled:
        out = out.withColumn(filled, F.lit(0))
    return out.drop("__bounds", "__order")


def _climb(n: int, start: Column, holds: Callable[[Column], Column]) -> Column:
    """First place from `start` on where `holds` fails, by binary search in log2(n) steps.

    It is one expression whatever n is: a chain of columns, each naming the one before twice, doubles the plan's
    constraints with every step.
    """
    steps = F.array(*[F.lit(1 << power) for power in reversed(range(n.bit_length() - 1))])
    return F.aggregate(steps, start, lambda at, step: at + F.when(holds(at + step - 1), step).otherwise(0))


def _kept_apart(df: DataFrame, name: str) -> bool:
    """Whether `_numeric` gives different values, below 2 ** 53, different numbers."""
    kind = df.schema[name].dataType
    return kind.typeName() not in ("string", "binary", "char", "varchar", "decimal") or getattr(kind, "precision", 99) <= 15


def _numeric(df: DataFrame, name: str) -> Column:
    """A double that never falls as the value rises. Texts give their first six bytes, so texts that share these also
    share a segment."""
    kind = df.schema[name].dataType.typeName()
    value = F.col(f"`{name}`")
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if kind in ("string", "binary", "char", "varchar"):
        head = F.hex(F.substring(value.cast("binary"), 1, 6))
        return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
    if kind in ("struct", "array", "map"):
        return F.lit(0.0)
    return value.cast("double")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps the key columns of the left side once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column],
                 totals: bool = True, n: int | None = None) -> DataFrame:
    """Add, per key and in `order`, the sum over all strictly earlier rows (`<name>_before`) and the key total.

    `order` must be unique per key (aggregate first). Missing sums count as 0. With n = 1 a plain window is used,
    for series whose length the calendar bounds.
    """
    keys = list(keys)
    base = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__x_{s}") for s, c in sums.items()])
    if n == 1:
        return _bounded_sums(base, keys, order, list(sums), totals)
    base = with_segment(base, order, n)
    part = base.groupBy(*keys, SEG).agg(*[F.sum(f"__x_{s}").alias(f"__p_{s}") for s in sums])
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(
        *keys, SEG,
        *[F.coalesce(F.sum(f"__p_{s}").over(earlier), F.lit(0)).alias(f"__c_{s}") for s in sums],
        *[F.sum(f"__p_{s}").over(by_key).alias(f"{s}_total") for s in sums if totals])
    joined = join_keys(base, carry, [*keys, SEG])
    inside = Window.partitionBy(*keys, SEG).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.select("*", *[
        (F.col(f"__c_{s}") + F.coalesce(F.sum(f"__x_{s}").over(inside), F.lit(0))).alias(f"{s}_before") for s in sums])
    return out.drop(SEG, *[f"__x_{s}" for s in sums], *[f"__c_{s}" for s in sums])


def _bounded_sums(base: DataFrame, keys: list[str], order: str, names: list[str], totals: bool) -> DataFrame:
    whole = Window.partitionBy(*keys)
    past = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = base.select("*", *[F.coalesce(F.sum(f"__x_{s}").over(past), F.lit(0)).alias(f"{s}_before") for s in names],
                      *[F.sum(f"__x_{s}").over(whole).alias(f"{s}_total") for s in names if totals])
    return out.drop(*[f"__x_{s}" for s in names])


def value_positions(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None,
                    n: int | None = None) -> DataFrame:
    """One row per key and distinct value: `n` rows equal, `n_before` rows smaller, `n_total` rows of the key.

    Counts are combined map-side before the shuffle, so heavy ties cost one row each. NULL values are left out.
    Rank statistics of any kind follow from these three numbers.
    """
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
               .agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("n")))
    return running_sums(counted, keys, value, {"n": F.col("n")}, n=n)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    method: str = "linear", n: int | None = None) -> DataFrame:
    """Exact quantiles per key, one column per entry of `probs`, without a per-key value buffer.

    method: `linear` interpolates between neighbours, `floor` takes position floor(n*p), which is the upper median
    for p = 0.5. Rows are counted by (key, segment) inside the tasks; only the segments that hold a wanted position are
    read again, so about 2 x probs / n of the rows are ever shuffled or sorted.
    """
    keys = list(keys)
    total = F.col("n_total")
    ranks = [r for p in probs.values() for r in ([F.least(F.floor(total * F.lit(p)), total - 1)] if method == "floor" else
                                                 [F.floor((total - 1) * F.lit(float(p))), F.least(F.floor((total - 1) * F.lit(float(p))) + 1, total - 1)])]
    pos = value_positions(df, keys, value, n=n) if n == 1 else _wanted_positions(df, keys, value, ranks, n)
    picks = []
    for name, p in probs.items():
        if method == "floor":
            at = F.least(F.floor(F.col("n_total") * F.lit(p)), F.col("n_total") - 1)
            picks.append(F.max(F.when(_covers(at), F.col(value))).cast("double").alias(name))
        else:
            exact = (F.col("n_total") - 1) * F.lit(float(p))
            low, frac = F.floor(exact), exact - F.floor(exact)
            high = F.least(low + 1, F.col("n_total") - 1)
            lo_v = F.max(F.when(_covers(low), F.col(value))).cast("double")
            hi_v = F.max(F.when(_covers(high), F.col(value))).cast("double")
            picks.append((lo_v + (hi_v - lo_v) * F.max(frac)).alias(name))
    return pos.groupBy(*keys).agg(*picks)


def _wanted_positions(df: DataFrame, keys: list[str], value: str, ranks: list[Column], n: int | None) -> DataFrame:
    """`value_positions` of the segments that hold one of `ranks`, which are expressions over n_total."""
    cut = with_segment(df.filter(F.col(value).isNotNull()).select(*keys, value), value, n)
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.select(*keys, SEG, "__c", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"), F.sum("__c").over(by_key).alias("n_total"))
    held = F.exists(F.array(*ranks), lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__c")))
    values = join_keys(cut, counts.filter(held).drop("__c"), [*keys, SEG]).groupBy(*keys, SEG, "__before", "n_total", value).agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*keys, SEG).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return values.select(*keys, value, "n", "n_total", (F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("n_before"))


def _covers(at: Column) -> Column:
    return (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))


def row_positions(df: DataFrame, keys: Sequence[str], order: str, tie: str, descending: bool = False,
                  name: str = "position", total: str | None = None, n: int | None = None) -> DataFrame:
    """row_number() per key over (`order`, `tie`) without a window over a whole key; NULLs come last.

    Segments of the order axis are counted first, so a row's number is the count of earlier segments plus its place
    in its own. `total` names an optional column with the number of rows of the key.
    """
    keys = list(keys)
    base = with_segment(df, order, n, tie, descending, nulls_last=True)
    part = base.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__c").over(whole.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = part.select(*keys, SEG, before.alias("__before"), F.sum("__c").over(whole).alias("__all"))
    inside = Window.partitionBy(*keys, SEG).orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last(), tie)
    out = join_keys(base, carry, [*keys, SEG]).withColumn(name, F.col("__before") + F.row_number().over(inside))
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop(SEG, "__before", "__all")


def neighbours(df: DataFrame, keys: Sequence[str], order: str, tie: str | None = None,
               before: dict[str, str] | None = None, after: dict[str, str] | None = None,
               n: int | None = None) -> DataFrame:
    """lag(1) / lead(1) per key over raw rows: `before` and `after` map a column to its output name.

    Rows are ordered by (`order`, `tie`). Each segment only borrows the last row of the segments before it and
    the first row of the segments after it.
    """
    keys = list(keys)
    before, after = before or {}, after or {}
    base = with_segment(df, order, n, tie)
    cols = [order] + ([tie] if tie else [])
    rank = F.struct(*cols)
    edges = base.groupBy(*keys, SEG).agg(
        F.max_by(F.struct(*[F.col(c) for c in before] or [F.lit(0)]), rank).alias("__last"),
        F.min_by(F.struct(*[F.col(c) for c in after] or [F.lit(0)]), rank).alias("__first"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(SEG)
    edges = edges.select(*keys, SEG, F.lag("__last").over(w).alias("__prev"), F.lead("__first").over(w).alias("__next"))
    joined = join_keys(base, edges, [*keys, SEG])
    inside = Window.partitionBy(*keys, SEG).orderBy(*cols)
    first = F.lag(F.lit(True)).over(inside).isNull()
    final = F.lead(F.lit(True)).over(inside).isNull()
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.when(first, F.col("__prev")[c]).otherwise(F.lag(c).over(inside)).alias(a) for c, a in before.items()],
        *[F.when(final, F.col("__next")[c]).otherwise(F.lead(c).over(inside)).alias(a) for c, a in after.items()])


def nearest_known(df: DataFrame, keys: Sequence[str], order: str, tie: str, item: str,
                  back: str | None = "prev_item", ahead: str | None = "next_item", n: int | None = None) -> DataFrame:
    """For each row the last non-NULL `item` at or before it and the first non-NULL one at or after it."""
    keys = list(keys)
    base = with_segment(df, order, n, tie)
    rank = F.struct(order, tie)
    known = F.col(item).isNotNull()
    edges = base.groupBy(*keys, SEG).agg(
        F.max_by(item, F.when(known, rank)).alias("__last"), F.min_by(item, F.when(known, rank)).alias("__first"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(SEG)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    future = w.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select(*keys, SEG, F.last("__last", True).over(past).alias("__past"),
                         F.first("__first", True).over(future).alias("__future"))
    joined = join_keys(base, edges, [*keys, SEG])
    inside = Window.partitionBy(*keys, SEG).orderBy(order, tie)
    out = [F.col(c) for c in df.columns]
    if back:
        here = F.last(item, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        out.append(F.coalesce(here, F.col("__past")).alias(back))
    if ahead:
        here = F.first(item, True).over(inside.rowsBetween(0, Window.unboundedFollowing))
        out.append(F.coalesce(here, F.col("__future")).alias(ahead))
    return joined.select(*out)


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach aggregates of each key (or of the whole table) to every row: partial aggregation, then a join.

    Without keys the one-row aggregate is a scalar subquery, so no cross join and no global window appears.
    """
    if keys:
        stats = df.groupBy(*keys).agg(*[c.alias(a) for a, c in aggs.items()])
        return join_keys(df, stats, list(keys))
    stats = df.agg(F.struct(*[c.alias(a) for a, c in aggs.items()]).alias("s")).scalar()
    return df.withColumn("__stats", stats).select(
        *df.columns, *[F.col("__stats")[a].alias(a) for a in aggs])

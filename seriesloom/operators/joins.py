"""Lookups, snapshot comparison, box and interval joins, nearest-time joins, neighbourhoods and series pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.literals import explode_matches, first_match
from seriesloom.functions.scalars import EARTH_RADIUS_KM, haversine_km
from seriesloom.operators.split import join_keys, nearest_known


def snapshot_compare(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of two snapshots; a key absent on one side counts as 0 there."""
    b = before.select(*keys, F.col(value).alias("before"))
    a = after.select(*keys, F.col(value).alias("after"))
    return b.join(a, list(keys), "full").select(
        *keys, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def box_join(df: DataFrame, x: str, y: str, boxes: Sequence[tuple[str, float, float, float, float]],
             name: str = "box") -> DataFrame:
    """Every box (name, x_lo, x_hi, y_lo, y_hi) that holds the point, both ends inclusive, each name once.

    A region across the date line is two boxes of one name. The list is a fixed constant, so this is a projection.
    """
    inside = explode_matches(
        df, boxes, [name, "x_lo", "x_hi", "y_lo", "y_hi"],
        lambda b: F.col(x).between(b["x_lo"], b["x_hi"]) & F.col(y).between(b["y_lo"], b["y_hi"]))
    return inside.drop("x_lo", "x_hi", "y_lo", "y_hi").distinct()


def first_box(x: Column, y: Column, boxes: Sequence[tuple[str, float, float, float, float]], outside: str,
              unknown: str = "unknown") -> Column:
    """Name of the first box that holds the point, `outside` when none does, `unknown` without coordinates."""
    hit = first_match(boxes, ["box", "x_lo", "x_hi", "y_lo", "y_hi"],
                      lambda b: x.between(b["x_lo"], b["x_hi"]) & y.between(b["y_lo"], b["y_hi"]), "box", outside)
    return F.when(x.isNull() | y.isNull(), unknown).otherwise(hit)


def first_overlap(start: Column, end: Column, periods: Sequence[tuple], default: str | None = None) -> Column:
    """Name of the first known period (name, start, end) that overlaps [start, end]."""
    return first_match(periods, ["name", "s", "e"], lambda p: (start <= p["e"]) & (p["s"] <= end), "name", default)


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, row_id: str, value: str,
                   tolerance: float) -> DataFrame:
    """For each left row the right value closest in time, within `tolerance` (exclusive); the earlier one on ties.

    Both sides are ordered together and each left row looks at its two neighbours, so no candidate pairs exist.
    `time` is numeric on both sides.
    """
    keys = list(keys)
    obs = right.groupBy(*keys, time).agg(F.min(value).alias(value)).select(
        *keys, time, F.lit(None).cast("bigint").alias(row_id), F.struct(time, value).alias("obs"))
    want = left.select(*keys, time, F.col(row_id).cast("bigint").alias(row_id),
                       F.lit(None).cast(obs.schema["obs"].dataType).alias("obs"))
    both = obs.unionByName(want).withColumn("ord", F.coalesce(row_id, F.lit(-1)))
    seen = nearest_known(both, keys, time, "ord", "obs").filter(F.col(row_id).isNotNull())
    back = F.col(time) - F.col("prev_item")[time]
    ahead = F.col("next_item")[time] - F.col(time)
    use_back = F.coalesce(back <= ahead, back.isNotNull())
    picked = F.when(use_back, F.col("prev_item")).otherwise(F.col("next_item"))
    gap = F.when(use_back, back).otherwise(ahead)
    near = gap < tolerance
    return seen.select(*keys, row_id, time, F.when(near, picked[value]).alias(value), F.when(near, gap).alias("gap"))


def month_fallback(wanted: DataFrame, known: DataFrame, keys: Sequence[str], year: str, month: str,
                   value: str, offsets: Sequence[int] = (0, -1, 1, -2, 2)) -> DataFrame:
    """Value of the wanted month, else of the months at the given offsets in turn, else of December."""
    rest = F.lit(len(offsets))
    wanted_mi = F.col(year) * 12 + F.col(month) - 1
    tries = F.array(*[F.struct(F.lit(i).alias("prio"), (wanted_mi + off).alias("mi")) for i, off in enumerate(offsets)],
                    F.struct(rest.alias("prio"), (F.col(year) * 12 + 11).alias("mi")))
    cand = wanted.select(*keys, year, month, F.inline(tries))
    lookup = known.select(*keys, (F.col(year) * 12 + F.col(month) - 1).alias("mi"), F.col(value).alias("__v"))
    hit = join_keys(cand, lookup, [*keys, "mi"], "left")
    return hit.groupBy(*keys, year, month).agg(
        F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col("prio"))).alias(value))


def neighbourhood_join(mains: DataFrame, events: DataFrame, days: float, radius: Column, max_radius_km: float,
                       min_gap_seconds: float = 10.0, tags: Sequence[str] = (), main_tags: Sequence[str] = ()) -> DataFrame:
    """(main, event) pairs with the event at most `days` later and within `radius` km of the main event.

    Both sides carry id, t (seconds), lat, lon. Rows meet in cells of time, latitude band and longitude. Cells come in
    `LEVELS` sizes, each a quarter of the one before; a main event uses the smallest size that is not below its own radius and
    visits the cells that its window and circle touch, so a small radius never meets the rows of a large cell. An event
    stands in one cell a level. `radius` is an expression over the main columns prefixed with m_. `tags` of both sides come
    out, the main event's as m_tag, and `main_tags` of the main event alone under their own names.
    """
    span = days * 86400.0
    degrees = EARTH_RADIUS_KM * math.pi / 180.0
    m = mains.select(*[F.col(c).alias(f"m_{c}") for c in mains.columns]).withColumn("__r", F.least(radius, F.lit(float(max_radius_km))))
    level = F.floor(F.log(4.0, max_radius_km / F.greatest(F.col("__r"), F.lit(1e-9))))
    m = m.withColumn("level", F.greatest(F.least(level, F.lit(LEVELS - 1)), F.lit(0)).cast("int"))
    m = m.withColumn("tb", F.explode(F.array(F.floor(F.col("m_t") / span), F.floor(F.col("m_t") / span) + 1)))
    size = max_radius_km / degrees / F.pow(F.lit(4.0), F.col("level"))
    m = m.withColumn("yb", F.explode(F.sequence(F.floor((F.col("m_lat") - F.col("__r") / degrees) / size - 1e-9), F.floor((F.col("m_lat") + F.col("__r") / degrees) / size + 1e-9))))
    # the widest longitude difference inside a circle; a circle that holds a pole reaches round the globe
    arc = F.col("__r") / EARTH_RADIUS_KM
    polar = F.radians(F.abs("m_lat")) + arc >= math.pi / 2 - 1e-9
    reach = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(arc) / F.cos(F.radians("m_lat")), F.lit(1.0)))) + 1e-6)
    around = _cells_around(F.col("yb"), size)
    first = F.floor((F.col("m_lon") - reach + 180) / 360 * around)
    last = F.least(F.floor((F.col("m_lon") + reach + 180) / 360 * around), first + around - 1)
    m = m.withColumn("xb", F.explode(F.transform(F.sequence(first, last), lambda c: F.pmod(c, around))))
    e = events.withColumn("tb", F.floor(F.col("t") / span)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    e = e.withColumn("yb", F.floor(F.col("lat") / size))
    e = e.withColumn("xb", F.pmod(F.floor((F.col("lon") + 180) / 360 * _cells_around(F.col("yb"), size)), _cells_around(F.col("yb"), size)))
    gap = F.col("t") - F.col("m_t")
    dist = haversine_km(F.col("m_lat"), F.col("m_lon"), F.col("lat"), F.col("lon"))
    pairs = m.join(e, ["tb", "level", "yb", "xb"]).filter((gap > min_gap_seconds) & (gap <= span))
    return (pairs.withColumn("dist_km", dist).filter(F.col("dist_km") <= F.col("__r"))
            .select("m_id", "id", gap.alias("gap_s"), "dist_km", *[f"m_{c}" for c in tags], *tags, *[F.col(f"m_{c}").alias(c) for c in main_tags]))


#: Cell sizes of `neighbourhood_join`; an event takes one row a size.
LEVELS = 4


def _cells_around(band: Column, size: Column) -> Column:
    """Longitude cells of a latitude band: about as wide as the band is high at its edge nearer to a pole, one at least."""
    edge = F.least(F.greatest(F.abs(band * size), F.abs((band + 1) * size)), F.lit(90.0))
    return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / size), F.lit(1)).cast("bigint")


def series_pairs(df: DataFrame, slot: Sequence[str], key: str, value: str) -> DataFrame:
    """Unordered pairs of series that share a slot: key_a < key_b with values x and y.

    The input has one row per (slot, key); the output is the k(k-1)/2 pairs the pairwise operators are asked for.
    """
    a = df.select(*slot, F.col(key).alias("key_a"), F.col(value).alias("x"))
    b = df.select(*slot, F.col(key).alias("key_b"), F.col(value).alias("y"))
    return a.join(b, list(slot)).filter(F.col("key_a") < F.col("key_b"))


def share_of_global(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum per key and its share of the grand total; the total is a scalar subquery over the grouped sums."""
    per_key = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    grand = per_key.agg(F.sum("total").alias("g")).scalar()
    return per_key.withColumn("share", F.col("total") / grand)

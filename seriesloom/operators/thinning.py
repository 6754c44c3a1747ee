"""Thinning of event catalogues: the largest events first, without a table of event pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import EARTH_RADIUS_KM, haversine_km
from seriesloom.operators.split import SEG, with_segment
from seriesloom.session import stored

#: A place is a time slice of one rule and, for the rule with a distance, a cell of a grid in space.
PLACE = ["rule", "cx", "cy", "cz", "slice"]
SOON, NEAR_BY = 0, 1


def thin_events(events: DataFrame, min_days: float = 2.0, far_days: float = 90.0, min_km: float = 300.0) -> DataFrame:
    """Keep well-separated events, largest first: an event goes when a kept larger one precedes it by less than
    `min_days`, or by less than `far_days` within `min_km`. Columns id (unique), t (seconds), mag, lat, lon; equal magnitudes
    rank by id. Events without a time or magnitude stay and remove none; without a position only `min_days` applies.

    The one-by-one rule is reached in rounds. A round keeps every open event with no larger open one before it in the places
    that could matter, which is a running maximum per place; then open events in reach of those just kept go, by a semi-join.
    Places are cut at time segments of the whole catalogue, and earlier slices and segments enter as one row each, so a dense
    place is no task of its own and no pair is ever a row. The largest open event is kept in each round; there are as many
    rounds as the longest run of ever smaller events in overlapping places whose earlier ones stay.
    """
    base = events.select("id", *[F.col(c).cast("double").alias(c) for c in ("t", "mag", "lat", "lon")])
    base = base.where(F.col("id").isNotNull() & F.col("t").isNotNull() & F.col("mag").isNotNull())
    open_events = stored(with_segment(base, "t"))
    limits = {SOON: min_days * 86400.0, NEAR_BY: far_days * 86400.0}
    removed = open_events.select("id").limit(0)
    while not open_events.isEmpty():
        first = stored(_unblocked(_places(open_events, limits, min_km)))
        kept = open_events.join(first, "id", "left_semi")
        rest = open_events.join(first, "id", "left_anti")
        lost = stored(_in_reach(rest, kept, limits, min_km))
        removed = removed.union(lost)
        open_events = stored(rest.join(lost, "id", "left_anti"))
    return events.join(removed, "id", "left_anti")


def _places(events: DataFrame, limits: dict[int, float], min_km: float) -> DataFrame:
    """One row per event and place that its circle touches; `home` marks the place of the event itself, one a rule.

    Space is cut into cubes around the unit sphere, two chords of `min_km` wide, so poles and the date line are like any
    other point and a circle touches at most eight cubes.
    """
    chord = 2 * math.sin(min(min_km / (2 * EARTH_RADIUS_KM), math.pi / 2)) * (1 + 1e-9) + 1e-12
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = {"cx": F.cos(lat) * F.cos(lon), "cy": F.cos(lat) * F.sin(lon), "cz": F.sin(lat)}
    own, parts = ["id", "t", "mag", "lat", "lon", SEG], []
    if limits[SOON] > 0:
        nowhere = [F.lit(0).cast("bigint").alias(c) for c in axes]
        parts.append(events.select(*own, F.lit(SOON).alias("rule"), *nowhere, F.floor(F.col("t") / limits[SOON]).alias("slice"), F.lit(True).alias("home")))
    if limits[NEAR_BY] > 0 and min_km > 0:
        at = events.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        for name, x in axes.items():
            cells = F.sequence(F.floor((x - chord) / (2 * chord)), F.floor((x + chord) / (2 * chord)))
            at = at.select("*", F.explode(cells).alias(name))
        home = [F.col(name) == F.floor(x / (2 * chord)) for name, x in axes.items()]
        parts.append(at.select(*own, F.lit(NEAR_BY).alias("rule"), *axes, F.floor(F.col("t") / limits[NEAR_BY]).alias("slice"), (home[0] & home[1] & home[2]).alias("home")))
    if not parts:
        return events.select(*own, F.lit(SOON).alias("rule"), *[F.lit(0).cast("bigint").alias(c) for c in (*axes, "slice")], F.lit(True).alias("home"))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _rank():
    """Smaller for larger events."""
    return F.struct((-F.col("mag")).alias("m"), F.col("id").alias("i"))


def _unblocked(places: DataFrame) -> DataFrame:
    """Ids of the events with no larger one in the slice before or earlier in the slice of any home place.

    That is more than the rules ask for, so an event may wait a round longer, but no event passes one that could remove it.
    Events of one time never remove each other, so none waits for them: a catalogue with many events at each time, such as
    one on coarse times, takes no more rounds than it would with the largest ones alone.
    """
    ranked = places.withColumn("rank", _rank())
    parts = ranked.groupBy(*PLACE, SEG).agg(F.min("rank").alias("rank"))
    whole = parts.groupBy(*PLACE).agg(F.min("rank").alias("slice_before")).withColumn("slice", F.col("slice") + 1)
    earlier = Window.partitionBy(*PLACE).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*PLACE, SEG, F.min("rank").over(earlier).alias("part_before"))
    by_time = Window.partitionBy(*PLACE, SEG).orderBy("t")
    so_far = by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Of the events of one time only the first in the window comes after an earlier time: its best holds for all of them.
    ahead = ranked.withColumn("so_far", F.min("rank").over(so_far)).withColumns({"t_ahead": F.lag("t").over(by_time), "ahead": F.lag("so_far").over(by_time)})
    best = F.min(F.when(F.col("t_ahead") < F.col("t"), F.col("ahead"))).over(Window.partitionBy(*PLACE, SEG, "t"))
    at_home = ahead.withColumn("best", best).where("home")
    seen = at_home.join(before, [*PLACE, SEG], "left").join(whole, PLACE, "left")
    best = F.least("best", "part_before", "slice_before")
    return seen.groupBy("id").agg(F.bool_or(F.coalesce(best < F.col("rank"), F.lit(False))).alias("blocked")).where(~F.col("blocked")).select("id")


def _in_reach(rest: DataFrame, kept: DataFrame, limits: dict[int, float], min_km: float) -> DataFrame:
    """Ids of `rest` that a larger event of `kept` removes."""
    over = _places(kept, limits, min_km).withColumn("slice", F.explode(F.array("slice", F.col("slice") + 1)))
    over = over.select(*PLACE, _rank().alias("k_rank"), *[F.col(c).alias(f"k_{c}") for c in ("t", "lat", "lon")])
    at_home = _places(rest, limits, min_km).where("home").withColumn("rank", _rank())
    gap = F.col("t") - F.col("k_t")
    limit = F.when(F.col("a.rule") == SOON, limits[SOON]).otherwise(limits[NEAR_BY])
    close = (F.col("a.rule") == SOON) | (haversine_km(F.col("k_lat"), F.col("k_lon"), F.col("lat"), F.col("lon")) < min_km)
    same = F.col("a.rule") == F.col("k.rule")
    for c in PLACE[1:]:
        same = same & (F.col(f"a.{c}") == F.col(f"k.{c}"))
    hit = at_home.alias("a").join(over.alias("k"), same & (F.col("k_rank") < F.col("rank")) & (gap > 0) & (gap < limit) & close, "left_semi")
    return hit.select("id").distinct()

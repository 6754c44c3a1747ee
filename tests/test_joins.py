"""Greedy thinning, conflict resolution and nearest-time joins against sequential versions."""

import math

import numpy as np
import pandas as pd

from seriesloom.operators.joins import first_overlap, month_fallback, nearest_within, neighbourhood_join, snapshot_compare
from seriesloom.operators.priority import resolve_conflicts
from seriesloom.operators import thinning
from seriesloom.operators.thinning import thin_events
from pyspark.sql import functions as F


def km(a, b):
    p, q = math.radians(a.lat), math.radians(b.lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def greedy(pdf):
    kept = []
    for row in pdf.sort_values(["mag", "id"], ascending=[False, True]).itertuples():
        def hides(s):
            gap = row.t - s.t
            return 0 < gap and (gap < 2 * 86400 or (gap < 90 * 86400 and km(row, s) < 300))
        if not any(hides(s) for s in kept):
            kept.append(row)
    return {r.id for r in kept}


def catalogue(n, days, box, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n), "t": rng.uniform(0, days * 86400, n), "mag": rng.uniform(6, 8, n).round(1),
                         "lat": rng.uniform(box[0], box[1], n), "lon": rng.uniform(box[2], box[3], n)})


def test_thinning_is_greedy(spark):
    sparse = catalogue(150, 300, (-10, 10, -10, 10), 11)
    dense = catalogue(600, 90, (0, 2, 0, 2), 12)
    poles = catalogue(300, 2000, (84, 90, -180, 180), 13)
    line = catalogue(300, 2000, (-4, 4, 176, 184), 14).assign(lon=lambda d: (d.lon + 180) % 360 - 180)
    rising = catalogue(80, 1, (0, 1, 0, 1), 15).assign(mag=lambda d: 5 + d.t / 86400)
    tied = catalogue(60, 30, (0, 1, 0, 1), 16).assign(mag=6.0, t=lambda d: (d.t / 86400).round() * 86400)
    for pdf in (sparse, dense, poles, line, rising, tied):
        got = [r.id for r in thin_events(spark.createDataFrame(pdf)).collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(pdf)


def test_thinning_without_times_magnitudes_or_rows(spark):
    day = 86400.0
    rows = [(1, 0.0, 7.0, 0.0, 0.0), (2, None, 6.0, 0.0, 0.0), (3, day, None, 0.0, 0.0), (4, day, 6.0, None, None), (5, 3 * day, 6.0, None, 0.0), (6, 3 * day, 6.5, 0.0, 1.0), (7, 3 * day, 6.5, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, t double, mag double, lat double, lon double").withColumn("rank", F.lit("x"))
    assert {r.id for r in thin_events(df).collect()} == {1, 2, 3, 5, 7}
    assert thin_events(df.limit(0)).count() == 0
    assert {r.id for r in thin_events(df, min_days=0, min_km=0).collect()} == set(range(1, 8))


def test_thinning_rounds_do_not_grow_with_events_of_one_time(spark, monkeypatch):
    """Twelve copies of each event at its time, of falling magnitude, take as many rounds as one."""
    one = [(i, 3 * 86400.0 * i, 7.0, 0.0, 20.0 * i) for i in range(4)]
    copies = [(100 * c + i, t, mag - c / 100, lat + 30.0 * (c % 3), lon) for c in range(12) for i, t, mag, lat, lon in one]
    rounds, unblocked = [], thinning._unblocked
    monkeypatch.setattr(thinning, "_unblocked", lambda places: rounds.append(1) or unblocked(places))
    got = thin_events(spark.createDataFrame(copies, "id int, t double, mag double, lat double, lon double")).collect()
    pdf = pd.DataFrame(copies, columns=["id", "t", "mag", "lat", "lon"])
    assert {r.id for r in got} == greedy(pdf) and len(rounds) <= 4


def test_conflict_chain(spark):
    # 1 beats 2, 2 beats 3: 3 stays because 2 is gone
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (4, 5)], "w int, l int")
    assert {r.l for r in resolve_conflicts(pairs, "w", "l").collect()} == {2, 4, 5}


def test_nearest_within(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2), ("a", 9.0, 3), ("b", 1.0, 4)], "k string, t double, id int")
    right = spark.createDataFrame([("a", 0.8, 10.0), ("a", 5.2, 20.0), ("a", 4.8, 30.0), ("a", 20.0, 40.0)], "k string, t double, v double")
    got = {r.id: r.v for r in nearest_within(left, right, ["k"], "t", "id", "v", 1.0).collect()}
    assert got == {1: 10.0, 2: 30.0, 3: None, 4: None}


def test_month_fallback_order(spark):
    wanted = spark.createDataFrame([("a", 2000, 9), ("b", 2000, 9), ("c", 2000, 9)], "k string, y int, m int")
    known = spark.createDataFrame([("a", 2000, 10, 1.0), ("a", 2000, 8, 2.0), ("b", 2000, 12, 3.0), ("c", 1999, 9, 4.0)], "k string, y int, m int, v double")
    got = {r.k: r.v for r in month_fallback(wanted, known, ["k"], "y", "m", "v").collect()}
    assert got == {"a": 2.0, "b": 3.0, "c": None}


def test_snapshot_counts_absent_as_zero(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("y", 5), ("z", 7)], "k string, n int")
    assert {(r.k, r.before, r.after) for r in snapshot_compare(a, b, ["k"], "n").collect()} == {("x", 1, 0), ("y", 2, 5), ("z", 0, 7)}


def test_neighbourhood_across_buckets(spark):
    mains = spark.createDataFrame([(1, 0.0, 10.0, 10.0)], "id int, t double, lat double, lon double")
    ev = spark.createDataFrame([(2, 89 * 86400.0, 10.5, 10.0), (3, 91 * 86400.0, 10.0, 10.0), (4, 100.0, 25.0, 10.0), (5, 5.0, 10.0, 10.0)], "id int, t double, lat double, lon double")
    got = {r.id for r in neighbourhood_join(mains, ev, 90, F.lit(200.0), 1000.0).collect()}
    assert got == {2}


def test_first_overlap_takes_list_order(spark):
    df = spark.createDataFrame([("2020-01-05", "2020-02-01")], "s string, e string")
    hit = df.select(first_overlap(F.col("s"), F.col("e"), [("late", "2020-01-20", "2020-03-01"), ("early", "2020-01-01", "2020-01-10")]).alias("n")).first().n
    assert hit == "late"


def test_neighbourhood_over_date_line_poles_and_levels(spark):
    rng = np.random.default_rng(7)

    def points(n, first):
        lat = np.concatenate([rng.uniform(-90, 90, n // 3), rng.uniform(85, 90, n // 3), rng.uniform(-5, 5, n - 2 * (n // 3))])
        lon = np.concatenate([rng.uniform(-180, 180, 2 * (n // 3)), rng.choice([-179.9, 179.9, -180.0, 180.0, 0.0], n - 2 * (n // 3))])
        return pd.DataFrame({"id": np.arange(first, first + n), "t": rng.uniform(0, 40 * 86400, n), "lat": lat, "lon": lon})

    mains, events = points(60, 0).assign(reach=rng.choice([3.0, 40.0, 300.0, 1000.0], 60)), points(500, 1000)
    events.loc[:19, ["lat", "lon"]] = mains.loc[:19, ["lat", "lon"]].to_numpy()
    got = {(r.m_id, r.id) for r in neighbourhood_join(spark.createDataFrame(mains), spark.createDataFrame(events), 20, F.col("m_reach"), 1000.0).collect()}
    want = {(m.id, e.id) for m in mains.itertuples() for e in events.itertuples() if 10 < e.t - m.t <= 20 * 86400 and km(m, e) <= m.reach}
    assert got == want and len(want) > 200

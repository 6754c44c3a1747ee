"""Distributed ordered computations against pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import split
from seriesloom.operators.ranking import interleave
from seriesloom.operators.split import SEG, exact_quantiles, nearest_known, neighbours, row_positions, with_segment


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(900) < 0.6, 0, rng.integers(1, 6, 900))
    values = np.where(rng.random(900) < 0.4, 5.0, rng.normal(0, 10, 900).round(1))
    return pd.DataFrame({"k": keys, "v": values, "id": np.arange(900), "t": rng.permutation(900)})


def test_segments_cover_and_bound(spark, skewed):
    seg = split.with_segment(spark.createDataFrame(skewed), "t", 8).groupBy(split.SEG).count().toPandas()
    assert set(seg[split.SEG]) <= set(range(8))
    assert seg["count"].max() <= 900 / 8 * 1.5


def test_value_positions(spark, skewed):
    got = split.value_positions(spark.createDataFrame(skewed), ["k"], "v").toPandas().set_index(["k", "v"])
    for (k, v), row in got.iterrows():
        own = skewed[skewed.k == k].v
        assert (row.n_before, row.n, row.n_total) == ((own < v).sum(), (own == v).sum(), len(own))


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantiles(spark, skewed, keys):
    got = split.exact_quantiles(spark.createDataFrame(skewed), keys, "v", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas()
    for _, row in got.iterrows():
        own = skewed[skewed.k == row.k].v if keys else skewed.v
        assert np.allclose([row.a, row.b, row.c], np.percentile(own, [10, 50, 93]))


def test_floor_quantile_is_upper_median(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0, 2.0, 3.0, 4.0]}))
    assert split.exact_quantiles(df, [], "v", {"m": 0.5}, "floor").first().m == 3.0


def test_neighbours(spark, skewed):
    got = split.neighbours(spark.createDataFrame(skewed), ["k"], "t", "id", before={"v": "p"}, after={"t": "n"}).toPandas().sort_values("id")
    want = skewed.sort_values("t")
    want = want.assign(p=want.groupby("k").v.shift(), n=want.groupby("k").t.shift(-1)).sort_values("id")
    assert np.allclose(got.p, want.p, equal_nan=True) and np.allclose(got.n.astype(float), want.n, equal_nan=True)


@pytest.mark.parametrize("descending", [False, True])
def test_row_positions(spark, skewed, descending):
    got = split.row_positions(spark.createDataFrame(skewed), ["k"], "v", "id", descending, "r").toPandas().sort_values("id")
    want = skewed.sort_values(["v", "id"], ascending=[not descending, True])
    want = want.assign(r=want.groupby("k").cumcount() + 1).sort_values("id")
    assert list(got.r) == list(want.r)


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert {(r.k, r.v, r.w) for r in split.join_keys(a, b, ["k"]).collect()} == {(None, 1, 10), ("x", 2, 20)}


def test_group_stats_without_keys_has_no_cross_join(spark, skewed):
    df = split.with_group_stats(spark.createDataFrame(skewed), [], m=F.avg("v"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.select("m").distinct().count() == 1


def brute_positions(rows, descending):
    key = (lambda r: (r[1] is None, -(r[1] or 0), r[2])) if descending else (lambda r: (r[1] is None, r[1] or 0, r[2]))
    return {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=key))}


@pytest.mark.parametrize("descending", [False, True])
def test_tied_order_values_are_cut_by_the_tie(spark, descending):
    """Half of the rows share one order value and a fifth have none; positions hold and no segment keeps a large part."""
    rows = [("a", None if k % 5 == 0 else 7 if k % 2 else k % 11, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "key string, x long, id long").repartition(4)
    got = {r.id: r.position for r in row_positions(df, ["key"], "x", "id", descending, n=16).collect()}
    assert got == brute_positions(rows, descending)
    sizes = with_segment(df, "x", 16, "id", descending, True).groupBy(SEG).count().agg({"count": "max"}).first()[0]
    assert sizes < 2000 / 16 * 2.5


def test_neighbours_across_tied_segments(spark):
    rows = [("a", None if k % 5 == 0 else 7 if k % 2 else k % 11, k, None if k % 3 else k) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, x long, id long, item long").repartition(4)
    ranked = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    got = {r.id: (r.p, r.q) for r in neighbours(df, ["key"], "x", "id", {"id": "p"}, {"id": "q"}, n=16).collect()}
    ids = [None] + [r[2] for r in ranked] + [None]
    assert got == {ids[k]: (ids[k - 1], ids[k + 1]) for k in range(1, len(ids) - 1)}
    known, last = {}, None
    for r in ranked:
        last = r[3] if r[3] is not None else last
        known[r[2]] = last
    assert {r.id: r.b for r in nearest_known(df, ["key"], "x", "id", "item", "b", None, n=16).collect()} == known


def test_text_order(spark):
    """Names may share their first bytes; order and ranks are those of the whole text."""
    names = ["Lima", "Oslo", "Oslo2", "Osl", "Łódź", "", "São Paulo", "San Jose 1", "San Jose 2", "San Jose"]
    df = spark.createDataFrame([("g", c) for c in names], "g string, name string")
    want = {c: k for k, c in enumerate(sorted(names, key=lambda c: c.encode()))}
    assert {r.name: r.turn for r in interleave(df, "g", "name", ["g"]).collect()} == want


def test_quantiles_reread_only_wanted_segments(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "a", "b"], 3000), "v": np.where(rng.random(3000) < 0.3, 1.0, rng.normal(0, 5, 3000))})
    pdf.loc[pdf.k == "b", "v"] = pdf.loc[pdf.k == "b", "v"].round()
    df = spark.createDataFrame(pdf)
    probs = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for row in exact_quantiles(df, ["k"], "v", probs, n=64).collect():
        assert np.allclose([row[c] for c in probs], np.quantile(pdf[pdf.k == row.k].v, list(probs.values())))
    floor = exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.9}, "floor", n=16).first()
    assert (floor.m, floor.q) == tuple(np.sort(pdf.v)[[1500, 2700]])
    assert exact_quantiles(df.limit(0), ["k"], "v", probs, n=16).count() == 0


def test_plans_stay_small_at_many_segments(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 50).alias("o"), F.col("id").alias("t"))
    rows = row_positions(df, ["k"], "o", "t", n=1024)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("\n") < 40
    place = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.o, r.t)):
        place[r.t] = place.get(("n", r.k), 0) + 1
        place["n", r.k] = place[r.t]
    assert all(r.position == place[r.t] for r in rows.collect())
    near = neighbours(df, ["k"], "o", "t", before={"t": "prev"}, n=1024)
    assert near.filter("prev is null").count() == 7

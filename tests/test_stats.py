"""Analytic and brute-force checks of the statistical operators."""


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.pvalues import p_value, t_critical
from seriesloom.operators import stats as S


def series(spark, **named):
    rows = [(k, 2000 + i, float(v)) for k, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, t int, y double")


def test_perfect_line(spark):
    df = series(spark, up=range(1, 11), flat=[5] * 10, down=range(10, 2, -1))
    fit = {r.k: r for r in S.ols_trend(df, ["k"], "t", "y", scale=10).collect()}
    assert fit["up"].slope == pytest.approx(10) and fit["up"].r2 == pytest.approx(1) and fit["up"].p_value == pytest.approx(0, abs=1e-12)
    assert fit["flat"].slope == 0 and fit["flat"].p_value == pytest.approx(1)
    mk = {r.k: r for r in S.mann_kendall(df, ["k"], "t", "y").collect()}
    assert (mk["up"].s, mk["up"].tau) == (45, 1.0) and mk["down"].tau == -1.0 and mk["flat"].tau == 0.0 and not mk["flat"].significant
    sen = {r.k: r.sen_slope for r in S.sen_slope(df, ["k"], "t", "y", scale=10).collect()}
    assert sen == {"up": 10.0, "flat": 0.0, "down": -10.0}


def test_short_series(spark):
    df = series(spark, two=[1, 2])
    mk = S.mann_kendall(df, ["k"], "t", "y").first()
    assert (mk.tau, mk.p_value, mk.s) == (0.0, 1.0, 0)
    fit = S.ols_trend(df, ["k"], "t", "y").first()
    assert (fit.slope, fit.p_value, fit.r2) == (0.0, 1.0, 0.0)
    assert S.sen_slope(series(spark, one=[3]), ["k"], "t", "y").first().sen_slope == 0.0


@pytest.mark.parametrize("n", [1, 8])
def test_concordance_matches_pairs(spark, n):
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"k": k, "x": rng.integers(0, 30, m), "y": rng.integers(0, 12, m).astype(float)}) for k, m in ((0, 300), (1, 40), (2, 5))]
    pdf = pd.concat(frames)
    got = {r.k: r.s for r in S.concordance(spark.createDataFrame(pdf), ["k"], "x", "y", n).collect()}
    for k, g in pdf.groupby("k"):
        x, y = g.x.to_numpy(), g.y.to_numpy()
        want = sum(np.sign(x[j] - x[i]) * np.sign(y[j] - y[i]) for i in range(len(x)) for j in range(i))
        assert got[k] == want


def test_tau_sign_flips_and_shift_keeps_slope(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(0, 1, 40).round(3)
    df = series(spark, a=y, neg=-y, shifted=y + 100)
    tau = {r.k: r.tau for r in S.mann_kendall(df, ["k"], "t", "y").collect()}
    assert tau["a"] == -tau["neg"] == tau["shifted"]
    fit = {r.k: r.slope for r in S.ols_trend(df, ["k"], "t", "y").collect()}
    assert fit["a"] == pytest.approx(fit["shifted"])


def test_row_order_does_not_matter(spark):
    df = series(spark, a=[3, 1, 4, 1, 5, 9, 2, 6])
    one = S.mann_kendall(df, ["k"], "t", "y").collect()
    two = S.mann_kendall(df.orderBy(F.rand(3)).repartition(3), ["k"], "t", "y").collect()
    assert one == two


@pytest.mark.parametrize("kind,stat,d1,d2,want", [
    ("normal", 1.959963985, 1, 1, 0.05), ("t", 2.228138852, 10, 1, 0.05), ("t", 12.70620474, 1, 1, 0.05), ("chi2", 9.487729037, 4, 1, 0.05),
    ("chi2", 3.841458821, 1, 1, 0.05), ("f", 4.102821015, 2, 10, 0.05), ("normal_greater", 1.644853627, 1, 1, 0.05), ("t", 0.0, 7, 1, 1.0),
    ("ks", 1.358099, 1, 1, 0.05),
])
def test_tail_probabilities(spark, kind, stat, d1, d2, want):
    got = spark.range(1).select(p_value(kind, F.lit(stat), F.lit(d1), F.lit(d2)).alias("p")).first().p
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("df,want", [(1, 12.7062047), (10, 2.2281389), (100, 1.9839715)])
def test_t_quantile(spark, df, want):
    assert spark.range(1).select(t_critical(F.lit(df)).alias("t")).first().t == pytest.approx(want, abs=1e-6)


def test_interval_contains_slope(spark):
    rng = np.random.default_rng(5)
    fit = S.ols_trend(series(spark, a=0.03 * np.arange(40) + rng.normal(0, 0.1, 40)), ["k"], "t", "y").first()
    assert fit.ci_lower < fit.slope < fit.ci_upper and fit.p_value < 0.001


def test_zero_variance_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", 3.0, 5.0)], "k string, x double, y double")
    row = S.pearson(df, ["k"], "x", "y").first()
    assert row.r == 0.0 and row.p_value == pytest.approx(1.0)


def test_mann_whitney_matches_pairs(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 80), "v": rng.integers(0, 15, 80).astype(float)})
    row = S.mann_whitney_u(spark.createDataFrame(pdf), "g", "v", ["a", "b"]).first()
    a, b = pdf[pdf.g == "a"].v.to_numpy(), pdf[pdf.g == "b"].v.to_numpy()
    assert row.u == sum((b < x).sum() + 0.5 * (b == x).sum() for x in a)
    assert 0 <= row.p_value <= 1


def test_quadratic_recovers_curve(spark):
    t = np.arange(30)
    row = S.quadratic_fit(series(spark, a=2 + 0.5 * t + 0.1 * t ** 2 + np.sin(t * 9) * 1e-3), ["k"], "t", "y").first()
    assert row.acceleration == pytest.approx(0.2, abs=1e-4) and row.p_value < 1e-6


def test_poisson_trend(spark):
    x = np.arange(60)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "n": np.round(np.exp(2 + 0.03 * x))}))
    row = S.poisson_trend(df, ["k"], "x", "n").first()
    assert row.rate == pytest.approx(0.03, abs=2e-3) and row.p_value < 1e-6


def test_omori_recovers_decay(spark):
    # quantiles of a decay with c = 0.1, p = 1.1 over 90 days
    c, p, end, n = 0.1, 1.1, 90.0, 400
    q = 1 - p
    u = (np.arange(n) + 0.5) / n
    t = (c ** q + u * ((end + c) ** q - c ** q)) ** (1 / q) - c
    row = S.omori_fit(spark.createDataFrame(pd.DataFrame({"k": "a", "t": t})), ["k"], "t").first()
    assert row.p == pytest.approx(p, abs=0.06) and row.c == pytest.approx(c, rel=0.4)


def test_harmonic_finds_period(spark):
    t = np.arange(120)
    row = S.harmonic_fit(series(spark, a=3 * np.cos(2 * np.pi * (t + 2000) / 24)), ["k"], "t", "y", [12, 18, 24, 36]).first()
    assert row.period == 24 and row.amplitude == pytest.approx(3)


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0, 2.0, 2.0, 4.0]}))
    d = S.weighted_kde(df, [], "v", F.lit(1.0), 0.05, -1.0, 1.5, 1000).agg(F.sum("density")).first()[0]
    assert d * 2.5 / 999 == pytest.approx(1.0, abs=1e-3)


def test_valley_between_two_peaks(spark):
    x = np.linspace(0, 10, 201)
    y = np.exp(-(x - 3) ** 2) + 0.8 * np.exp(-(x - 7) ** 2)
    row = S.valley_detect(spark.createDataFrame(pd.DataFrame({"k": 1, "g": np.arange(201), "x": x, "density": y})), ["k"]).first()
    assert row.peak_low == pytest.approx(3, abs=0.1) and row.peak_high == pytest.approx(7, abs=0.1) and 4.5 < row.valley < 5.5
    assert row.depth == pytest.approx(1 - row.valley_density / 0.9, abs=1e-3) and row.width_log > 0


def test_decadal_blocks_skip_first(spark):
    out = S.decadal_rates(series(spark, a=range(35)), ["k"], "t", "y", tests=False).orderBy("block").collect()
    assert [r.block for r in out] == [2010, 2020] and all(r.slope == pytest.approx(1) for r in out)


def test_gini(spark):
    from seriesloom.operators.aggregates import gini
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 6)] + [("z", 0.0)] * 3 + [("one", v) for v in (0.0, 0.0, 0.0, 100.0)], "k string, v double")
    got = {r.k: round(r.gini, 4) for r in gini(df, ["k"], "v").collect()}
    assert got == {"a": 0.2667, "z": 0.0, "one": 0.75}


def test_empty_input(spark):
    empty = series(spark, a=[1]).limit(0)
    assert S.ols_trend(empty, ["k"], "t", "y").count() == 0
    assert S.mann_kendall(empty, ["k"], "t", "y").count() == 0


def test_tails_of_large_samples():
    """Values at the centre of a chi-square of a million degrees, and of t with many, against their limits."""
    from seriesloom.functions import pvalues

    mid = pvalues._gamma_tail(np.array([5e5, 1e4, 9_999.0]), np.array([5e5, 1e4, 9_999.0]))
    assert np.allclose(mid, [0.49981194, 0.49867019, 0.49867013], atol=1e-8)
    t = pvalues.t_two_sided(np.array([0.5, 2.0, 2.0]), np.array([1e13, 5.0, 1e5 + 1]))
    assert np.allclose(t, [0.61707508, 0.10193948, 0.04550296], atol=1e-8)
    for x in (9_700.0, 10_000.0, 10_300.0):
        at = np.array([1e4]), np.array([x])
        assert np.allclose(pvalues._gamma_tail_small(*at), pvalues._gamma_tail_large(*at), atol=1e-9)


def test_valley_between_masses_far_apart(spark):
    """Two equal masses at 10 and 1000: the density between them is 0 over a long stretch, the valley half way at 100."""
    from seriesloom.operators.stats import valley_detect, weighted_kde

    df = spark.createDataFrame([(10.0,), (1000.0,)], "v double")
    curve = weighted_kde(df, [], "v", F.lit(1.0), 0.01, 0.5, 3.5, 401)
    row = valley_detect(curve, []).first()
    assert abs(np.log10(row.valley) - 2.0) < 0.01 and row.depth == 1.0


def brute_sen(x, y):
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    return float(np.median(((y[j] - y[i])[dx != 0]) / dx[dx != 0]))


def test_median_slope_without_pairs(spark):
    rng = np.random.default_rng(5)
    n = 150
    cases = {"noise": (np.arange(n), 0.03 * np.arange(n) + rng.normal(0, 4, n)), "ties": (rng.integers(0, 30, n), rng.integers(0, 3, n)),
             "flat": (np.arange(n), np.zeros(n)), "heavy": (rng.normal(0, 1, n), rng.standard_cauchy(n)),
             "two": (np.array([0, 1]), np.array([3.0, 9.0])), "steps": (np.array([0, 1, 2, 3]), np.array([0.0, 0, 10, 10]))}
    pdf = pd.concat([pd.DataFrame({"k": k, "x": np.asarray(x, float), "y": np.asarray(y, float)}) for k, (x, y) in cases.items()])
    df = spark.createDataFrame(pdf)
    got = {r.k: r.slope for r in S.median_slope(df, ["k"], "x", "y", 1e-2, n=1).collect()}
    assert got.keys() == cases.keys()
    for k, (x, y) in cases.items():
        assert abs(got[k] - brute_sen(np.asarray(x, float), np.asarray(y, float))) <= 2e-2, k


def test_sen_slope_of_long_and_short_keys(spark):
    rng = np.random.default_rng(6)
    pdf = pd.concat([pd.DataFrame({"k": k, "x": np.arange(float(m)), "y": rng.normal(0, 1, m) + 0.2 * np.arange(m)}) for k, m in (("a", 90), ("b", 20), ("c", 1))])
    got = {r.k: (r.n, r.sen_slope) for r in S.sen_slope(spark.createDataFrame(pdf), ["k"], "x", "y", scale=10, digits=1, in_task=50).collect()}
    for k, g in pdf.groupby("k"):
        want = brute_sen(g.x.to_numpy(), g.y.to_numpy()) * 10 if len(g) > 1 else 0.0
        assert got[k] == (len(g), round(want, 1))
    whole = S.sen_slope(spark.createDataFrame(pdf[pdf.k == "b"][["x", "y"]]), [], "x", "y", in_task=50).first()
    b = pdf[pdf.k == "b"]
    assert (whole.n, whole.sen_slope) == (20, round(brute_sen(b.x.to_numpy(), b.y.to_numpy()), 6))


def test_pair_moments_equal_numpy(spark, monkeypatch):
    from seriesloom.operators import pairs as PM
    monkeypatch.setattr(PM, "BLOCK_SERIES", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(1e4, 5, (40, 13))
    x[:, 3], x[:, 4] = 7.0, np.nan
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(t % 5, t // 5, f"k{k:02d}", None if np.isnan(x[t, k]) and k % 2 else float(x[t, k])) for t in range(40) for k in range(13)]
    out = {(r.key_a, r.key_b): r for r in S.pearson_matrix(spark.createDataFrame(rows, "k int, slot int, key string, v double"), ["k", "slot"], "key", "v").collect()}
    assert len(out) == 12 * 11 // 2
    for (a, b), r in out.items():
        p, q = x[:, int(a[1:])], x[:, int(b[1:])]
        ok = ~np.isnan(p) & ~np.isnan(q)
        want = 0.0 if "k03" in (a, b) else np.corrcoef(p[ok], q[ok])[0, 1]
        assert a < b and r.n == ok.sum() and abs(r.r - want) < 1e-9
    assert S.pearson_matrix(spark.createDataFrame([], "k int, slot int, key string, v double"), ["k"], "key", "v").count() == 0


def test_weighted_kde_sums_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(10 ** v), float(w)) for k in ("a", None) for v, w in zip(rng.uniform(0, 3, 700), rng.uniform(0.5, 2, 700))] + [("a", -1.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(3)
    for keys in (["k"], []):
        out = S.weighted_kde(df, keys, "x", F.col("w"), 0.05, 0.5, 2.0, 40)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # of the grid, none a value and grid point
        for key in ("a",) if keys else (None,):
            mine = [r for r in rows if r[1] > 0 and (not keys or r[0] == key)]
            lv, w = np.log10([r[1] for r in mine]), np.array([r[2] for r in mine])
            at = 0.5 + np.arange(40) * (1.5 / 39)
            want = (w / w.sum() * np.exp(-0.5 * ((at[:, None] - lv) / 0.05) ** 2)).sum(1) / (0.05 * np.sqrt(2 * np.pi))
            got = {r.g: r.density for r in out.collect() if not keys or r.k == key}
            assert np.allclose([got[g] for g in range(40)], want, rtol=1e-9)


def test_omori_errors_rank_only_open_stretches(spark, monkeypatch):
    """Distances equal those of all times ranked, whatever the stretches; times move only inside stretches that are open."""
    rng = np.random.default_rng(8)
    rows = [(k, float(v)) for k, n in (("a", 400), ("b", 60), ("c", 15), (None, 30)) for v in np.round(rng.exponential(4, n), 2)]
    df = spark.createDataFrame(rows, "k string, d double")
    fits = spark.createDataFrame([("a", 0.5, 1.1), ("b", 0.05, 0.7), ("c", 2.0, 1.0), (None, 1.0, 0.4)], "k string, c double, p double")
    want = {}
    for k, c, p in fits.collect():
        x = np.sort([v for key, v in rows if key == k and v > 0])
        mass = lambda e: np.log((e + c) / c) if p == 1 else ((e + c) ** (1 - p) - c ** (1 - p)) / (1 - p)  # noqa: B023, E731
        cdf = mass(x) / mass(x[-1])
        want[k] = max(np.abs(np.searchsorted(x, x, "right") / len(x) - cdf).max(), np.abs(cdf - np.searchsorted(x, x, "left") / len(x)).max())
    for bins in (1, 4, S.ERROR_BINS):
        monkeypatch.setattr(S, "ERROR_BINS", bins)
        got = {r.k: r.ks for r in S.omori_errors(df, fits, ["k"], "d").collect()}
        assert got == pytest.approx(want, abs=1e-12)

    asked = []

    def attach(known):
        asked.append(known.columns)
        return df.join(known.withColumnRenamed("k", "__k"), F.expr("k <=> __k")).drop("__k")

    assert {r.k: r.ks for r in S.omori_errors(df, fits, ["k"], "d", attach=attach).collect()} == pytest.approx(want, abs=1e-12)
    assert [c[-1] for c in asked] == ["p", "n_total", "__open"]


def test_omori_times_are_not_shuffled(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, float(x)) for k in (1, 2, None) for x in rng.pareto(1.1, 300) * 0.2 + 0.01] + [(9, 1.0)], "k int, d double").repartition(4)
    fits = S.omori_fit(df, ["k"], "d", refine=False)
    plan = fits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # one pass over the times, summed before they move
    assert sorted(str(r.k) for r in fits.collect()) == ["1", "2", "None"]
    fine = {r.k: r for r in S.omori_fit(df, ["k"], "d").collect()}
    for r in fits.collect():
        assert fine[r.k].log_likelihood >= r.log_likelihood - 1e-9 and fine[r.k].n == 300

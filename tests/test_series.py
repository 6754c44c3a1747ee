"""Windows, episodes, spectra and streaming on small frames."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import episodes as G
from seriesloom.operators import spectral as H
from seriesloom.operators import windows as W
from seriesloom.streaming.incremental import load_new_files, newest_within, windowed_counts


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, t int, v double")


@pytest.mark.parametrize("n", [40, 1200])
def test_ewma_recursion(spark, n):
    rng = np.random.default_rng(4)
    r = [None] + [None if rng.random() < 0.1 else x for x in rng.normal(0, 0.01, n - 1)]
    got = [x.ewma_var for x in W.ewma_variance(frame(spark, r), ["k"], "t", "v").orderBy("t").collect()]
    first = next(i for i, x in enumerate(r) if x is not None)
    at = min(first + 30, n) - 1
    var = np.var([x for x in r[first:at + 1] if x is not None], ddof=1)
    want = [None] * at + [var]
    for x in r[at + 1:]:
        var = var if x is None else 0.94 * var + 0.06 * x * x
        want.append(var)
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-10)


def test_rolling_std_needs_values(spark):
    out = W.rolling_std(frame(spark, range(12)), ["k"], "t", "v", n=5, min_obs=5, scale=1.0).orderBy("t").collect()
    assert [x.rolling_std for x in out][:5] == [None] * 5 and out[-1].rolling_std == pytest.approx(np.std([7, 8, 9, 10, 11], ddof=1))


def test_forward_return_incomplete(spark):
    out = W.forward_return(frame(spark, [0.1, 0.1, 0.1]), ["k"], "t", "v", [2]).orderBy("t").collect()
    assert out[0].fwd_2 == pytest.approx(0.21) and out[2].fwd_2 is None


def test_autocorrelation_of_cosine(spark):
    x = np.cos(2 * np.pi * np.arange(240) / 12)
    acf = W.autocorrelation(frame(spark, x), ["k"], "t", "v", 24)
    by_lag = {r.lag: r.acf for r in acf.collect()}
    assert by_lag[0] == pytest.approx(1) and by_lag[12] == pytest.approx(0.95, abs=1e-6) and by_lag[6] < -0.9
    # r(2) > 0 > r(3): the last lag before the sign change
    assert by_lag[2] > 0 > by_lag[3] and W.decorrelation(acf, ["k"], 24).first().decorrelation == 2
    assert [r.lag for r in H.acf_peaks(acf, ["k"], 6, 0.05).collect()] == [12]


def test_episodes_and_ongoing(spark):
    out = G.episodes(frame(spark, [0, 2, 3, 0, -1, 4, 4]), ["k"], "t", F.col("v") >= 2, "v").orderBy("start").collect()
    assert [(r.start, r.end, r.length, r.peak, r.peak_time, r.ongoing) for r in out] == [(1, 2, 2, 3.0, 2, False), (5, 6, 2, 4.0, 5, True)]


@pytest.mark.parametrize("n", [1, 8])
def test_episode_breaks_at_gap(spark, n):
    df = spark.createDataFrame([("a", t) for t in (1, 2, 3, 7, 8, 20)], "k string, t int")
    out = G.episodes(df, ["k"], "t", F.lit(True), max_gap=2, n=n).orderBy("start").collect()
    assert [(r.start, r.end) for r in out] == [(1, 3), (7, 8), (20, 20)]


def test_merge_and_duration_order(spark):
    runs = spark.createDataFrame([(0, 4), (8, 9), (40, 41)], "start int, end int")
    merged = G.merge_gap(runs, [], 5).orderBy("start").collect()
    assert [(r.start, r.end) for r in merged] == [(0, 9), (40, 41)]
    assert G.min_duration(runs, 3).count() == 1
    assert G.merge_gap(runs, [], 4, strict=True).count() == 3


def test_cycle_minimum_is_middle_of_ties(spark):
    v = [5, 3, 1, 1, 1, 6, 9, 6, 2, 1, 4, 8]
    out = G.cycle_segments(frame(spark, v), ["k"], "t", "v", [(1, 3), (2, 9)], 2).orderBy("cycle").collect()
    assert (out[0].min_time, out[0].max_time, out[0].next_min) == (3, 6, 9) and out[0].total == 1 + 1 + 6 + 9 + 6 + 2


def test_periodogram_peak_and_parseval(spark):
    n = 96
    x = 2 * np.sin(2 * np.pi * np.arange(n) / 12)
    spec = H.periodogram(frame(spark, x), ["k"], "t", "v", fs=12.0)
    top = spec.orderBy(F.desc("power")).first()
    assert top.period == pytest.approx(1.0)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    want = np.abs(np.fft.rfft(x * w)) ** 2 / (12.0 * (w ** 2).sum())
    want[1:-1] *= 2
    got = np.array([r.power for r in spec.orderBy("f_idx").collect()])
    assert np.allclose(got, want[1:], atol=1e-9)
    peaks = H.spectral_peaks(spec, ["k"], "f_idx").collect()
    assert len(peaks) == 1 and peaks[0].period == pytest.approx(1.0)


def peaks_by_definition(p, distance, least):
    """(place, height, prominence) of spaced maxima, straight from the definitions."""
    n, tops = len(p), []
    for i in range(1, n - 1):
        j = i
        while j + 1 < n and p[j + 1] == p[i]:
            j += 1
        if p[i - 1] < p[i] and j + 1 < n and p[j + 1] < p[i]:
            tops.append((i + j) // 2)
    kept = []
    for i in sorted(tops, key=lambda i: (p[i], i), reverse=True):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        a = next((k + 1 for k in range(i, -1, -1) if p[k] > p[i]), 0)
        b = next((k for k in range(i, n) if p[k] > p[i]), n)
        out.append((i, p[i], p[i] - max(min(p[a:i + 1]), min(p[i:b]))))
    return [o for o in out if o[2] >= least * max(p)]


def test_peaks_equal_their_definition(spark):
    rng = np.random.default_rng(5)
    series = {f"s{k}": rng.integers(0, levels, n).astype(float).tolist() for k, (n, levels) in enumerate([(60, 5), (60, 40), (200, 3), (80, 1000), (3, 9), (2, 2), (1, 1)])}
    series |= {"hill": [0.0, 1, 0, 3, 2, 2.5, 0, 2, 2, 1], "flat": [2.0] * 9, "up": list(map(float, range(30)))}
    df = spark.createDataFrame([(k, i, float(100 - i), float(v)) for k, p in series.items() for i, v in enumerate(p)] + [("none", 0, 1.0, None)], "k string, i int, period double, power double")
    for distance in (1, 3, 8):
        got = {}
        for r in H.spectral_peaks(df, ["k"], "i", distance=distance, n_peaks=1000).orderBy("k", "rank").collect():
            got.setdefault(r.k, []).append((int(100 - r.period), r.power, r.prominence))
        want = {k: sorted(peaks_by_definition(p, distance, 0.1), key=lambda o: (-o[2], o[0])) for k, p in series.items()}
        assert got == {k: v for k, v in want.items() if v}
    assert [r.k for r in H.spectral_peaks(df, ["k"], "i", low=0, high=0).collect()] == []


def test_acf_peaks_leave_out_missing_lags(spark):
    p = [1.0, 0.2, 0.4, 0.1, None, 0.6, 0.5, 0.55, 0.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(p)], "k string, lag int, acf double")
    assert {(r.lag, r.acf) for r in H.acf_peaks(df, ["k"], 2, 0.3).collect()} == {(2, 0.4), (5, 0.6), (7, 0.55)}
    assert {r.lag for r in H.acf_peaks(df, ["k"], 3, 0.3).collect()} == {5}


def test_morlet_dominant_period(spark):
    x = np.sin(2 * np.pi * np.arange(200) / 20)
    scales = [float(s) for s in range(8, 40, 2)]
    power = H.morlet_power(frame(spark, x), ["k"], "t", "v", scales, steps_per_unit=1.0)
    mid = H.dominant_period(power, ["k"], 5, 60, 10).filter("step = 100").first()
    assert mid.dominant == pytest.approx(20, abs=2)


def test_rate_storm_span(spark):
    df = spark.createDataFrame([("a", i, i * 10.0, i * 10.0 + 30, n, z) for i, (n, z) in enumerate([(1, 0.0), (9, 2.5), (8, 2.1), (1, 0.0), (7, 2.2)])],
                               "k string, window int, start_s double, end_s double, n int, z double")
    out = G.rate_storms(df, ["k"]).orderBy("start_s").collect()
    assert [(r.start_s, r.stop_s, r.peak_n) for r in out] == [(10.0, 30.0, 9), (40.0, 70.0, 7)]


def test_first_breach_leads(spark):
    flags = spark.createDataFrame([(s, r, True) for s, r in (("a", 8), ("b", 10), ("c", 12), ("d", 90))], "s string, r int, f boolean")
    onsets = spark.createDataFrame([("x", 10)], "o string, at int")
    got = {r.s: (r.lead, r.position) for r in W.first_breach(flags, onsets, "s", "r", "f", "o", "at", 30).collect()}
    assert got == {"a": (2, 1), "b": (0, 2), "c": (-2, 3)}


def test_incremental_load_is_idempotent(spark, tmp_path):
    src, sink, cp = (str(tmp_path / d) for d in ("src", "sink", "cp"))
    df = spark.range(5).toDF("id")
    df.write.parquet(src)
    for _ in range(2):
        load_new_files(spark, src, df.schema, sink, cp)
    df.write.mode("append").parquet(src)
    load_new_files(spark, src, df.schema, sink, cp)
    assert spark.read.parquet(sink).count() == 10


def test_stream_forms(spark, tmp_path):
    src = str(tmp_path / "s")
    df = spark.createDataFrame([("a", "2024-01-01 00:00:05"), ("a", "2024-01-01 00:00:06"), ("b", "2024-01-01 00:30:00"), ("b", "2024-01-01 05:00:00")],
                               "k string, s string").select("k", F.col("s").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for name, out, want in (("firsts", newest_within(stream, ["k"], "ts", "10 hours"), 2), ("counts", windowed_counts(stream, "ts", "1 hour", "1 hour", "1 minute"), 1)):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == want


def test_two_stage_transform_of_any_length(spark):
    rng = np.random.default_rng(8)
    cases = {n: rng.normal(0, 1, n) for n in (1, 2, 13, 36, 90)}
    rows = [(n, i, float(v), n, max(d for d in range(1, int(n ** 0.5) + 1) if n % d == 0)) for n, x in cases.items() for i, v in enumerate(x)]
    out = H.two_stage_transform(spark.createDataFrame(rows, "k int, i long, x double, n long, n1 int"), ["k"]).collect()
    assert len(out) == sum(cases)
    for r in out:
        want = np.conj(np.fft.fft(cases[r.k]))[r["__k"]]
        assert abs(complex(r.re, r.im) - want) < 1e-9


def test_lomb_scargle_bins_match_direct_sums(spark):
    rng = np.random.default_rng(10)
    periods = H.period_grid(0.3, 400, 60)
    cases = {"long": 1000.0, "short": 3.0}
    rows = [(k, float(t), float(v)) for k, span in cases.items() for t, v in zip(rng.uniform(-span, span, 200), rng.normal(1e4, 1, 200))]
    rows += [("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("none", None, 1.0), ("none", 1.0, None)]
    got = {(r.k, r.f_idx): r.power for r in H.lomb_scargle(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", "v", periods).collect()}
    assert len(got) == 3 * len(periods) and all(got["flat", i] is None for i in range(len(periods)))
    for k in cases:
        t, v = (np.array([r[c] for r in rows if r[0] == k]) for c in (1, 2))
        x = v - v.mean()
        for i, p in enumerate(periods):
            w = 2 * np.pi / p
            tau = np.arctan2(np.sin(2 * w * t).sum(), np.cos(2 * w * t).sum()) / (2 * w)
            c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
            want = ((x @ c) ** 2 / (c @ c) + (x @ s) ** 2 / (s @ s)) / (x @ x)
            assert abs(got[k, i] - want) < 1e-7
    whole = H.lomb_scargle(spark.createDataFrame(rows[:200], "k string, t double, v double"), [], "t", "v", periods).collect()
    assert all(abs(r.power - got["long", r.f_idx]) < 1e-9 for r in whole)


def test_morlet_blocks_match_direct_sums(spark, monkeypatch):
    monkeypatch.setattr(H, "WAVE_BLOCK", 8)
    rng = np.random.default_rng(12)
    steps = np.sort(rng.choice(np.arange(-60, 120), 90, replace=False))
    values = [None if i % 17 == 0 else float(v) for i, v in enumerate(rng.normal(0, 3, 90))]
    scales = [0.2, 1.0, 2.5, 9.0]
    df = spark.createDataFrame([("a", int(t), v) for t, v in zip(steps, values)], "k string, t long, v double")
    got = {(r.scale, r.step): r.power for r in H.morlet_power(df, ["k"], "t", "v", scales).collect()}
    assert len(got) == len(scales) * len(steps)
    mean = np.mean([v for v in values if v is not None])
    x = {int(t): 0.0 if v is None else v - mean for t, v in zip(steps, values)}
    for (s, t), power in got.items():
        half = max(int(3 * s), 1)
        w = sum(x.get(t + lag, 0.0) * np.exp(-(lag / s) ** 2 / 2 + 6j * lag / s) for lag in range(-half, half + 1))
        assert abs(power - abs(w) ** 2 / (s * np.sqrt(np.pi))) < 1e-9 * (1 + power)


def test_web_study_plans_in_a_small_driver(spark, tmp_path):
    """Pages are stored as parsed, so no later plan holds the parser."""
    from seriesloom.plans import catalog
    catalog.load_all()
    words = " ".join(f"In 202{i % 6} the number of towns increased by {i} percent compared with the estimated growth of the other regions and cities of the land." for i in range(20))
    rows = [(i, f"http://h{i}.example.org/a", f"<html><head><title>T{i}</title></head><body><article><p>{words}</p></article></body></html>") for i in range(6)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    out = catalog.QUERIES["q19_web_evidence"](spark, str(tmp_path))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert out.count() > 0

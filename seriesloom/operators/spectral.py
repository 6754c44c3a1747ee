"""Spectra and time-frequency power as sums over fixed frequency, period or scale grids.

Series are calendar-bounded (one row per key and step). Transforms run in two stages of about sqrt(n) terms a row; other
grids turn a series into grid size times length rows. Partial aggregation folds them before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.aggregates import ratio
from seriesloom.operators.split import join_keys, with_group_stats
from seriesloom.operators.windows import by_time


def _hann(i: Column, n: Column) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / n)


def periodogram(df: DataFrame, keys: Sequence[str], step: str, value: str, fs: float = 12.0) -> DataFrame:
    """Hann-windowed power density without the zero frequency; missing values and steps count 0 after mean removal.

    `step` is the integer position of a row and n the number of steps from the first to the last. Frequencies are
    k*fs/n for k = 1 .. n/2; power doubles except at the Nyquist frequency of an even n. The squared window sums to
    3n/8 whatever is missing.
    """
    rows = with_group_stats(df.select(*keys, step, value), keys, __m=F.avg(value), __i0=F.min(step), __i1=F.max(step))
    x = F.coalesce(F.col(value) - F.col("__m"), F.lit(0.0))
    rows = rows.select(*keys, (F.col(step) - F.col("__i0")).alias("i"), (F.col("__i1") - F.col("__i0") + 1).alias("n"), x.alias("x"))
    root = F.floor(F.sqrt(F.col("n").cast("double"))).cast("int")
    factor = F.array_max(F.filter(F.sequence(F.lit(1), root), lambda d: F.col("n") % d == 0))
    rows = rows.select(*keys, "i", "n", (F.col("x") * _hann(F.col("i"), F.col("n"))).alias("x"), factor.alias("n1"))
    s = two_stage_transform(rows, keys).withColumnRenamed("__k", "f_idx").filter((F.col("f_idx") >= 1) & (2 * F.col("f_idx") <= F.col("n")))
    sides = F.when(2 * F.col("f_idx") == F.col("n"), 1.0).otherwise(2.0)
    freq = F.col("f_idx") * fs / F.col("n")
    return s.select(*keys, "f_idx", freq.alias("freq"), (1 / freq).alias("period"),
                    (sides * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (fs * F.col("n") * 0.375)).alias("power"))


def two_stage_transform(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`__k`, re and im of sum x exp(2 pi j k i / n) per key for k = 0 .. n-1, in n * (n1 + n2) rows instead of n * n.

    Rows carry the place `i`, the value `x`, the length `n` and a divisor `n1` of n; absent places count 0. With i = n2 i1 + i2
    and k = k1 + n1 k2 the sum over i1 depends on k1 alone, so it is formed once for all k2 and then turned by k1 i2 / n. A
    prime length has n1 = 1, which is the plain sum.
    """
    keys = list(keys)
    n2 = (F.col("n") / F.col("n1")).cast("long")
    part = rows.select(*keys, "n", "n1", "x", F.floor(F.col("i") / n2).alias("__i1"), (F.col("i") % n2).alias("__i2"),
                       F.explode(F.sequence(F.lit(0), F.col("n1").cast("int") - 1)).alias("__k1"))
    a = 2 * math.pi * ((F.col("__i1") * F.col("__k1")) % F.col("n1")) / F.col("n1")
    part = part.groupBy(*keys, "n", "n1", "__i2", "__k1").agg(F.sum(F.col("x") * F.cos(a)).alias("__a"), F.sum(F.col("x") * F.sin(a)).alias("__b"))
    part = part.select("*", F.explode(F.sequence(F.lit(0), (n2 - 1).cast("int"))).alias("__k2"))
    t = 2 * math.pi * ((F.col("__i2") * (F.col("__k1") + F.col("n1") * F.col("__k2"))) % F.col("n")) / F.col("n")
    c, s = F.cos(t), F.sin(t)
    return part.groupBy(*keys, "n", (F.col("__k1") + F.col("n1") * F.col("__k2")).alias("__k")).agg(
        F.sum(F.col("__a") * c - F.col("__b") * s).alias("re"), F.sum(F.col("__a") * s + F.col("__b") * c).alias("im"))


def welch_psd(df: DataFrame, keys: Sequence[str], step: str, value: str, nperseg: int, fs: float = 12.0) -> DataFrame:
    """Mean density over half-overlapping Hann segments, each with its own mean removed; only full segments count.

    Missing steps count 0 after the overall mean is removed. A segment mean c then adds -c at every step, present or
    not; against the window that sum is n/4 at the first frequency and nothing elsewhere.
    """
    half = nperseg // 2
    rows = with_group_stats(df.select(*keys, step, value), keys, __m=F.avg(value), __i0=F.min(step), __i1=F.max(step))
    i = F.col(step) - F.col("__i0")
    last = F.floor((F.col("__i1") - F.col("__i0") + 1 - nperseg) / half)
    lo, hi = F.greatest(F.lit(0), F.ceil((i - nperseg + 1) / half)), F.least(last, F.floor(i / half))
    seg = rows.select(*keys, i.alias("i"), F.coalesce(F.col(value) - F.col("__m"), F.lit(0.0)).alias("x"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    seg = seg.filter("lo <= hi").select(*keys, "i", "x", F.explode(F.sequence("lo", "hi")).alias("seg"))
    seg = seg.withColumn("j", F.col("i") - F.col("seg") * half)
    n = F.lit(float(nperseg))
    factor = max(d for d in range(1, math.isqrt(nperseg) + 1) if nperseg % d == 0)
    placed = seg.select(*keys, "seg", F.col("j").alias("i"), (F.col("x") * _hann(F.col("j"), n)).alias("x"),
                        F.lit(nperseg).cast("long").alias("n"), F.lit(factor).alias("n1"))
    s = two_stage_transform(placed, [*keys, "seg"]).withColumnRenamed("__k", "f_idx").filter(F.col("f_idx").between(1, half))
    sums = seg.groupBy(*keys, "seg").agg(F.sum("x").alias("sx"))
    s = join_keys(s, sums, [*keys, "seg"])
    re = F.col("re") + F.when(F.col("f_idx") == 1, F.col("sx") / n * (nperseg / 4.0)).otherwise(0.0)
    sides = F.when(2 * F.col("f_idx") == nperseg, 1.0).otherwise(2.0)
    p = sides * (re * re + F.col("im") * F.col("im")) / (fs * nperseg * 0.375)
    return s.groupBy(*keys, "f_idx").agg(F.avg(p).alias("power"), F.count(F.lit(1)).alias("n_segments")).withColumns(
        {"freq": F.col("f_idx") * fs / nperseg, "period": nperseg / (F.col("f_idx") * fs)})


def period_grid(low: float, high: float, n: int) -> list[float]:
    """n log-spaced periods from low to high."""
    return [float(p) for p in np.logspace(math.log10(low), math.log10(high), n)]


#: Terms of the expansion inside a bin and bins of a block. With eight bins to the shortest period an angle at twice the
#: frequency moves by at most pi/4 from a bin's middle, so ORDER terms leave less than (pi/4)^ORDER / ORDER! = 7e-12 of a value.
ORDER, BINS_A_PERIOD, BLOCK = 13, 8, 512


def lomb_scargle(df: DataFrame, keys: Sequence[str], time: str, value: str, periods: Sequence[float]) -> DataFrame:
    """Normalised power at the given periods for unevenly timed values (mean removed). Rows may be raw events.

    Rows are reduced to moments of time bins, an eighth of the shortest period wide, before anything is shuffled: within a
    bin exp(i w t) is its value at the middle times a short series in the distance from it. Blocks of up to `BLOCK` bins are
    then turned into sums at all periods by matrix products, and block sums are added up per key and period. Work is
    rows x ORDER + bins x periods. A key without variance has no power (null).
    """
    keys, low = list(keys), min(periods)
    width = low / BINS_A_PERIOD
    t = F.col(time).cast("double")
    rows = df.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), t.alias("t"), F.floor(t / width).alias("bin"))
    rows = rows.withColumn("u", 2 * (F.col("t") / width - F.col("bin") - 0.5))
    power_of = [F.lit(1.0)]
    for _ in range(ORDER - 1):
        power_of.append(power_of[-1] * F.col("u"))
    cells = rows.groupBy(*keys, "bin").agg(*[F.sum(F.col("x") * u).alias(f"x{m}") for m, u in enumerate(power_of)], *[F.sum(u).alias(f"w{m}") for m, u in enumerate(power_of)])
    moments = F.array(*[f"x{m}" for m in range(ORDER)], *[f"w{m}" for m in range(ORDER)])
    blocks = cells.groupBy(*keys, F.floor(F.col("bin") / BLOCK).alias("block")).agg(F.collect_list(F.struct("bin", moments.alias("m"))).alias("bins"))
    blocks = blocks.select(*keys, "block", F.col("bins.bin").alias("bin"), F.flatten("bins.m").alias("m"))
    sums = ("xc", "xs", "wc", "ws", "w2c", "w2s")
    fields = [*df.select(*keys).schema.fields, T.StructField("f_idx", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in sums]]
    found = blocks.mapInArrow(_bin_sums(keys, np.asarray(periods, float), width), T.StructType(fields))
    found = found.groupBy(*keys, "f_idx").agg(*[F.sum(c).alias(c) for c in sums])
    stats = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("xx"))
    if keys:
        m = join_keys(found, stats, keys)
    else:
        one = stats.select(F.struct("n", "mean", "xx").alias("s")).scalar()
        m = found.withColumn("__s", one).select("*", "__s.n", "__s.mean", "__s.xx")
    m = m.withColumns({"xc": F.col("xc") - F.col("mean") * F.col("wc"), "xs": F.col("xs") - F.col("mean") * F.col("ws")})
    sum_cc, sum_ss, sum_cs = (F.col("n") + F.col("w2c")) / 2, (F.col("n") - F.col("w2c")) / 2, F.col("w2s") / 2
    tau = F.atan2(2 * sum_cs, sum_cc - sum_ss) / 2
    ct, st = F.cos(tau), F.sin(tau)
    xc, xs = F.col("xc") * ct + F.col("xs") * st, F.col("xs") * ct - F.col("xc") * st
    cc = ct * ct * sum_cc + 2 * ct * st * sum_cs + st * st * sum_ss
    ss = ct * ct * sum_ss - 2 * ct * st * sum_cs + st * st * sum_cc
    power = ratio(F.coalesce(ratio(xc * xc, cc), F.lit(0.0)) + F.coalesce(ratio(xs * xs, ss), F.lit(0.0)), F.col("xx"))
    grid = F.array(*[F.lit(float(p)) for p in periods])
    return m.select(*keys, "f_idx", F.get(grid, F.col("f_idx")).alias("period"), power.alias("power"))


def _bin_sums(keys: list[str], periods: np.ndarray, width: float):
    """Sums of value and weight times exp(i w t), and of weight times exp(2 i w t), per block and period."""
    steps = np.arange(ORDER)
    factorial = np.array([math.factorial(m) for m in steps], float)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = 2 * math.pi / periods
        turn = 1j * omega[:, None] * width / 2
        once, twice = turn ** steps / factorial, (2 * turn) ** steps / factorial
        held = {"block": None}
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                if held["block"] != block:
                    middle = (block * BLOCK + np.arange(BLOCK) + 0.5) * width
                    held = {"block": block, "wave": np.exp(1j * omega[:, None] * middle)}
                bins = np.asarray(batch.column("bin")[k].values) - block * BLOCK
                m = np.asarray(batch.column("m")[k].values, float).reshape(len(bins), 2 * ORDER)
                wave = held["wave"][:, bins]
                turned = wave @ m
                x, w = (turned[:, :ORDER] * once).sum(1), (turned[:, ORDER:] * once).sum(1)
                w2 = ((wave * wave) @ m[:, ORDER:] * twice).sum(1)
                same = np.full(len(periods), k)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(same)) for c in keys], pa.array(np.arange(len(periods), dtype=np.int32)),
                                                  *[pa.array(np.ascontiguousarray(v)) for z in (x, w, w2) for v in (z.real, z.imag)]],
                                                 [*keys, "f_idx", "xc", "xs", "wc", "ws", "w2c", "w2s"])

    return work


def spectral_peaks(spectrum: DataFrame, keys: Sequence[str], order: str, period: str = "period", power: str = "power", min_ratio: float = 0.1,
                   distance: int = 5, n_peaks: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """Local maxima by prominence: at least `min_ratio` of the largest power, at least `distance` grid steps apart.

    Prominence is the height over the higher of the two lowest points towards the next higher values. Of two maxima closer than
    `distance` the higher stays, of equal ones the later. Rows without a power are left out. A spectrum is as long as its grid:
    all steps are windows over a key's grid and folds over one array of its runs.
    """
    keys, inside = list(keys), spectrum
    if low is not None:
        inside = inside.filter(F.col(period).between(low, high))
    runs = level_runs(inside.withColumn("__item", F.col(period).cast("double")), keys, order, power)
    highest = F.max("__h").over(Window.partitionBy(*keys)).alias("__highest")
    tops = with_prominence(runs.select("*", highest), keys, ["__highest"]).filter((F.col("__before") < F.col("__h")) & (F.col("__after") < F.col("__h")))
    tops = spaced(tops, keys, distance, ["__highest", "prominence"]).filter(F.col("prominence") >= min_ratio * F.col("__highest"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("prominence"), "__at")).cast("bigint")
    return tops.select(*keys, rank.alias("rank"), F.col("__item").alias("period"), F.col("__h").alias("power"), "prominence").filter(F.col("rank") <= n_peaks)


def level_runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """One row per run of equal values in order: `__run`, height `__h`, middle place `__at` (from 0) with its `__item`, and the heights
    `__before` and `__after`, NULL at the ends. The rows of `df` carry the item as `__item`; those without a value are left out."""
    keys, h = list(keys), F.col(value).cast("double")
    rows = df.filter(h.isNotNull() & ~F.isnan(h)).select(*keys, F.col(order).alias("__o"), h.alias("__h"), F.col("__item").alias("__item"))
    w = by_time(keys, "__o")
    rows = rows.withColumns({"__at": F.row_number().over(w) - 1, "__new": F.coalesce((F.lag("__h").over(w) != F.col("__h")).cast("int"), F.lit(1))})
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "__run").agg(F.first("__h").alias("__h"), F.array_sort(F.collect_list(F.struct("__at", "__item"))).alias("__flat"))
    middle = F.get("__flat", F.floor((F.size("__flat") - 1) / 2).cast("int"))
    runs = runs.select(*keys, "__run", "__h", middle["__at"].alias("__at"), middle["__item"].alias("__item"))
    w = by_time(keys, "__run")
    return runs.withColumns({"__before": F.lag("__h").over(w), "__after": F.lead("__h").over(w)})


def with_prominence(runs: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Adds `prominence` to every run of `level_runs`.

    A fold from each side keeps the runs that are still seen from the current one, heights falling, each with the lowest
    height since the one before it; a run takes over the lows of all that it hides.
    """
    keys, names = list(keys), ["__run", "__h", "__at", "__item", "__before", "__after", *carry]
    one = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__runs"))
    seen = "array<struct<h:double,low:double>>"

    def step(state: Column, run: Column) -> Column:
        hidden = F.filter(state["seen"], lambda s: s["h"] <= run["__h"])
        low = F.least(F.array_min(F.transform(hidden, lambda s: s["low"])), run["__h"])
        left = F.filter(state["seen"], lambda s: s["h"] > run["__h"])
        return F.struct(F.concat(left, F.array(F.struct(run["__h"].alias("h"), low.alias("low")))).alias("seen"),
                        F.concat(state["lows"], F.array(low)).alias("lows"))

    def lows(sequence: Column) -> Column:
        start = F.struct(F.array().cast(seen).alias("seen"), F.array().cast("array<double>").alias("lows"))
        return F.aggregate(sequence, start, step, lambda state: state["lows"])

    sides = one.select(*keys, "__runs", lows(F.col("__runs")).alias("__back"), F.reverse(lows(F.reverse("__runs"))).alias("__ahead"))
    rows = sides.select(*keys, F.explode(F.arrays_zip("__runs", "__back", "__ahead")).alias("__r"))
    return rows.select(*keys, *[F.col(f"__r.__runs.{c}").alias(c) for c in names], (F.col("__r.__runs.__h") - F.greatest("__r.__back", "__r.__ahead")).alias("prominence"))


def spaced(tops: DataFrame, keys: Sequence[str], distance: float, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (`__at`, `__h`, `__item`) at least `distance` apart in `__at`: highest first, of equal heights the later first."""
    keys = list(keys)
    first = F.struct((-F.col("__h")).alias("a"), (-F.col("__at")).alias("b"), "__at", "__h", "__item", *carry)
    one = tops.groupBy(*keys).agg(F.array_sort(F.collect_list(first)).alias("__tops"))

    def step(kept: Column, top: Column) -> Column:
        return F.when(F.exists(kept, lambda k: F.abs(k["__at"] - top["__at"]) < distance), kept).otherwise(F.concat(kept, F.array(top)))

    kept = F.aggregate("__tops", F.filter("__tops", lambda _: F.lit(False)), step)
    return one.select(*keys, F.explode(kept).alias("__k")).select(*keys, *[F.col(f"__k.{c}").alias(c) for c in ("__at", "__h", "__item", *carry)])


def acf_peaks(acf: DataFrame, keys: Sequence[str], distance: int, height: float) -> DataFrame:
    """Local maxima of an autocorrelation above `height`, at least `distance` lags apart. NULLs are left out."""
    keys = list(keys)
    runs = level_runs(acf.withColumn("__item", F.col("lag").cast("bigint")), keys, "lag", "acf")
    tops = runs.filter((F.col("__before") < F.col("__h")) & (F.col("__after") < F.col("__h")) & (F.col("__h") >= height))
    return spaced(tops, keys, distance).select(*keys, F.col("__item").alias("lag"), F.col("__h").alias("acf"))


#: Least steps of a block of `morlet_power`.
WAVE_BLOCK = 2048


def morlet_power(df: DataFrame, keys: Sequence[str], step: str, value: str, scales: Sequence[float], omega0: float = 6.0,
                 steps_per_unit: float = 12.0) -> DataFrame:
    """Morlet wavelet power per (time, scale): window half-width 3 scales, period 2 pi s / omega0.

    A series is cut into blocks of steps; a value goes to its block and, near an edge, to the neighbour that its wavelets
    reach, so a row is shuffled twice at most. Inside a block all scales are products in the frequency domain, padded so that
    nothing wraps round. Missing values and steps count 0 after mean removal; only steps that have a row come out.
    """
    keys = list(keys)
    reach = max(int(3 * max(scales)), 1)
    size = max(WAVE_BLOCK, 2 * reach)
    rows = with_group_stats(df.select(*keys, step, value), keys, __m=F.avg(value))
    rows = rows.select(*keys, F.col(step).cast("bigint").alias("at"), F.coalesce(F.col(value) - F.col("__m"), F.lit(0.0)).cast("double").alias("x"))
    blocks = F.explode(F.sequence(F.floor((F.col("at") - reach) / size), F.floor((F.col("at") + reach) / size))).alias("block")
    near = rows.select("*", blocks).groupBy(*keys, "block").agg(F.collect_list(F.struct("at", "x")).alias("r"))
    near = near.select(*keys, "block", F.col("r.at").alias("at"), F.col("r.x").alias("x"))
    fields = [*df.select(*keys).schema.fields, T.StructField("scale", T.DoubleType()), T.StructField("step", T.LongType()), T.StructField("power", T.DoubleType())]
    out = near.mapInArrow(_block_waves(keys, np.asarray(scales, float), omega0, reach, size), T.StructType(fields))
    return out.select("*", (2 * math.pi * F.col("scale") / omega0 / steps_per_unit).alias("period"))


def _block_waves(keys: list[str], scales: np.ndarray, omega0: float, reach: int, size: int):
    length = size + 2 * reach
    padded = 1 << (length + 2 * reach).bit_length()

    def wavelets() -> list[tuple[int, np.ndarray]]:
        out = []
        for s in scales:
            half = max(int(3 * s), 1)
            eta = np.arange(half, -half - 1, -1) / s
            out.append((half, np.fft.fft(np.exp(-eta * eta / 2 + 1j * omega0 * eta), padded)))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = wavelets()
        for batch in batches:
            for k in range(batch.num_rows):
                first = batch.column("block")[k].as_py() * size
                at, x = np.asarray(batch.column("at")[k].values), np.asarray(batch.column("x")[k].values, float)
                own = np.unique(at[(at >= first) & (at < first + size)])
                if not len(own):
                    continue
                dense = np.zeros(padded)
                np.add.at(dense, at - first + reach, x)
                waves = np.fft.fft(dense)
                power = np.stack([np.abs(np.fft.ifft(waves * spectrum)[own - first + reach + half]) ** 2 / (s * math.sqrt(math.pi))
                                  for s, (half, spectrum) in zip(scales, ready)])
                same = pa.array(np.full(power.size, k))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in keys], pa.array(np.repeat(scales, len(own))),
                                                  pa.array(np.tile(own, len(scales))), pa.array(power.ravel())], [*keys, "scale", "step", "power"])

    return work


def dominant_period(power: DataFrame, keys: Sequence[str], low: float, high: float, smooth: int) -> DataFrame:
    """Period of the strongest scale in [low, high] per step and its centred running mean over `smooth` steps."""
    band = power.filter(F.col("period").between(low, high))
    best = band.groupBy(*keys, "step").agg(F.min_by("period", F.struct(-F.col("power"), F.col("period"))).alias("dominant"), F.max("power").alias("peak_power"))
    half = smooth // 2
    frame = by_time(keys, "step").rowsBetween(-half, smooth - half - 1)
    full = F.count(F.lit(1)).over(frame) == smooth
    return best.withColumn("smoothed", F.when(full, F.avg("dominant").over(frame)))


def band_power(power: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Mean power over the scales of a period band per step, and its root as an envelope."""
    band = power.filter(F.col("period").between(low, high)).groupBy(*keys, "step").agg(F.avg("power").alias("band_power"))
    return band.withColumn("envelope", F.sqrt("band_power"))


def epoch_power(band: DataFrame, keys: Sequence[str], epoch: Column, min_steps: int = 12) -> DataFrame:
    """Mean band power per epoch with more than `min_steps` steps."""
    return (band.groupBy(*keys, epoch.alias("epoch")).agg(F.avg("band_power").alias("mean_power"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > min_steps))

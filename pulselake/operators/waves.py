"""Filters, half waves and spectra of the population count, and local rates of events, without any whole-recording task.

A filter is a sum over shifted counts, so only bins with events enter it; half waves
are runs of one sign, numbered by the stitched scan of time chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import binned, dense_counts, n_bins, over, r6, running_sum


def band_kernel(low: float, high: float, taps: int) -> list[float]:
    """Hann-windowed band-pass of 2 ``taps`` + 1 coefficients without a constant part; the band in shares of the Nyquist frequency."""
    k = range(-taps, taps + 1)
    sinc = lambda f, i: f if i == 0 else math.sin(math.pi * f * i) / (math.pi * i)
    hann = [0.5 + 0.5 * math.cos(math.pi * i / (taps + 1)) for i in k]
    h = [(sinc(high, i) - sinc(low, i)) * w for i, w in zip(k, hann, strict=True)]
    mean = sum(h) / sum(hann)
    return [x - mean * w for x, w in zip(h, hann, strict=True)]


def band_passed(df: DataFrame, width: int, low: float, high: float, taps: int) -> DataFrame:
    """(bin, y): the population count of every bin in a band; beyond the ends the recording counts as empty."""
    kernel = band_kernel(low, high, taps)
    steps = F.array(*(F.struct(F.lit(i - taps).alias("step"), F.lit(h).alias("h")) for i, h in enumerate(kernel)))
    x = binned(df, width).groupBy("bin", "n_bins").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(steps))
    y = x.groupBy((F.col("bin") + F.col("k.step")).alias("bin")).agg(F.sum(F.col("n") * F.col("k.h")).alias("y"))
    every = n_bins(df, width).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))
    return every.join(y, "bin", "left").select("bin", F.round(F.coalesce("y", F.lit(0.0)), 9).alias("y"))


def half_waves(df: DataFrame, width: int, low: float, high: float, taps: int, least: int, most: int) -> DataFrame:
    """(start_bin, positive, bins, peak, slope): runs of one sign of the band-passed count, of ``least`` to ``most`` bins.

    The slope is the peak over the bins from the run's beginning to it.
    """
    y = band_passed(df, width, low, high, taps).withColumn("up", (F.col("y") > 0).cast("int"))
    before = y.select((F.col("bin") + 1).alias("bin"), F.col("up").alias("was"))
    turn = F.when(F.col("was") == F.col("up"), 0).otherwise(1)
    x = y.join(before, "bin", "left").select("bin", "y", "up", turn.alias("turn"), (F.col("bin") * width).alias("t_us"), F.col("bin").alias("spike_id"))
    w = running_sum(x, F.col("turn"), "wave")
    g = w.groupBy("wave").agg(F.min("bin").alias("start_bin"), F.max("up").alias("positive"), F.count(F.lit(1)).alias("bins"), F.max_by(F.struct("y", "bin"), F.struct(F.abs("y"), -F.col("bin"))).alias("top"))
    g = g.where(F.col("bins").between(least, most))
    return g.select("start_bin", "positive", "bins", r6("top.y").alias("peak"), r6(F.col("top.y") / (F.col("top.bin") - F.col("start_bin") + 1)).alias("slope"))


def slow_waves(df: DataFrame, width: int, low: float, high: float, taps: int, least: int, most: int) -> DataFrame:
    """Half waves by sign: number, rate per hour, mean length, mean and largest peak."""
    w = half_waves(df, width, low, high, taps, least, most)
    hours = F.broadcast(n_bins(df, width).select((F.col("n_bins") * (width / 3.6e9)).alias("hours")))
    return w.join(hours).groupBy("positive").agg(
        F.count(F.lit(1)).alias("waves"), r6(F.count(F.lit(1)) / F.first("hours")).alias("per_hour"), r6(F.avg("bins")).alias("mean_bins"), r6(F.avg("peak")).alias("mean_peak"),
        r6(F.max(F.abs("peak"))).alias("largest"),
    )


def segment_power(df: DataFrame, width: int, size: int) -> DataFrame:
    """(f, power): mean squared Fourier sums of half-overlapping, detrended, Hann-windowed segments of the population count.

    A segment is a key like any other, and its sums combine before the shuffle; no
    series is gathered. Bins beyond the last whole segment are left out.
    """
    half = size // 2
    x = dense_counts(df, width).join(F.broadcast(n_bins(df, width)))
    seg = F.explode(F.array(F.expr(f"bin div {half}"), F.expr(f"bin div {half} - 1"))).alias("seg")
    x = x.select("bin", "n", "n_bins", seg).where(f"seg >= 0 and seg * {half} + {size} <= n_bins").withColumn("j", F.col("bin") - F.col("seg") * half)
    fit = x.groupBy("seg").agg(F.regr_slope("n", "j").alias("b"), F.regr_intercept("n", "j").alias("a"))
    v = (F.col("n") - F.col("a") - F.col("b") * F.col("j")) * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("j") / size))
    y = x.join(fit, "seg").withColumn("v", v).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    angle = 2 * math.pi * F.col("f") * F.col("j") / size
    s = y.groupBy("seg", "f").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    one = F.when((F.col("f") == 0) | (F.col("f") == size // 2), 1.0).otherwise(2.0)
    return s.groupBy("f").agg((F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.first(one)).alias("power"))


def slow_oscillation(df: DataFrame, width: int, size: int, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Share of the power in each band (from and to which frequency step), its strongest step, and whether the band holds a fifth with a peak above twice the mean."""
    p = segment_power(df, width, size)
    total = F.broadcast(p.agg(F.sum("power").alias("total"), F.avg("power").alias("mean")))
    names = F.array(*(F.struct(F.lit(n).alias("band"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, (a, b) in bands.items()))
    x = p.withColumn("b", F.explode(names)).where("f between b.lo and b.hi").join(total).where("total > 1e-12")
    g = x.groupBy("b.band").agg(F.sum("power").alias("power"), F.first("total").alias("total"), F.first("mean").alias("mean"), F.max(F.struct(F.round("power", 6).alias("p"), (-F.col("f")).alias("f"))).alias("top"))
    share = F.col("power") / F.col("total")
    found = (F.round(share, 9) > 0.2) & (F.col("top.p") > 2 * F.col("mean"))
    return g.select("band", r6(share).alias("share"), (-F.col("top.f")).alias("peak_step"), r6(-F.col("top.f") / (size * width / 1e6) * 1e3).alias("peak_mhz"), found.cast("int").alias("detected"))


def local_rates(df: DataFrame, window: int) -> DataFrame:
    """(spike_id, electrode, n, rate_hz): events of the same channel within half a window on both sides, over the time there is.

    Channels are cut into chunks of time no shorter than the window; each chunk also
    sees the events around its borders, so no task holds a channel.
    """
    half, chunk = window // 2, max(window, 3_600_000_000)
    own = df.select("spike_id", "electrode", "t_us", F.expr(f"t_us div {chunk}").alias("chunk"), F.lit(True).alias("own"))
    low = own.where(F.expr(f"t_us % {chunk}") < half).withColumn("chunk", F.col("chunk") - 1)
    high = own.where(F.expr(f"t_us % {chunk}") >= chunk - half).withColumn("chunk", F.col("chunk") + 1)
    x = own.unionByName(low.withColumn("own", F.lit(False))).unionByName(high.withColumn("own", F.lit(False)))
    near = Window.partitionBy("electrode", "chunk").orderBy("t_us").rangeBetween(-half, half)
    x = x.withColumn("n", F.count(F.lit(1)).over(near)).where("own")
    ends = F.broadcast(df.groupBy("electrode").agg(F.min("t_us").alias("a"), F.max("t_us").alias("z")))
    span = F.greatest(F.least(F.col("t_us") + half, F.col("z")) - F.greatest(F.col("t_us") - half, F.col("a")), F.lit(1))
    return x.join(ends, "electrode").select("spike_id", "electrode", "n", r6(F.col("n") / (span / 1e6)).alias("rate_hz"))


def local_rate_summary(df: DataFrame, window: int, factor: float = 3.0) -> DataFrame:
    """Of each channel the mean and largest local rate, and the share of its events in places ``factor`` times as busy as its own mean."""
    own = F.broadcast(df.groupBy("electrode").agg(over(F.count(F.lit(1)), (F.max("t_us") - F.min("t_us")) / 1e6).alias("mean")))
    x = local_rates(df, window).join(own, "electrode")
    busy = F.avg(F.coalesce((F.col("rate_hz") > factor * F.col("mean")).cast("int"), F.lit(0)))
    return x.groupBy("electrode").agg(r6(F.avg("rate_hz")).alias("mean_local_hz"), r6(F.max("rate_hz")).alias("max_local_hz"), r6(busy).alias("busy_share"))

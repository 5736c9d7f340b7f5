"""Sliding windows, change detection, artifacts, sequences and rhythms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import binned, corr, dense_counts, n_bins, over, pairs_within, r6, windows, with_previous


def nearest_others(df: DataFrame, reach: int) -> DataFrame:
    """(spike_id, before, after): distance to the closest earlier and later event of another channel within ``reach``."""
    x = df.select("spike_id", "electrode", "t_us")
    p = pairs_within(x, x, reach).where("a.electrode <> b.electrode").select(F.col("a.spike_id").alias("spike_id"), (F.col("b.t_us") - F.col("a.t_us")).alias("dt")).where(F.abs("dt") < reach)
    return p.groupBy("spike_id").agg(F.min(F.when(F.col("dt") <= 0, -F.col("dt"))).alias("before"), F.min(F.when(F.col("dt") >= 0, F.col("dt"))).alias("after"))


def evolution_windows(df: DataFrame, length: int, step: int, burst_isi: int, sync: int) -> DataFrame:
    """Rate, burst onsets, variation of intervals and synchrony of every full window, both ends closed.

    The intervals of a window are the recording's own, less the first; a partner
    must lie in the window too, which its distance tells.
    """
    x = with_previous(df).withColumn("isi", F.col("t_us") - F.col("prev_us"))
    pairs = nearest_others(df, sync)
    w = windows(x.join(pairs, "spike_id", "left"), length, step)
    inner = w.withColumn("own", F.when(F.col("prev_us") >= F.col("win_start"), F.col("isi")))
    near = (F.col("t_us") - F.col("before") >= F.col("win_start")) | (F.col("t_us") + F.col("after") <= F.col("win_start") + length)
    before = F.lag("own").over(Window.partitionBy("win").orderBy("t_us", "spike_id"))
    z = inner.withColumn("sync", F.coalesce(near, F.lit(False))).withColumn("onset", F.coalesce((F.col("own") < burst_isi) & (before >= burst_isi), F.lit(False)))
    sec = length / 1e6
    out = z.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.count_if("onset").alias("onsets"), over(F.stddev_pop("own"), F.avg("own")).alias("cv"), F.avg(F.col("sync").cast("int")).alias("sync"))
    return out.select("win", "n", r6(F.col("n") / sec).alias("rate"), F.round(F.col("onsets") / sec, 9).alias("burst_rate"), r6(F.coalesce("cv", F.lit(0.0))).alias("complexity"), r6("sync").alias("synchrony"))


def critical_moments(df: DataFrame, length: int, step: int, bar: float, k: int, **p) -> DataFrame:
    """Windows whose metric departs from the zero-padded five-window mean by ``bar`` local deviations; the k strongest."""
    e = evolution_windows(df, length, step, **p)
    last = F.broadcast(df.agg(F.expr(f"(max(t_us) - {length}) div {step}").alias("last")))
    every = last.where("last >= 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("win"))
    names = ["rate", "burst_rate", "complexity", "synchrony"]
    full = every.join(e, "win", "left").select("win", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    long = full.unpivot("win", names, "metric", "value")
    near = Window.partitionBy("metric").orderBy("win").rowsBetween(-2, 2)
    x = long.withColumn("mean", F.sum("value").over(near) / 5).withColumn("sd", F.greatest(F.stddev_pop("value").over(near), F.lit(1e-10)))
    z = F.round((F.col("value") - F.col("mean")) / F.col("sd"), 4)
    return x.withColumn("z", z).where(F.abs("z") > bar).orderBy(F.desc(F.abs("z")), "metric", "win").limit(k).select("win", "metric", r6("value").alias("value"), r6("mean").alias("mean"), "z")


def window_features(df: DataFrame, width: int) -> DataFrame:
    """Per half-open window and channel: rate, amplitude mean and deviation, variation of intervals."""
    k = F.broadcast(df.agg(F.expr(f"max(t_us) div {width}").alias("k")))
    x = df.join(k).withColumn("win", F.expr(f"t_us div {width}")).where("win < k")
    isi = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("electrode", "win").orderBy("t_us", "spike_id"))
    y = x.withColumn("isi", isi).groupBy("win", "electrode").agg(
        F.count(F.lit(1)).alias("n"), F.avg("amplitude").alias("m"), F.stddev_pop("amplitude").alias("sd"), over(F.stddev_pop("isi"), F.avg("isi")).alias("cv")
    )
    return y.select("win", "electrode", r6(F.col("n") / (width / 1e6)).alias("rate"), r6("m").alias("amp_mean"), r6("sd").alias("amp_std"), r6(F.coalesce("cv", F.lit(0.0))).alias("cv_isi"))


def window_correlations(df: DataFrame, length: int, step: int, width: int, channels: int = 32) -> DataFrame:
    """(win, e1, e2, r): correlation of the counts of each pair within each sliding window of whole bins."""
    per, hop = length // width, step // width
    x = dense_counts(df.where(F.col("electrode") < channels), width, "electrode") if channels < 32 else dense_counts(df, width, "electrode")
    full = F.broadcast(df.agg(F.expr(f"(max(t_us) - {length}) div {step}").alias("last")))
    first = F.greatest(F.lit(0).cast("long"), F.expr(f"(bin - {per - 1} + {hop - 1}) div {hop}"))
    y = x.join(full).withColumn("a", first).withColumn("b", F.least(F.expr(f"bin div {hop}"), F.col("last"))).where("a <= b").withColumn("win", F.explode(F.sequence("a", "b")))
    p, q = y.select("win", "bin", F.col("electrode").alias("e1"), F.col("n").alias("x")), y.select("win", F.col("bin").alias("bin"), F.col("electrode").alias("e2"), F.col("n").alias("y"))
    return p.join(q, ["win", "bin"]).where("e1 < e2").groupBy("win", "e1", "e2").agg(corr("x", "y").alias("r"))


def dynamic_fc(df: DataFrame, **p) -> DataFrame:
    return window_correlations(df, **p).select("win", "e1", "e2", r6("r").alias("r"))


def stable_edges(df: DataFrame, least: float, **p) -> DataFrame:
    """Pairs whose correlation is ``least`` or more on average and varies as the calmest quarter at most."""
    x = window_correlations(df, **p).groupBy("e1", "e2").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"))
    bar = F.broadcast(x.agg(F.expr("percentile(sd, 0.25)").alias("bar")))
    return x.join(bar).select("e1", "e2", r6("m").alias("mean_r"), r6("sd").alias("sd_r"), ((F.round("m", 9) >= least) & (F.col("sd") <= F.col("bar"))).cast("int").alias("stable"))


def phase_windows(df: DataFrame, length: int, step: int, width: int) -> DataFrame:
    """Order (mean absolute correlation), susceptibility (variance of channel counts) and rate of every window."""
    order = window_correlations(df, length, step, width).groupBy("win").agg(F.avg(F.abs("r")).alias("order"))
    per, hop = length // width, step // width
    full = F.broadcast(df.agg(F.expr(f"(max(t_us) - {length}) div {step}").alias("last")))
    x = binned(df, width).join(full).withColumn("a", F.greatest(F.lit(0).cast("long"), F.expr(f"(bin - {per - 1} + {hop - 1}) div {hop}"))).withColumn("b", F.least(F.expr(f"bin div {hop}"), F.col("last")))
    c = x.where("a <= b").withColumn("win", F.explode(F.sequence("a", "b"))).groupBy("win", "electrode").agg(F.count(F.lit(1)).alias("n"))
    k = F.broadcast(df.agg(F.countDistinct("electrode").alias("k")))
    pop = c.join(k).groupBy("win").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.first("k") - F.pow(F.sum("n") / F.first("k"), F.lit(2))).alias("v"))
    return pop.join(order, "win").select("win", "n", r6("order").alias("order_parameter"), r6("v").alias("susceptibility"), r6(F.col("n") / (length / 1e6)).alias("population_rate"))


def change_points(df: DataFrame, length: int, step: int, width: int, k: float = 2.0) -> DataFrame:
    """Windows where the order parameter jumps by more than mean + k deviations of all jumps."""
    x = phase_windows(df, length, step, width).withColumn("jump", F.abs(F.col("order_parameter") - F.lag("order_parameter").over(Window.orderBy("win")))).where("jump is not null")
    bar = F.broadcast(x.agg((F.avg("jump") + k * F.stddev_pop("jump")).alias("bar")))
    return x.join(bar).where("jump > bar").select("win", r6("jump").alias("jump"))


def retention_windows(df: DataFrame, k: int) -> DataFrame:
    """Cosine of the channel counts of each of k equal windows with the first."""
    one = F.broadcast(df.agg((F.max("t_us") + 1).alias("d")))
    c = df.join(one).groupBy(F.expr(f"(t_us * {k}) div d").alias("win"), "electrode").agg(F.count(F.lit(1)).alias("n"))
    norm = c.groupBy("win").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    first = c.where("win = 0").select("electrode", F.col("n").alias("n0"))
    dot = c.join(F.broadcast(first), "electrode").groupBy("win").agg(F.sum(F.col("n") * F.col("n0")).alias("dot"))
    base = F.broadcast(norm.where("win = 0").select(F.col("norm").alias("norm0")))
    return dot.join(norm, "win").join(base).select("win", r6(F.col("dot") / F.col("norm") / F.col("norm0")).alias("similarity"))


def artifact_flags(df: DataFrame, width: int, min_cross: int = 1, fraction: float = 0.5) -> DataFrame:
    """Each event with the channels and groups of its time bin, flagged if too many fire together."""
    e = F.broadcast(df.agg(F.countDistinct("electrode").alias("all_e")))
    x = df.withColumn("slot", F.expr(f"t_us div {width}"))
    c = x.groupBy("slot").agg(F.countDistinct("electrode").alias("n_e"), F.countDistinct("mea").alias("n_g"))
    y = x.join(c, "slot").join(e)
    flag = (F.col("n_g") - 1 >= min_cross) | (F.col("n_e") >= F.greatest(F.lit(2), F.ceil(fraction * F.col("all_e"))))
    return y.select("spike_id", "t_us", "electrode", "mea", "amplitude", "n_e", "n_g", flag.cast("int").alias("flag"))


def artifact_by_group(df: DataFrame, width: int) -> DataFrame:
    x = artifact_flags(df, width)
    med = lambda c: r6(F.expr(f"percentile(amplitude, 0.5) filter (where {c})"))
    return x.groupBy("mea").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("flagged"), r6(F.avg("flag")).alias("fraction"), med("flag = 1").alias("amp_flagged"), med("flag = 0").alias("amp_clean"))


def artifact_clean(df: DataFrame, width: int) -> DataFrame:
    return artifact_flags(df, width).where("flag = 0").select("spike_id", "t_us", "electrode")


def sequence_motifs(df: DataFrame, reach: int, length: int = 3, least: int = 3) -> DataFrame:
    """Ordered runs of distinct channels within ``reach`` among the next events, seen ``least`` times or more.

    Each event looks at length + 2 events from itself on. The scan is ordered in
    chunks of time; each chunk also sees the head of the next.
    """
    day = 86_400_000_000
    own = df.select("spike_id", "t_us", "electrode", F.expr(f"t_us div {day}").alias("chunk"), F.lit(True).alias("own"))
    head = own.where(F.expr(f"t_us % {day}") <= reach).withColumn("chunk", F.col("chunk") - 1).withColumn("own", F.lit(False))
    w = Window.partitionBy("chunk").orderBy("t_us", "spike_id").rowsBetween(0, length + 1)
    x = own.unionByName(head).withColumn("next", F.collect_list(F.struct("t_us", "electrode")).over(w)).where("own")
    near = F.transform(F.filter("next", lambda s: s["t_us"] - F.col("t_us") <= reach), lambda s: s["electrode"])
    y = x.withColumn("seq", F.array_distinct(near)).where(F.size("seq") >= length)
    z = y.withColumn("len", F.explode(F.sequence(F.lit(length), F.least(F.size("seq"), F.lit(5))))).withColumn("key", F.expr("array_join(slice(seq, 1, len), '-')"))
    g = z.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("b")).where(F.col("n") >= least)
    return g.select("key", "n", F.round((F.col("b") - F.col("a")) / (F.col("n") - 1) / 1e6, 3).alias("mean_interval_s"))


def cosinor(df: DataFrame, width: int, period_h: float) -> DataFrame:
    """Single-component cosinor of the population rate: mesor, amplitude, peak hour and explained share."""
    w = 2 * math.pi / period_h
    x = dense_counts(df, width).select((F.col("n") / (width / 1e6)).alias("y"), (F.col("bin") * (width / 3.6e9)).alias("t"))
    x = x.select("y", F.cos(F.col("t") * w).alias("c"), F.sin(F.col("t") * w).alias("s"))
    cov = {k: F.covar_pop(*k).alias("".join(k)) for k in (("c", "c"), ("s", "s"), ("c", "s"), ("c", "y"), ("s", "y"), ("y", "y"))}
    a = x.agg(*cov.values(), F.avg("y").alias("my"), F.avg("c").alias("mc"), F.avg("s").alias("ms"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    a = a.withColumn("b", over(F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs"), det)).withColumn("g", over(F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs"), det))
    phase = F.atan2(F.col("g"), F.col("b")) / w
    return a.select(
        r6(F.col("my") - F.col("b") * F.col("mc") - F.col("g") * F.col("ms")).alias("mesor"), r6(F.hypot("b", "g")).alias("amplitude"),
        r6(F.when(phase < 0, phase + period_h).otherwise(phase)).alias("acrophase_h"), r6(over(F.col("b") * F.col("cy") + F.col("g") * F.col("sy"), "yy")).alias("r_squared"),
    )


def autocorrelation(df: DataFrame, width: int, reach: int) -> DataFrame:
    """Autocorrelation of the population counts, 1 at lag 0."""
    x = dense_counts(df, width)
    m = F.broadcast(x.agg(F.avg("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count(F.lit(1)).alias("k")))
    y = x.join(m).withColumn("d", F.col("n") - F.col("m"))
    other = y.select(F.col("bin").alias("bin"), F.col("d").alias("d2"))
    z = y.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(reach)))).withColumn("bin", F.col("bin") + F.col("lag")).join(other, "bin")
    return z.groupBy("lag").agg(r6(over(F.sum(F.col("d") * F.col("d2")), F.first(F.col("sq") - F.col("k") * F.col("m") * F.col("m")))).alias("r"))


def chi2_periodogram(df: DataFrame, width: int, periods: tuple[int, int]) -> DataFrame:
    """Variance of the folded profile over the whole variance, times the usable bins, for each period in bins."""
    x = dense_counts(df, width)
    n = F.broadcast(n_bins(df, width))
    y = x.join(n).withColumn("p", F.explode(F.sequence(F.lit(periods[0]), F.lit(periods[1])))).where("bin < (n_bins div p) * p")
    fold = y.groupBy("p", F.expr("bin % p").alias("phase")).agg(F.avg("n").alias("m"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count(F.lit(1)).alias("k"))
    z = fold.groupBy("p").agg(F.var_pop("m").alias("v"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("k").alias("k"), F.first("k").alias("cycles"))
    return z.select("p", F.round(F.col("v") * F.col("k") / (F.col("q") / F.col("k") - F.pow(F.col("s") / F.col("k"), F.lit(2))), 4).alias("qp"))


def lif_parameters(df: DataFrame) -> DataFrame:
    """Leaky integrate-and-fire parameters of channels with ten events or more, from intervals in milliseconds."""
    x = with_previous(df, "electrode").withColumn("isi", (F.col("t_us") - F.col("prev_us")) / 1e3)
    isi = F.when(F.col("isi") > 0, F.col("isi"))
    d = F.broadcast(df.agg(F.max("t_us").alias("dur")))
    y = x.join(d).groupBy("electrode").agg(F.count(F.lit(1)).alias("n"), F.avg(isi).alias("m"), F.min(isi).alias("lo"), F.stddev_pop(isi).alias("sd"), F.avg(F.abs("amplitude")).alias("a"), F.first("dur").alias("dur")).where("n >= 10")
    return y.select(
        "electrode", F.round(F.col("m") * 0.3 * (1 + F.col("sd") / F.col("m")), 2).alias("tau_m"), F.round(F.greatest(F.lit(1.0), F.col("lo") * 0.8), 2).alias("tau_ref"),
        F.round(-40 - F.col("a") * 0.05, 4).alias("v_threshold"), F.round(0.5 + F.col("n") / (F.col("dur") / 1e6) * 0.05, 6).alias("i_background"),
    )

"""Bursts, network bursts, avalanches and state epochs, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import binned, corr, dense_counts, n_bins, r6, running_sums, with_previous


def bursts_max_interval(df: DataFrame, begin: int, end: int, gap: int, min_spikes: int, min_duration: int, *by: str) -> DataFrame:
    """(by, start_us, end_us, n, core): bursts by maximum intervals.

    A burst holds a run of at least ``min_spikes`` events with intervals below
    ``begin`` and reaches as far as intervals stay below ``end``; bursts with a gap
    below ``gap`` merge; short ones go. Ordered scans are stitched from chunks.
    """
    step = F.col("t_us") - F.col("prev_us")
    breaks = lambda limit: F.when(step < limit, 0).otherwise(1)
    marked = running_sums(with_previous(df, *by), {"island": breaks(max(begin, end)), "core": breaks(begin)}, *by)
    cores = marked.groupBy(*by, "island", "core").agg(F.count(F.lit(1)).alias("k"), F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    if end >= begin:  # an island is made of its cores
        found = cores.groupBy(*by, "island").agg(F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.max("k").alias("k")).where(F.col("k") >= min_spikes).drop("k")
    else:
        found = cores.where(F.col("k") >= min_spikes).select(*by, F.col("a").alias("start_us"), F.col("b").alias("end_us"))
    order = Window.partitionBy(*by).orderBy("start_us")  # bursts, far fewer than events
    new = F.when(F.col("start_us") - F.lag("end_us").over(order) < gap, 0).otherwise(1)
    merged = found.withColumn("new", new).withColumn("m", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = merged.groupBy(*by, "m").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).where(F.col("end_us") - F.col("start_us") >= min_duration)
    return whole.select(*by, "start_us", "end_us")


def burst_events(df: DataFrame, bursts: DataFrame, bucket: int, *by: str) -> DataFrame:
    """Events within bursts (closed), by an equi-join on the time buckets that a burst covers."""
    spread = bursts.withColumn("__k", F.explode(F.sequence(F.expr(f"start_us div {bucket}"), F.expr(f"end_us div {bucket}"))))
    return df.withColumn("__k", F.expr(f"t_us div {bucket}")).join(spread, [*by, "__k"]).where("t_us between start_us and end_us").drop("__k")


def burst_table(df: DataFrame, begin: int, end: int, gap: int, min_spikes: int, bucket: int) -> DataFrame:
    """Pooled bursts with size, duration, mean and smallest interval."""
    found = bursts_max_interval(df, begin, end, gap, min_spikes, 0)
    x = burst_events(with_previous(df), found, bucket)
    isi = F.when(F.col("t_us") > F.col("start_us"), F.col("t_us") - F.col("prev_us"))
    out = x.groupBy("start_us", "end_us").agg(F.count(F.lit(1)).alias("n"), F.avg(isi).alias("mean_isi"), F.min(isi).alias("peak_isi")).where(F.col("n") >= min_spikes)
    return out.select("start_us", "end_us", "n", r6((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), F.round(F.col("mean_isi") / 1e6, 3).alias("mean_isi_s"), r6(F.col("peak_isi") / 1e6).alias("peak_isi_s"))


def bursts_per_electrode(df: DataFrame, begin: int, end: int, gap: int, min_spikes: int, bucket: int) -> DataFrame:
    """Number of bursts of each channel and the share of its events within them."""
    found = bursts_max_interval(df, begin, end, gap, min_spikes, 0, "electrode")
    inside = burst_events(df, found, bucket, "electrode").groupBy("electrode").agg(F.count(F.lit(1)).alias("inside"), F.countDistinct("start_us").alias("n_bursts"))
    every = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    return every.join(inside, "electrode", "left").select("electrode", F.coalesce("n_bursts", zero).alias("n_bursts"), r6(F.coalesce("inside", zero) / F.col("n")).alias("fraction"))


def network_bursts(df: DataFrame, width: int, min_electrodes: int, per_electrode: int, factor: float, gap: int) -> DataFrame:
    """(burst, start_us, end_us, n_electrodes, n): runs of bins with unusually many active channels.

    The threshold is mean + factor deviations over all bins of the wider grid
    (one more bin than needed, normally empty), at least ``min_electrodes``.
    """
    cut = df.withColumn("bin", F.expr(f"t_us div {width}"))
    active = cut.groupBy("bin", "electrode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= per_electrode).groupBy("bin").agg(F.count(F.lit(1)).alias("k"))
    total = n_bins(df, width).select((F.col("n_bins") + 1).alias("bins"))
    s = active.agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("ss")).join(F.broadcast(total))
    mean = F.col("s") / F.col("bins")
    bar = s.select(F.greatest(mean + factor * F.sqrt(F.greatest(F.col("ss") / F.col("bins") - mean * mean, F.lit(0.0))), F.lit(float(min_electrodes))).alias("bar"))
    hot = active.join(F.broadcast(bar)).where("k >= bar")
    w = Window.orderBy("bin")  # bins over the bar only
    run = hot.withColumn("run", F.col("bin") - F.row_number().over(w)).groupBy("run").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b"))
    order = Window.orderBy("a")
    merged = run.withColumn("new", F.when((F.col("a") - F.lag("b").over(order)) * width < gap, 0).otherwise(1)).withColumn("burst", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = merged.groupBy("burst").agg((F.min("a") * width).alias("start_us"), (F.max("b") * width).alias("end_us"))
    spread = span.withColumn("bin", F.explode(F.sequence(F.expr(f"start_us div {width}"), F.expr(f"end_us div {width} - 1"))))
    return cut.join(spread, "bin")


def network_burst_table(df: DataFrame, **p) -> DataFrame:
    return network_bursts(df, **p).groupBy("burst", "start_us", "end_us").agg(F.countDistinct("electrode").alias("n_electrodes"), F.count(F.lit(1)).alias("n"))


def burst_recruitment(df: DataFrame, **p) -> DataFrame:
    """First event of each channel in each network burst, its latency and rank."""
    first = network_bursts(df, **p).groupBy("burst", "start_us", "electrode").agg(F.min("t_us").alias("first"))
    rank = F.row_number().over(Window.partitionBy("burst").orderBy("first", "electrode"))
    return first.select("burst", "electrode", r6((F.col("first") - F.col("start_us")) / 1e6).alias("latency_s"), rank.alias("rank"))


def burst_leaders(df: DataFrame, **p) -> DataFrame:
    """Participation of each channel, how often it leads, and its mean latency."""
    x = burst_recruitment(df, **p)
    n = F.broadcast(x.agg(F.countDistinct("burst").alias("bursts")))
    return x.join(n).groupBy("electrode").agg(r6(F.count(F.lit(1)) / F.first("bursts")).alias("participation"), F.count_if(F.col("rank") == 1).alias("leads"), r6(F.avg("latency_s")).alias("mean_latency_s"))


def burst_similarity(df: DataFrame, **p) -> DataFrame:
    """Cosine of the channel counts of each pair of network bursts."""
    x = network_bursts(df, **p).groupBy("burst", "electrode").agg(F.count(F.lit(1)).alias("n"))
    norm = x.groupBy("burst").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = x.join(norm, "burst")
    a, b = x.select(F.col("burst").alias("i"), "electrode", F.col("n").alias("x"), F.col("norm").alias("nx")), x.select(F.col("burst").alias("j"), F.col("electrode").alias("electrode"), F.col("n").alias("y"), F.col("norm").alias("ny"))
    return a.join(b, "electrode").where("i < j").groupBy("i", "j").agg(r6(F.sum(F.col("x") * F.col("y")) / F.first("nx") / F.first("ny")).alias("cosine"))


def avalanches(df: DataFrame, width: int) -> DataFrame:
    """(start_bin, size, duration): runs of bins that hold events."""
    x = binned(df, width).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.expr("bin div 4096")
    # row numbers within chunks plus the counts of the chunks before: no task orders all bins
    cut = x.withColumn("chunk", chunk)
    before = cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = cut.join(F.broadcast(before.select("chunk", "before")), "chunk").withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy("chunk").orderBy("bin")) - F.col("before"))
    return placed.groupBy("run").agg(F.min("bin").alias("start_bin"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("duration")).drop("run")


def avalanche_distribution(df: DataFrame, width: int) -> DataFrame:
    return avalanches(df, width).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def branching_ratio(df: DataFrame, width: int) -> DataFrame:
    """Events in the next bin over events in this one, over all bins with events but the last of the grid."""
    x = binned(df, width).groupBy("bin", "n_bins").agg(F.count(F.lit(1)).alias("n"))
    after = x.select((F.col("bin") - 1).alias("bin"), F.col("n").alias("m"))
    r = x.where("bin < n_bins - 1").join(after, "bin", "left").withColumn("r", F.coalesce("m", F.lit(0)) / F.col("n"))
    return r.agg(r6(F.avg("r")).alias("mean"), r6(F.stddev_samp("r")).alias("std"), r6(F.expr("percentile(r, 0.5)")).alias("median"), F.count(F.lit(1)).alias("n"))


def avalanche_scaling(df: DataFrame, width: int, least: int = 3) -> DataFrame:
    """Slope of log mean size against log duration, over durations with enough avalanches."""
    x = avalanches(df, width).groupBy("duration").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("m")).where(F.col("n") >= least)
    d, m = F.log(F.col("duration").cast("double")), F.log("m")
    return x.agg(F.count(F.lit(1)).alias("points"), r6(F.regr_slope(m, d)).alias("gamma"), r6(F.pow(corr(m, d), 2)).alias("r2"))


def powerlaw_mle(df: DataFrame, width: int, least: int = 30) -> DataFrame:
    """Discrete power-law exponent by the lower cut that gives the smallest Kolmogorov-Smirnov distance.

    Works on the counts per size, so the candidates meet the distinct sizes only.
    """
    x = avalanche_distribution(df, width)
    cuts = x.select(F.col("size").alias("xmin"))
    tail = cuts.join(x, F.col("size") >= F.col("xmin"))
    fit = tail.groupBy("xmin").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log(F.col("size") / (F.col("xmin") - 0.5))).alias("l")).where(F.col("k") >= least).withColumn("alpha", 1 + F.col("k") / F.col("l"))
    y = tail.join(fit, "xmin")
    upto = F.sum("n").over(Window.partitionBy("xmin").orderBy("size"))
    model = 1 - F.pow(F.col("size") / F.col("xmin"), 1 - F.col("alpha"))
    y = y.withColumn("hi", upto / F.col("k")).withColumn("lo", (upto - F.col("n") + 1) / F.col("k")).withColumn("cdf", model)
    ks = y.groupBy("xmin", "alpha").agg(F.max(F.greatest(F.abs(F.col("hi") - F.col("cdf")), F.abs(F.col("lo") - F.col("cdf")))).alias("ks"))
    return ks.orderBy(F.round("ks", 9), "xmin").limit(1).select("xmin", r6("alpha").alias("alpha"), r6("ks").alias("ks"))


def updown_states(df: DataFrame, width: int) -> DataFrame:
    """(bin, n, up): population bins above the median rate."""
    x = dense_counts(df, width)
    return x.join(F.broadcast(x.agg(F.expr("percentile(n, 0.5)").alias("med")))).select("bin", "n", (F.col("n") > F.col("med")).alias("up"))


def updown_epochs(df: DataFrame, width: int) -> DataFrame:
    """Runs of equal state: (start_bin, up, bins)."""
    x = updown_states(df, width)
    run = F.row_number().over(Window.orderBy("bin")) - F.row_number().over(Window.partitionBy("up").orderBy("bin"))
    return x.withColumn("run", run).groupBy("up", "run").agg(F.min("bin").alias("start_bin"), F.count(F.lit(1)).alias("bins")).select("start_bin", F.col("up").cast("int").alias("up"), "bins")


def vigilance(df: DataFrame, width: int, per_window: int) -> DataFrame:
    """Windows of bins: variation of the rate, active above median + half a deviation."""
    x = dense_counts(df, width).withColumn("win", F.expr(f"bin div {per_window}"))
    w = x.groupBy("win").agg(F.count(F.lit(1)).alias("k"), (F.stddev_pop("n") / F.avg("n")).alias("cv")).where(F.col("k") == per_window)
    bar = w.agg((F.expr("percentile(cv, 0.5)") + 0.5 * F.stddev_pop("cv")).alias("bar"))
    return w.join(F.broadcast(bar)).select("win", r6("cv").alias("cv"), (F.col("cv") > F.col("bar")).cast("int").alias("active"))


def sleep_pressure(df: DataFrame, width: int, per_window: int) -> DataFrame:
    """Correlation of the running sum of UP shares with the next window's DOWN share."""
    x = updown_states(df, width).withColumn("win", F.expr(f"bin div {per_window}")).groupBy("win").agg(F.count(F.lit(1)).alias("k"), F.avg(F.col("up").cast("int")).alias("up")).where(F.col("k") == per_window)
    order = Window.orderBy("win")
    y = x.withColumn("run", F.sum("up").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("down", 1 - F.lead("up").over(order)).where("down is not null")
    return y.agg(F.count(F.lit(1)).alias("windows"), r6(corr("run", "down")).alias("r"))

"""Adaptive grids, samples, network structure, tests of power laws, evolution of bursts, adaptation and surprise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bursts import avalanche_distribution, avalanches, bursts_max_interval, network_burst_table, powerlaw_mle
from .graph import node_degree
from .grid import binned, dense_counts, over, r6, span


def adaptive_grid(df: DataFrame, ideal_us: int = 1000, most_bins: int = 100_000) -> DataFrame:
    """Bin width that keeps the grid within ``most_bins``, window by duration, and the avalanche bin.

    The avalanche bin is the geometric mean of the channels' mean intervals, within
    0.5 and 50 ms; a channel's mean interval needs its first and last event only. A
    channel of one event has none; where no channel has one, the pooled events' does.
    """
    per = df.groupBy("electrode").agg(over(F.max("t_us") - F.min("t_us"), F.count(F.lit(1)) - 1).alias("m"))
    own = per.where("m > 0").agg(F.exp(F.avg(F.log("m"))).alias("m"))
    mean = F.coalesce("m", F.nullif(over("dur", F.col("n_all") - 1), F.lit(0.0)))
    dur = F.col("dur") / 1e6
    window = F.when(dur <= 3600, 1.0).when(dur <= 12 * 3600, 60.0).otherwise(300.0)
    return span(df).join(own).where("n_all > 0").select(r6(dur).alias("duration_s"), r6(F.greatest(F.lit(ideal_us / 1e6), dur / most_bins)).alias("bin_s"), window.alias("window_s"), r6(F.when(mean.isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(50.0), mean / 1e3)))).alias("avalanche_ms"))


def stratified_sample(df: DataFrame, share: float) -> DataFrame:
    """Events of which each channel keeps the same share, chosen by a digest of spike_id: no sort, no channel in one task."""
    place = F.conv(F.substring(F.md5(F.col("spike_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(place < int(share * (1 << 32)))


def stratified_counts(df: DataFrame, share: float) -> DataFrame:
    """Events of each channel before and after the sample."""
    kept = stratified_sample(df, share).groupBy("electrode").agg(F.count(F.lit(1)).alias("kept"))
    return df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n")).join(kept, "electrode", "left").select("electrode", "n", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


def sample_windows(df: DataFrame, count: int, length: int) -> DataFrame:
    """Evenly spaced windows over the recording; one that is all of it where that is short."""
    step = (F.col("dur") - length) / max(count - 1, 1)
    every = span(df).select("dur", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("win"))
    short = F.col("dur") <= 1.5 * count * length
    start = F.when(short, 0.0).otherwise(F.col("win") * step)
    return every.where(~short | (F.col("win") == 0)).select("win", r6(start / 1e6).alias("start_s"), r6(F.when(short, F.col("dur").cast("double")).otherwise(start + length) / 1e6).alias("end_s"))


def variable_electrodes(df: DataFrame, width: int, k: int) -> DataFrame:
    """The k channels whose occupancy of bins varies most, the smaller channel first on a tie."""
    held = binned(df, width).select("electrode", "bin", "n_bins").distinct().groupBy("electrode").agg((F.count(F.lit(1)) / F.first("n_bins")).alias("p"))
    x = held.select("electrode", r6(F.col("p") * (1 - F.col("p"))).alias("variance"))
    return x.orderBy(F.desc("variance"), "electrode").limit(k)


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at the two ends of the edges, about their common mean."""
    d = node_degree(edges).select("electrode", "degree")
    ends = edges.join(d.select(F.col("electrode").alias("e1"), F.col("degree").alias("a")), "e1").join(d.select(F.col("electrode").alias("e2"), F.col("degree").alias("b")), "e2")
    x = ends.agg(*[F.avg(e).alias(n) for n, e in {"a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")}.items()], F.count(F.lit(1)).alias("edges"))
    m = (F.col("a") + F.col("b")) / 2
    about = lambda pair, p, q: F.col(pair) - m * (F.col(p) + F.col(q)) + m * m
    spread = F.sqrt(about("aa", "a", "a") * about("bb", "b", "b"))
    return x.select("edges", r6(F.when((F.col("edges") >= 2) & (spread > 1e-12), about("ab", "a", "b") / spread).otherwise(0.0)).alias("assortativity"))


def participation(edges: DataFrame, per_block: int = 8) -> DataFrame:
    """How evenly each channel's strength is spread over the blocks of channels."""
    w = F.abs("r").alias("w")
    both = edges.select(F.col("e1").alias("u"), F.col("e2").alias("v"), w).unionByName(edges.select(F.col("e2").alias("u"), F.col("e1").alias("v"), w))
    per = both.groupBy("u", F.expr(f"v div {per_block}").alias("g")).agg(F.sum("w").alias("w"))
    return per.groupBy(F.col("u").alias("electrode")).agg(r6(1 - F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), 2)).alias("participation"))


def betti_numbers(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Components, independent cycles, and four-cliques of uneven distances (1 - |r|) of the network at one threshold.

    Channels squared at most meet in the one task.
    """
    eps = 1 - threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.e1))
        place = {e: i for i, e in enumerate(names)}
        real = pdf[pdf.e2.notna()]
        near = np.zeros((len(names), len(names)), bool)
        dist = np.ones(near.shape)
        for a, b, r in zip(real.e1, real.e2.astype(int), real.r, strict=True):
            i, j = place[a], place[b]
            near[i, j] = near[j, i] = True
            dist[i, j] = dist[j, i] = 1 - abs(r)
        reach = near | np.eye(len(names), dtype=bool)
        for _ in range(max(len(names), 2).bit_length()):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        parts = len({row.tobytes() for row in reach})
        hollow = 0
        later = [np.flatnonzero(near[i] & (np.arange(len(names)) > i)) for i in range(len(names))]
        for i, mine in enumerate(later):
            for j in mine:
                both = mine[(mine > j) & near[j, mine]]
                for k in both:
                    for m in both[(both > k) & near[k, both]]:
                        sides = [dist[x, y] for x, y in ((i, j), (i, k), (i, m), (j, k), (j, m), (k, m))]
                        hollow += bool(np.std(sides) > 0.3 * eps)
        m = len(real)
        return pd.DataFrame({"beta0": [parts], "beta1": [max(0, m - len(names) + parts)], "beta2": [hollow], "edges": [m]})

    alone = nodes.select(F.col("electrode").alias("e1")).distinct().select("e1", F.lit(None).cast("int").alias("e2"), F.lit(None).cast("double").alias("r"))
    return edges.select("e1", "e2", "r").unionByName(alone).groupBy().applyInPandas(run, "beta0 long, beta1 long, beta2 long, edges long")


def powerlaw_tests(df: DataFrame, width: int) -> DataFrame:
    """Log-likelihood ratio of the avalanche sizes' power law against an exponential and a lognormal, and its z.

    Only the counts per size take part.
    """
    fit = powerlaw_mle(df, width).select("xmin", "alpha")
    x = avalanche_distribution(df, width).join(F.broadcast(fit)).where("size >= xmin").withColumn("l", F.log(F.col("size").cast("double"))).withColumn("s", F.col("size") - F.col("xmin") + 0.5)
    n = F.sum("n")
    mu, var = F.sum(F.col("n") * F.col("l")) / n, F.sum(F.col("n") * F.col("l") * F.col("l"))
    m = x.agg(n.alias("k"), (n / F.sum(F.col("n") * F.col("s"))).alias("lam"), mu.alias("mu"), F.sqrt((var - n * mu * mu) / (n - 1)).alias("sd"))
    y = x.join(F.broadcast(m)).where("k >= 10 and sd > 1e-12")
    power = -F.col("alpha") * F.col("l") + F.log(F.col("alpha") - 1) + (F.col("alpha") - 1) * F.log(F.col("xmin") - 0.5)
    log_normal = -F.col("l") - F.log(F.col("sd")) - 0.5 * F.log(F.lit(2 * np.pi)) - 0.5 * F.pow((F.col("l") - F.col("mu")) / F.col("sd"), 2)
    y = y.withColumn("d1", power - (F.log("lam") - F.col("lam") * F.col("s"))).withColumn("d2", power - log_normal)
    out = []
    for name, d, ddof in (("exponential", "d1", 0), ("lognormal", "d2", 1)):
        total, squares = F.sum(F.col("n") * F.col(d)), F.sum(F.col("n") * F.col(d) * F.col(d))
        sd = F.sqrt((squares - total * total / n) / (n - ddof))
        out.append(y.agg(F.coalesce(n, F.lit(0).cast("long")).alias("tail"), F.round(total, 4).alias("ratio"), F.round(total / (sd * F.sqrt(n)), 4).alias("z")).select(F.lit(name).alias("alternative"), "tail", "ratio", "z"))
    return out[0].unionByName(out[1])


def criticality_deviation(df: DataFrame, width: int, size_exponent: float = 1.5, duration_exponent: float = 2.0) -> DataFrame:
    """Mean ratio of predicted to measured mean size by duration, with the exponent that the two exponents predict."""
    gamma = (duration_exponent - 1) / (size_exponent - 1)
    x = avalanches(df, width).groupBy("duration").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("m")).where("n >= 2").withColumn("p", F.pow(F.col("duration").cast("double"), F.lit(gamma)))
    scale = F.broadcast(x.agg((F.sum("m") / F.sum("p")).alias("scale")))
    kappa = x.join(scale).agg(F.count(F.lit(1)).alias("durations"), F.avg(F.col("p") * F.col("scale") / F.col("m")).alias("kappa")).where("durations >= 3")
    verdict = F.when(F.col("kappa").between(0.9, 1.1), "critical").when(F.col("kappa") < 0.9, "subcritical").otherwise("supercritical")
    return kappa.select("durations", F.round("kappa", 4).alias("kappa"), verdict.alias("verdict"))


def criticality_windows(df: DataFrame, width: int, per_window: int) -> DataFrame:
    """Avalanches by the window that they start in: number, mean size and duration, largest size."""
    x = avalanches(df, width).groupBy(F.expr(f"start_bin div {per_window}").alias("win"))
    return x.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("size")).alias("mean_size"), r6(F.avg("duration")).alias("mean_duration"), F.max("size").alias("largest"))


def burst_evolution(df: DataFrame, window: int, **p) -> DataFrame:
    """Network bursts by the window that they start in, windows without one too."""
    found = network_burst_table(df, **p).groupBy(F.expr(f"start_us div {window}").alias("win")).agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("end_us") - F.col("start_us")) / 1e6).alias("d"), F.avg("n_electrodes").alias("e"))
    every = span(df).select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"dur div {window}"))).alias("win"))
    return every.join(found, "win", "left").select("win", F.coalesce("k", F.lit(0).cast("long")).alias("n_bursts"), r6("d").alias("mean_duration_s"), r6("e").alias("mean_electrodes"))


def block_bursts(df: DataFrame, begin: int, end: int, gap: int, min_spikes: int) -> DataFrame:
    """Bursts of each block of channels: number, rate a minute, mean duration, and how far the number is from the blocks' mean."""
    found = bursts_max_interval(df, begin, end, gap, min_spikes, 0, "mea").groupBy("mea").agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("end_us") - F.col("start_us")) / 1e6).alias("d"))
    x = df.select("mea").distinct().join(found, "mea", "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
    mean = F.broadcast(x.agg(F.avg("k").alias("mean")))
    return x.join(mean).join(F.broadcast(span(df).select("dur"))).select("mea", F.col("k").alias("n_bursts"), r6(over("k", F.col("dur") / 6e7)).alias("per_minute"), r6("d").alias("mean_duration_s"), r6(F.col("k") - F.col("mean")).alias("above_mean"))


def _levels(df: DataFrame, width: int) -> DataFrame:
    """(bin, n, level): population counts in three levels, cut at their 33rd and 66th percentiles."""
    x = dense_counts(df, width)
    q = F.broadcast(x.agg(F.expr("percentile(n, array(0.33, 0.66))").alias("q")))
    level = (F.col("n") >= F.get("q", F.lit(0))).cast("int") + (F.col("n") >= F.get("q", F.lit(1))).cast("int")
    return x.join(q).select("bin", "n", level.alias("level"))


def mismatch_response(df: DataFrame, width: int, least: int = 3) -> DataFrame:
    """Runs of one activity level: slope of the activity along the run, and the following bin over the run's last."""
    x = _levels(df, width)  # a row a bin, whatever the number of events
    run = F.row_number().over(Window.orderBy("bin")) - F.row_number().over(Window.partitionBy("level").orderBy("bin"))
    after = x.select((F.col("bin") - 1).alias("last"), F.col("n").alias("next"))
    runs = x.withColumn("run", run).groupBy("level", "run").agg(F.min("bin").alias("start_bin"), F.max("bin").alias("last"), F.count(F.lit(1)).alias("reps"), F.regr_slope("n", "bin").alias("slope"), F.max_by("n", "bin").alias("end_n")).where(F.col("reps") >= least)
    return runs.join(after, "last", "left").select("start_bin", "level", "reps", r6("slope").alias("slope"), r6(F.when(F.col("end_n") > 0, F.col("next") / F.col("end_n"))).alias("boost"))


def bayesian_surprise(df: DataFrame, width: int, per_window: int) -> DataFrame:
    """Divergence of each window's distribution of activity levels from that of the window before, with one count added to each level of either."""
    c = _levels(df, width).groupBy(F.expr(f"bin div {per_window}").alias("win"), "level").agg(F.count(F.lit(1)).alias("n"))
    now, old = c.select("win", "level", F.col("n").alias("a")), c.select((F.col("win") + 1).alias("win"), "level", F.col("n").alias("b"))
    both = now.join(old, ["win", "level"], "full_outer").na.fill(0, ["a", "b"])
    t = both.groupBy("win").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("k")).where("ta > 0 and tb > 0 and k >= 2")
    p, q = (F.col("a") + 1) / (F.col("ta") + F.col("k")), (F.col("b") + 1) / (F.col("tb") + F.col("k"))
    return both.join(t, "win").groupBy("win").agg(r6(F.greatest(F.sum(p * F.log(p / q)), F.lit(0.0))).alias("surprise"), F.first("k").cast("int").alias("levels"))

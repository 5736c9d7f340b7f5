"""Burst shapes, trends, state landscapes, forgetting, surprise and other views of change."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bursts import network_bursts
from .evolution import evolution_windows, window_correlations
from .grid import corr, dense_counts, n_bins, over, r6, with_previous
from .pairs import states, transfer_entropy


def burst_profiles(df: DataFrame, parts: int = 20, **network) -> DataFrame:
    """Share of each network burst's events in each of ``parts`` equal steps of its duration."""
    x = network_bursts(df, **network)
    at = F.least(F.expr(f"((t_us - start_us) * {parts}) div (end_us - start_us)"), F.lit(parts - 1))
    total = F.sum("n").over(Window.partitionBy("burst"))
    return x.groupBy("burst", at.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("burst", "part", "n", r6(F.col("n") / total).alias("share"))


def mea_bins(df: DataFrame, width: int, factor: float) -> DataFrame:
    """Per block: bins whose active channels reach the block's mean + factor deviations over its grid, and their share."""
    active = df.groupBy("mea", F.expr(f"t_us div {width}").alias("bin")).agg(F.countDistinct("electrode").alias("k"), F.count(F.lit(1)).alias("n"))
    one = F.broadcast(n_bins(df, width))
    s = active.join(one).groupBy("mea").agg((F.sum("k") / F.first("n_bins")).alias("m"), (F.sum(F.col("k") * F.col("k")) / F.first("n_bins")).alias("q"), F.first("n_bins").alias("bins"))
    bar = s.select("mea", "bins", (F.col("m") + factor * F.sqrt(F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0)))).alias("bar"))
    hot = active.join(F.broadcast(bar), "mea").where("round(k - bar, 9) >= 0")
    return hot.groupBy("mea").agg(F.count(F.lit(1)).alias("hot_bins"), F.sum("n").alias("events"), r6(F.count(F.lit(1)) / F.first("bins")).alias("share"))


def trends(df: DataFrame, **evolution) -> DataFrame:
    """Slope per window and explained share of each metric over the sliding windows."""
    names = ["rate", "complexity", "synchrony"]
    long = evolution_windows(df, **evolution).unpivot("win", names, "metric", "value")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("windows"), F.round(F.regr_slope("value", F.col("win")) * 1000, 6).alias("slope_e3"), r6(F.pow(corr("value", "win"), 2)).alias("r2"))


def multiscale_states(df: DataFrame, widths: list[int]) -> DataFrame:
    """Per bin width: share of bins above the median, state changes, and variation of the rate."""
    out = None
    for width in widths:
        x = dense_counts(df, width)
        m = F.broadcast(x.agg(F.expr("percentile(n, 0.5)").alias("med")))
        y = x.join(m).withColumn("up", (F.col("n") > F.col("med")).cast("int"))
        other = y.select((F.col("bin") + 1).alias("bin"), F.col("up").alias("was"))
        z = y.join(other, "bin", "left").agg(F.avg("up").alias("up"), F.count_if(F.col("up") != F.col("was")).alias("changes"), over(F.stddev_pop("n"), F.avg("n")).alias("cv"))
        row = z.select(F.lit(width // 1_000_000).alias("width_s"), r6("up").alias("up_fraction"), "changes", r6("cv").alias("cv"))
        out = row if out is None else out.unionByName(row)
    return out


def bimodality(df: DataFrame, width: int) -> DataFrame:
    """(skewness squared + 1) / kurtosis of the population counts, from the plain moments."""
    x = dense_counts(df, width)
    m = F.broadcast(x.agg(F.avg("n").alias("m")))
    d = F.col("n") - F.col("m")
    y = x.join(m).agg(F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"))
    skew, kurt = over("m3", F.pow("m2", F.lit(1.5))), over("m4", F.col("m2") * F.col("m2"))
    return y.select(r6(skew).alias("skewness"), r6(kurt).alias("kurtosis"), r6(over(skew * skew + 1, kurt)).alias("bimodality"))


def repeated_events(df: DataFrame, width: int) -> DataFrame:
    """Bins above mean + one deviation, numbered in time, with the response against the first of them."""
    x = dense_counts(df, width)
    bar = F.broadcast(x.agg((F.avg("n") + F.stddev_pop("n")).alias("bar")))
    hot = x.join(bar).where("n > bar").select("bin", "n")  # far fewer than bins
    order = Window.orderBy("bin")
    return hot.select(F.row_number().over(order).alias("event"), "bin", "n", r6(F.col("n") / F.first("n").over(order)).alias("relative"))


def information_flow(df: DataFrame, width: int) -> DataFrame:
    """Outgoing, incoming and net transfer entropy of each channel."""
    x = transfer_entropy(df, width, 2)
    both = x.select(F.col("e1").alias("electrode"), F.col("te").alias("out"), F.lit(0.0).alias("into")).unionByName(x.select(F.col("e2").alias("electrode"), F.lit(0.0).alias("out"), F.col("te").alias("into")))
    s = both.groupBy("electrode").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return s.select("electrode", r6("out").alias("out"), r6("into").alias("into"), r6(F.col("out") - F.col("into")).alias("net"))


def forgetting(df: DataFrame, windows: int, width: int) -> DataFrame:
    """Distance (1 - cosine) of the absolute pair correlations of each two of ``windows`` equal windows."""
    x = dense_counts(df, width, "electrode").join(F.broadcast(n_bins(df, width))).withColumn("win", F.expr(f"(bin * {windows}) div n_bins"))
    a, b = x.select("win", "bin", F.col("electrode").alias("e1"), F.col("n").alias("x")), x.select(F.col("win").alias("win"), F.col("bin").alias("bin"), F.col("electrode").alias("e2"), F.col("n").alias("y"))
    r = a.join(b, ["win", "bin"]).where("e1 < e2").groupBy("win", "e1", "e2").agg(F.coalesce(F.abs(corr("x", "y")), F.lit(0.0)).alias("r"))
    p, q = r.select(F.col("win").alias("a"), "e1", "e2", F.col("r").alias("x")), r.select(F.col("win").alias("b"), F.col("e1").alias("e1"), F.col("e2").alias("e2"), F.col("r").alias("y"))
    cos = over(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))))
    return p.join(q, ["e1", "e2"]).where("a < b").groupBy("a", "b").agg(r6(F.when(cos.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cos)))).alias("distance"))


def state_landscape(df: DataFrame, width: int, least: int = 2) -> DataFrame:
    """States of all channels seen ``least`` times or more: visits, energy (-log2 of the share) and entries."""
    x = states(df, width)
    other = x.select((F.col("bin") + 1).alias("bin"), F.col("state").alias("was"))
    n = F.broadcast(n_bins(df, width))
    y = x.join(other, "bin", "left").join(n).groupBy("state").agg(F.count(F.lit(1)).alias("visits"), F.count_if(F.coalesce(F.col("was") != F.col("state"), F.lit(True))).alias("entries"), F.first("n_bins").alias("bins"))
    return y.where(F.col("visits") >= least).select("state", "visits", r6(-F.log2(F.col("visits") / F.col("bins"))).alias("energy"), "entries", r6(F.col("visits") / F.col("entries")).alias("mean_dwell"))


def snapshot(df: DataFrame, window: int) -> DataFrame:
    """One row: counts, rate, pooled interval mean and variation, amplitude figures, and four-event clusters within ``window``."""
    x = with_previous(df).withColumn("isi", F.col("t_us") - F.col("prev_us"))
    # the fourth event on: intervals of the last three summed, in chunks of time with the tail of the chunk before
    day = 86_400_000_000
    own = x.select("spike_id", "t_us", F.expr(f"t_us div {day}").alias("chunk"), F.lit(True).alias("own"))
    head = own.where(F.expr(f"t_us % {day}") < window).withColumn("chunk", F.col("chunk") - 1).withColumn("own", F.lit(False))
    ahead = F.lead("t_us", 3).over(Window.partitionBy("chunk").orderBy("t_us", "spike_id"))
    clusters = own.unionByName(head).withColumn("ahead", ahead).where("own").agg(F.count_if(F.col("ahead") - F.col("t_us") < window).alias("clusters"))
    y = x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("electrode").alias("electrodes"), F.max("t_us").alias("dur"), F.avg("isi").alias("m"), F.stddev_pop("isi").alias("sd"), F.avg("amplitude").alias("am"), F.stddev_pop("amplitude").alias("asd"))
    return y.join(clusters).select("n", "electrodes", r6(over("n", F.col("dur") / 1e6)).alias("rate_hz"), r6(F.col("m") / 1e6).alias("isi_mean_s"), r6(over("sd", "m")).alias("isi_cv"), r6("am").alias("amp_mean"), r6("asd").alias("amp_std"), "clusters")


def surprise(df: DataFrame, width: int) -> DataFrame:
    """Per bin of digitised population count: chance of the next level given this one, and its surprise."""
    x = dense_counts(df, width)
    q = F.broadcast(x.agg(F.expr("percentile(n, array(0.25, 0.5, 0.75))").alias("q")))
    lev = sum(((F.col("n") > F.get("q", F.lit(i))).cast("int") for i in range(3)), F.lit(0))
    y = x.join(q).select("bin", lev.alias("s"))
    nxt = y.select((F.col("bin") - 1).alias("bin"), F.col("s").alias("f"))
    t = y.join(nxt, "bin").groupBy("s", "f").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("s"))
    return t.select("s", "f", "n", r6(p).alias("p"), r6(-F.log2(p)).alias("surprise"))


def _poisson_tail(k: int, mean: float) -> float:
    """P(X >= k) of a Poisson variable; beyond the mean the terms from k on fall off fast."""
    if mean <= 0:
        return 1.0 if k <= 0 else 1e-300
    log = lambda i: i * math.log(mean) - mean - math.lgamma(i + 1)
    if k <= mean:
        return max(1 - math.fsum(math.exp(log(i)) for i in range(k)), 1e-300)
    term = total = math.exp(log(k))
    while term > total * 1e-16 and term > 0:
        k += 1
        term *= mean / k
        total += term
    return max(total, 1e-300)


def _by_channel(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(sorted times in seconds) -> columns`` for each channel: greedy scans that SQL does not express."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fn(np.sort(pdf.t_us.to_numpy()) / 1e6))
        out.insert(0, "electrode", np.int32(key[0]))
        return out

    return df.select("electrode", "t_us").groupBy("electrode").applyInPandas(run, f"electrode int, {schema}")


def bursts_poisson_surprise(df: DataFrame, bar: float = 3.0, least: int = 3) -> DataFrame:
    """Bursts grown event by event, however many, while the Poisson surprise against the channel's mean rate rises."""

    def fn(t: np.ndarray) -> dict:
        out, i = [], 0
        rate = len(t) / max(t[-1] - t[0], 1e-9) if len(t) > 1 else 0.0
        isi = np.diff(t)
        while i + least <= len(t):
            if rate == 0 or (isi[i : i + least - 1] > 0.5 / rate).any():
                i += 1
                continue
            best, end = -1.0, i
            for j in range(i + least - 1, len(t)):
                s = -math.log10(_poisson_tail(j - i, rate * (t[j] - t[i])))
                if s < best:
                    break
                best, end = s, j
            if best >= bar:
                out.append((t[i], t[end], end - i + 1, best))
                i = end + 1
            else:
                i += 1
        return dict(zip(("start_s", "end_s", "n", "surprise"), zip(*out, strict=True) if out else ((), (), (), ()), strict=True))

    return _by_channel(df, fn, "start_s double, end_s double, n long, surprise double")


def bursts_rank_surprise(df: DataFrame, bar: float = 2.0, least: int = 3, share: float = 0.25) -> DataFrame:
    """Runs of intervals in the lowest ``share``, scored by the normal approximation of their rank sum."""

    def fn(t: np.ndarray) -> dict:
        isi, out = np.diff(t), []
        n = len(isi)
        rank = pd.Series(isi).rank().to_numpy() if n else isi
        low = np.flatnonzero(np.diff(np.concatenate([[0], (isi <= np.quantile(isi, share)).astype(int), [0]]))) if n else np.zeros(0, int)
        for a, b in zip(low[::2], low[1::2], strict=True):
            q = b - a
            if q + 1 >= least:
                z = (rank[a:b].sum() - q * (n + 1) / 2) / math.sqrt(q * (n + 1) * max(n - q, 1) / 12)
                s = -math.log10(max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300))
                if s >= bar:
                    out.append((t[a], t[b], q + 1, s))
        return dict(zip(("start_s", "end_s", "n", "surprise"), zip(*out, strict=True) if out else ((), (), (), ()), strict=True))

    return _by_channel(df, fn, "start_s double, end_s double, n long, surprise double")


def estimated_stimuli(df: DataFrame, bucket: int, least: int, gap: int) -> DataFrame:
    """Likely stimulus times: buckets of ``bucket`` with ``least`` events or more, none closer than ``gap`` to the one before it kept.

    Buckets are counted in parallel; the greedy choice sees the dense buckets alone.
    """
    hot = df.groupBy((F.expr(f"t_us div {bucket}") * bucket).alias("t_us")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for t, n in pdf.sort_values("t_us").itertuples(index=False):
            if last is None or t - last >= gap:
                kept.append((t, n))
                last = t
        return pd.DataFrame(kept, columns=["t_us", "n"])

    return hot.groupBy().applyInPandas(run, "t_us long, n long")


def betti_curve(df: DataFrame, windows: int, thresholds: int) -> DataFrame:
    """Components of the windows' normalised count vectors at each distance threshold, from the deaths of components."""
    from .signal import persistence

    d = persistence(df, windows)
    steps = df.sparkSession.range(1, thresholds + 1).select((F.col("id") * (1.5 / thresholds)).alias("threshold"))
    return steps.join(F.broadcast(d), F.col("death") > F.col("threshold"), "left").groupBy(r6("threshold").alias("threshold")).agg((F.count("death") + 1).alias("components"))


def representational_similarity(df: DataFrame, length: int, step: int, width: int) -> DataFrame:
    """Correlation, over channel pairs, of the pair correlations of neighbouring windows."""
    r = window_correlations(df, length, step, width).select("win", "e1", "e2", F.coalesce("r", F.lit(0.0)).alias("r"))
    nxt = r.select((F.col("win") - 1).alias("win"), F.col("e1").alias("e1"), F.col("e2").alias("e2"), F.col("r").alias("s"))
    return r.join(nxt, ["win", "e1", "e2"]).groupBy("win").agg(r6(corr("r", "s")).alias("similarity"))

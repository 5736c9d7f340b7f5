"""Causal strength of states, synchrony states, rhythms on a frequency grid, detection in raw signals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bursts import bursts_max_interval
from .grid import dense_counts, over, r6, span
from .pairs import transfer_entropy, transitions
from .signal import analytic, whole_matrix


def effective_information(df: DataFrame, width: int) -> DataFrame:
    """Entropy of the mean effect less the mean entropy of effects, with all observed causes alike; determinism and degeneracy."""
    t = transitions(df, width).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("s")))
    k = F.broadcast(t.agg(F.countDistinct("s").alias("k"), F.countDistinct("f").alias("m")))
    mean = t.groupBy("f").agg(F.sum("p").alias("q")).join(k)
    q = F.col("q") / F.col("k")
    effect = mean.agg((-F.sum(q * F.log2(q))).alias("h"), F.first("k").alias("k"), F.first("m").alias("m"))
    noise = t.agg((-F.sum(F.col("p") * F.log2("p"))).alias("c"))
    x = effect.join(noise).withColumn("noise", F.col("c") / F.col("k"))
    top = F.greatest(F.log2(F.col("m").cast("double")), F.lit(1e-12))
    return x.select(F.col("k").alias("causes"), r6(F.col("h") - F.col("noise")).alias("ei"), r6(1 - F.col("noise") / top).alias("determinism"), r6(1 - F.col("h") / top).alias("degeneracy"))


def recurrent_processing(df: DataFrame, width: int) -> DataFrame:
    """Share of the transfer entropy that flows both ways."""
    x = transfer_entropy(df, width, 2)
    back = x.select(F.col("e1").alias("e2"), F.col("e2").alias("e1"), F.col("te").alias("back"))
    y = x.join(back, ["e1", "e2"])
    return y.agg(r6(F.sum(F.least("te", "back")) / F.greatest(F.sum("te"), F.lit(1e-12))).alias("recurrence"))


def burst_probability(df: DataFrame, begin: int, end: int, gap: int, horizon: int) -> DataFrame:
    """Chance of a burst within ``horizon`` from the mean time between bursts; overdue recordings weigh half as much again."""
    b = bursts_max_interval(df, begin, end, gap, 3, 0)
    m = b.agg(F.count(F.lit(1)).alias("bursts"), over(F.max("start_us") - F.min("start_us"), F.count(F.lit(1)) - 1).alias("mean"), F.max("start_us").alias("last")).where("bursts >= 2")
    x = m.join(span(df).select("dur")).withColumn("p", 1 - F.exp(-horizon / F.col("mean")))
    late = F.col("dur") - F.col("last") > F.col("mean")
    return x.select("bursts", F.round(F.col("mean") / 1e6, 3).alias("mean_wait_s"), r6(F.least(F.lit(0.95), F.when(late, F.col("p") * 1.5).otherwise(F.col("p")))).alias("probability"))


def lomb_scargle(df: DataFrame, width: int, periods_h: list[float]) -> DataFrame:
    """Normalised periodogram of the population counts at the given periods, with the offset that parts sine from cosine."""
    x = dense_counts(df, width).select((F.col("bin") * (width / 3.6e9)).alias("t"), F.col("n").cast("double").alias("y"))
    m = F.broadcast(x.agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")))
    y = x.join(m).select("t", (F.col("y") - F.col("m")).alias("d"), "v").withColumn("period_h", F.explode(F.array(*map(F.lit, periods_h)))).withColumn("w", 2 * math.pi / F.col("period_h"))
    s = y.groupBy("period_h", "w").agg(F.sum(F.sin(2 * F.col("w") * F.col("t"))).alias("s2"), F.sum(F.cos(2 * F.col("w") * F.col("t"))).alias("c2"))
    tau = F.broadcast(s.select("period_h", (F.atan2("s2", "c2") / (2 * F.col("w"))).alias("tau")))
    z = y.join(tau, "period_h").withColumn("a", F.cos(F.col("w") * (F.col("t") - F.col("tau")))).withColumn("b", F.sin(F.col("w") * (F.col("t") - F.col("tau"))))
    part = lambda c: over(F.pow(F.sum(F.col("d") * F.col(c)), F.lit(2)), F.sum(F.col(c) * F.col(c)))
    return z.groupBy("period_h").agg(F.round(over(part("a") + part("b"), 2 * F.first("v")), 4).alias("power"))


def chimera(df: DataFrame, width: int, per_window: int, bar: float = 0.3) -> DataFrame:
    """Per window: order parameter of each block's phases, their variation over blocks, and whether it passes ``bar``."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        u = np.exp(1j * np.angle(analytic(m, 0.02, 0.5)))
        blocks = [np.abs(u[:, names // 8 == g].mean(1)) for g in np.unique(names // 8)]
        k = len(m) // per_window
        r = np.stack([b[: k * per_window].reshape(k, per_window).mean(1) for b in blocks], 1)
        cv = r.std(1) / np.maximum(r.mean(1), 1e-12)
        return {"win": np.arange(k), "mean_r": r.mean(1), "cv": cv, "chimera": (cv > bar).astype(int)}

    return whole_matrix(df, width, fn, "win long, mean_r double, cv double, chimera int")


def sync_dwell(df: DataFrame, width: int, bar: float = 0.3) -> DataFrame:
    """Runs of bins with the order parameter at ``bar`` or more, and below."""
    from .signal import kuramoto

    x = kuramoto(df, width).withColumn("sync", (F.col("order_parameter") >= bar).cast("int"))
    run = F.row_number().over(Window.orderBy("bin")) - F.row_number().over(Window.partitionBy("sync").orderBy("bin"))
    return x.withColumn("run", run).groupBy("sync", "run").agg(F.min("bin").alias("start_bin"), F.count(F.lit(1)).alias("bins")).drop("run")


def integration(df: DataFrame, width: int) -> DataFrame:
    """Sum of the channels' entropies less their joint one, for Gaussian counts: -log det of the correlation / 2."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        c = np.corrcoef(m.T) + 1e-9 * np.eye(len(names))
        v = np.linalg.eigvalsh(c)
        return {"integration": [-0.5 * float(np.log(np.maximum(v, 1e-12)).sum())], "segregation": [float((v / v.sum() * -np.log(np.maximum(v / v.sum(), 1e-12))).sum())]}

    return whole_matrix(df, width, fn, "integration double, segregation double")


def ising(df: DataFrame, width: int) -> DataFrame:
    """Mean-field couplings of the occupancy: the negative inverse correlation off the diagonal."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        s = np.where(m > 0, 1.0, -1.0)
        j = -np.linalg.inv(np.cov(s.T) + 1e-6 * np.eye(len(names)))
        a, b = np.triu_indices(len(names), 1)
        return {"e1": names[a], "e2": names[b], "coupling": j[a, b]}

    return whole_matrix(df, width, fn, "e1 int, e2 int, coupling double")


def information_split(df: DataFrame, width: int) -> DataFrame:
    """Two-way split of the channels by the Fiedler vector of their mutual information, and the information it cuts."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        s, n = (m > 0).astype(float), len(m)
        p = s.mean(0)
        both = s.T @ s / n
        w = np.zeros((len(names), len(names)))
        for a in (0, 1):
            for b in (0, 1):
                pa, pb = np.where(a, p, 1 - p), np.where(b, p, 1 - p)
                pab = (both if a and b else p[:, None] - both if a else p[None] - both if b else 1 - p[:, None] - p[None] + both)
                pab = np.clip(pab, 0, 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    w += np.where(pab > 1e-15, pab * np.log2(pab / np.outer(pa, pb)), 0)
        np.fill_diagonal(w, 0)
        w = np.maximum(w, 0)
        if len(names) < 2:  # nothing to cut
            return {"electrode": names[:0], "side": [], "cut_information": []}
        _, v = np.linalg.eigh(np.diag(w.sum(1)) - w)
        side = (v[:, 1] >= np.median(v[:, 1])).astype(int)
        cut = w[np.ix_(side == 0, side == 1)].sum()
        return {"electrode": names, "side": side, "cut_information": np.full(len(names), cut / max(min(side.sum(), (1 - side).sum()), 1))}

    return whole_matrix(df, width, fn, "electrode int, side int, cut_information double")


def phase_amplitude_coupling(df: DataFrame, width: int, parts: int = 18) -> DataFrame:
    """Modulation index of the fast amplitude over the slow phase of the population count."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        x = m.sum(1)
        phase, amp = np.angle(analytic(x, 0.01, 0.1)), np.abs(analytic(x, 0.2, 0.9))
        at = np.minimum(((phase + np.pi) / (2 * np.pi) * parts).astype(int), parts - 1)
        mean = np.bincount(at, weights=amp, minlength=parts) / np.maximum(np.bincount(at, minlength=parts), 1)
        p = mean / max(mean.sum(), 1e-12)
        h = -np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0).sum()
        return {"modulation_index": [float((math.log(parts) - h) / math.log(parts))]}

    return whole_matrix(df, width, fn, "modulation_index double")


def detect_in_signal(raw: DataFrame, factor: float = 6.0, refractory: int = 30, before: int = 30, after: int = 60) -> DataFrame:
    """Negative crossings of factor x median / 0.6745 in raw signals (electrode, start, samples array), with waveforms.

    Rows are chunks of a channel; the threshold is each chunk's own, and a chunk
    reports the crossings whose waveform it holds whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e, start, samples in pdf[["electrode", "start", "samples"]].itertuples(index=False):
                x = np.asarray(samples, float)
                x = x - np.median(x)
                bar = -factor * np.median(np.abs(x)) / 0.6745
                at, last = np.flatnonzero((x[1:] < bar) & (x[:-1] >= bar)) + 1, -(1 << 60)
                for i in at:
                    if i - last < refractory or i < before or i + after > len(x):
                        continue
                    peak = i + int(np.argmin(x[i : i + refractory]))
                    out.append((e, start + peak, float(x[peak]), x[i - before : i + after].astype(np.float32).tolist()))
                    last = i
            yield pd.DataFrame(out, columns=["electrode", "sample", "amplitude", "waveform"])

    return raw.mapInPandas(run, "electrode int, sample long, amplitude double, waveform array<float>")


def simulate_lif(parameters: DataFrame, steps: int = 2000, dt: float = 0.5, noise: float = 0.3, seed: int = 7) -> DataFrame:
    """Spike counts of leaky integrate-and-fire units with the given tau_m and i_background; seeded by the channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e, tau, drive in pdf[["electrode", "tau_m", "i_background"]].itertuples(index=False):
                rng = np.random.default_rng(seed + int(e))
                kicks, v, n = rng.normal(0, noise, steps) * math.sqrt(dt), 0.0, 0
                for k in kicks:
                    v += dt * (-v / min(max(tau, 5.0), 50.0) + drive * 0.1) + k
                    if v >= 1.0:
                        v, n = 0.0, n + 1
                out.append((e, n, n / (steps * dt / 1e3)))
            yield pd.DataFrame(out, columns=["electrode", "n", "rate_hz"])

    return parameters.mapInPandas(run, "electrode int, n long, rate_hz double")

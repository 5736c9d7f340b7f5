"""Spectral, state-space and network operators in NumPy on binned counts.

Series of one channel run as one group each. Operators on the whole channel
matrix take it as one group: channels (32 at most) times bins, whose number the
width fixes; the events themselves never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .grid import dense_counts


def _series(df: DataFrame, width: int) -> DataFrame:
    return dense_counts(df, width, "electrode").select("electrode", "bin", F.col("n").cast("double").alias("n"))


def per_channel(df: DataFrame, width: int, fn, schema: str) -> DataFrame:
    """``fn(series) -> columns`` for the series of each channel."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fn(pdf.sort_values("bin").n.to_numpy()))
        out.insert(0, "electrode", np.int32(key[0]))
        return out

    ship(df.sparkSession)
    return _series(df, width).groupBy("electrode").applyInPandas(run, f"electrode int, {schema}")


def whole_matrix(df: DataFrame, width: int, fn, schema: str) -> DataFrame:
    """``fn(channels, bins x channels) -> columns`` on the whole matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="bin", columns="electrode", values="n").sort_index()
        return pd.DataFrame(fn(m.columns.to_numpy(), m.to_numpy()))

    ship(df.sparkSession)
    return _series(df, width).groupBy().applyInPandas(run, schema)


def _segments(x: np.ndarray, size: int) -> np.ndarray:
    """Half-overlapping Hann-windowed segments without their mean."""
    size = min(size, len(x))
    starts = range(0, len(x) - size + 1, max(size // 2, 1))
    parts = np.stack([x[a : a + size] for a in starts])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return (parts - parts.mean(1, keepdims=True)) * window


def _cross(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    return (np.fft.rfft(_segments(x, size)) * np.conj(np.fft.rfft(_segments(y, size)))).mean(0)


def welch_psd(df: DataFrame, width: int, size: int = 64) -> DataFrame:
    """Power spectral density of each channel's counts by averaged periodograms."""
    fs = 1e6 / width

    def fn(x: np.ndarray) -> dict:
        k = min(size, len(x))
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(k) / k)
        p = _cross(x, x, size).real / (fs * (window**2).sum())
        p[1 : -1 if k % 2 == 0 else None] *= 2
        return {"freq_hz": np.fft.rfftfreq(k, 1 / fs), "power": p}

    return per_channel(df, width, fn, "freq_hz double, power double")


def coherence(df: DataFrame, width: int, size: int = 64) -> DataFrame:
    """Mean magnitude-squared coherence of each pair of channels."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        spectra = np.fft.rfft(np.stack([_segments(c, size) for c in m.T]))
        own = (np.abs(spectra) ** 2).mean(1)
        i, j = np.triu_indices(len(names), 1)
        both = (spectra[i] * np.conj(spectra[j])).mean(1)
        c = np.abs(both) ** 2 / np.maximum(own[i] * own[j], 1e-300)
        return {"e1": names[i], "e2": names[j], "coherence": c[:, 1:].mean(1)}

    return whole_matrix(df, width, fn, "e1 int, e2 int, coherence double")


def analytic(x: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Analytic signal of the band (shares of the Nyquist frequency), along the first axis."""
    n = len(x)
    f = np.fft.fft(x - x.mean(0), axis=0)
    share = np.abs(np.fft.fftfreq(n)) * 2
    gain = np.where(np.fft.fftfreq(n) > 0, 2.0, 0.0) * ((share >= low) & (share <= high))
    return np.fft.ifft(f * gain[:, None] if x.ndim > 1 else f * gain, axis=0)


def phase_locking(df: DataFrame, width: int, low: float = 0.02, high: float = 0.5) -> DataFrame:
    """Phase-locking value of each pair of channels in a band."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        u = np.exp(1j * np.angle(analytic(m, low, high)))
        v = np.abs(u.T @ np.conj(u)) / len(m)
        i, j = np.triu_indices(len(names), 1)
        return {"e1": names[i], "e2": names[j], "plv": v[i, j]}

    return whole_matrix(df, width, fn, "e1 int, e2 int, plv double")


def phases(df: DataFrame, width: int, low: float = 0.02, high: float = 0.5) -> DataFrame:
    """(electrode, bin, c, s): each channel's phase in a band as a unit vector."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        u = analytic(m, low, high)
        u = np.divide(u, np.abs(u), out=np.zeros_like(u), where=np.abs(u) > 0)
        return {"electrode": np.tile(names, len(m)), "bin": np.repeat(np.arange(len(m)), len(names)), "c": u.real.ravel(), "s": u.imag.ravel()}

    return whole_matrix(df, width, fn, "electrode int, bin long, c double, s double")


def kuramoto(df: DataFrame, width: int, low: float = 0.02, high: float = 0.5) -> DataFrame:
    """Order parameter of the channels' phases in each bin."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        return {"bin": np.arange(len(m)), "order_parameter": np.abs(np.exp(1j * np.angle(analytic(m, low, high))).mean(1))}

    return whole_matrix(df, width, fn, "bin long, order_parameter double")


def _lagged(x: np.ndarray, order: int) -> np.ndarray:
    return np.stack([x[order - k : len(x) - k] for k in range(1, order + 1)], 1)


def granger(df: DataFrame, width: int, order: int = 3) -> DataFrame:
    """F statistic of adding the past of e1 to the past of e2 in predicting e2."""

    def rss(a: np.ndarray, y: np.ndarray) -> float:
        a = np.column_stack([np.ones(len(a)), a])
        return float(((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum())

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        past = [_lagged(c, order) for c in m.T]
        out = []
        for j, target in enumerate(m.T):
            y, own = target[order:], rss(past[j], target[order:])
            for i in range(len(names)):
                if i != j:
                    full = rss(np.hstack([past[j], past[i]]), y)
                    dof = len(y) - 2 * order - 1
                    out.append((names[i], names[j], ((own - full) / order) / (full / dof) if full > 0 and dof > 0 else 0.0))
        e1, e2, f = zip(*out, strict=True) if out else ((), (), ())
        return {"e1": e1, "e2": e2, "f_stat": f}

    return whole_matrix(df, width, fn, "e1 int, e2 int, f_stat double")


def ridge_weights(df: DataFrame, width: int, penalty: float = 1.0) -> DataFrame:
    """Weights of a ridge regression of each channel on the others one bin before."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        z = (m - m.mean(0)) / np.maximum(m.std(0), 1e-9)
        a, b = z[:-1], z[1:]
        if not len(a):
            return {"e1": names[:0], "e2": names[:0], "weight": []}
        w = np.linalg.solve(a.T @ a + penalty * len(a) * np.eye(len(names)), a.T @ b)
        i, j = np.nonzero(~np.eye(len(names), dtype=bool))
        return {"e1": names[i], "e2": names[j], "weight": w[i, j]}

    return whole_matrix(df, width, fn, "e1 int, e2 int, weight double")


def memory_capacity(df: DataFrame, width: int, delays: int = 10, penalty: float = 0.1) -> DataFrame:
    """Squared correlation with which the channels' state recalls the population count some bins ago."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        z = (m - m.mean(0)) / np.maximum(m.std(0), 1e-9)
        signal, out = m.sum(1), []
        for d in range(1, delays + 1):
            a, y = z[d:], signal[:-d]
            if len(a) < 2:  # too short a recording for this delay
                out.append(0.0)
                continue
            y, half = y - y.mean(), len(a) // 2
            w = np.linalg.solve(a[:half].T @ a[:half] + penalty * half * np.eye(a.shape[1]), a[:half].T @ y[:half])
            p = a[half:] @ w
            r = np.corrcoef(p, y[half:])[0, 1] if p.std() > 0 and y[half:].std() > 0 else 0.0
            out.append(r * r)
        return {"delay": np.arange(1, delays + 1), "capacity": out}

    return whole_matrix(df, width, fn, "delay int, capacity double")


def lempel_ziv(bits: np.ndarray) -> int:
    """Phrases of the LZ76 parsing of a binary sequence: each is the shortest string not found before its end."""
    s = (np.asarray(bits) > 0).astype(np.uint8).tobytes()
    at, phrases = 0, 0
    while at < len(s):
        size = 1
        while at + size <= len(s) and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        phrases, at = phrases + 1, at + size
    return phrases


def lz_complexity(df: DataFrame, width: int) -> DataFrame:
    """LZ76 phrases of each channel's occupancy, and c log2(n) / n."""

    def fn(x: np.ndarray) -> dict:
        c = lempel_ziv(x)
        return {"phrases": [c], "normalised": [c * np.log2(max(len(x), 2)) / len(x)]}

    return per_channel(df, width, fn, "phrases long, normalised double")


def sample_entropy(df: DataFrame, width: int, m: int = 2, r: float = 0.2) -> DataFrame:
    """-log of the chance that matches of m bins stay matches with one more, within r deviations."""

    def fn(x: np.ndarray) -> dict:
        tol, found = r * x.std(), []
        for k in (m, m + 1):
            t = np.lib.stride_tricks.sliding_window_view(x, k)[: len(x) - m] if len(x) > m else np.zeros((0, k))
            n = 0
            for i in range(len(t) - 1):
                n += int((np.abs(t[i + 1 :] - t[i]).max(1) <= tol).sum())
            found.append(n)
        return {"sampen": [float(-np.log(found[1] / found[0])) if found[0] and found[1] else 0.0]}

    return per_channel(df, width, fn, "sampen double")


def hmm_updown(df: DataFrame, width: int, rounds: int = 50) -> DataFrame:
    """Two-state Gaussian hidden Markov model of the population count: most likely state of each bin."""

    def fit(x: np.ndarray) -> np.ndarray:
        mean, var = np.percentile(x, [25, 75]).astype(float), np.full(2, x.var() + 1e-6)
        if mean[0] == mean[1]:
            mean = mean + np.array([-0.5, 0.5])
        trans, start = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5])
        for _ in range(rounds):
            like = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
            a, scale = np.zeros_like(like), np.zeros(len(x))
            for t in range(len(x)):
                a[t] = (start if t == 0 else a[t - 1] @ trans) * like[t]
                scale[t] = a[t].sum()
                a[t] /= scale[t]
            b = np.ones_like(like)
            for t in range(len(x) - 2, -1, -1):
                b[t] = trans @ (like[t + 1] * b[t + 1]) / scale[t + 1]
            g = a * b
            g /= g.sum(1, keepdims=True)
            xi = trans * (a[:-1].T @ (like[1:] * b[1:] / scale[1:, None]))
            new = (g * x[:, None]).sum(0) / g.sum(0)
            var = (g * (x[:, None] - new) ** 2).sum(0) / g.sum(0) + 1e-6
            trans, start = xi / xi.sum(1, keepdims=True), g[0]
            if np.abs(new - mean).max() < 1e-6:
                break
            mean = new
        logs = -0.5 * (x[:, None] - mean) ** 2 / var - 0.5 * np.log(var)
        score, back = np.log(start + 1e-300) + logs[0], np.zeros((len(x), 2), int)
        for t in range(1, len(x)):
            path = score[:, None] + np.log(trans + 1e-300)
            back[t] = path.argmax(0)
            score = path.max(0) + logs[t]
        out = np.zeros(len(x), int)
        out[-1] = score.argmax()
        for t in range(len(x) - 2, -1, -1):
            out[t] = back[t + 1][out[t + 1]]
        return out if mean[1] >= mean[0] else 1 - out

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        return {"bin": np.arange(len(m)), "up": fit(m.sum(1))}

    return whole_matrix(df, width, fn, "bin long, up int")


def partial_correlations(df: DataFrame, width: int) -> DataFrame:
    """Correlation of each pair given all other channels."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        p = np.linalg.inv(np.cov(m.T) + 1e-8 * np.eye(len(names)))
        d = np.sqrt(np.diag(p))
        i, j = np.triu_indices(len(names), 1)
        return {"e1": names[i], "e2": names[j], "partial_r": (-p / np.outer(d, d))[i, j]}

    return whole_matrix(df, width, fn, "e1 int, e2 int, partial_r double")


def pca_states(df: DataFrame, width: int, k: int = 5) -> DataFrame:
    """Share of the variance of the leading components, and the participation ratio."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        if m.shape[0] < 2 or not m.var(0).any():  # no variance to share
            return {"component": [], "share": [], "participation": []}
        v = np.linalg.eigvalsh(np.atleast_2d(np.cov(m.T)))[::-1]
        return {"component": np.arange(1, min(k, len(v)) + 1), "share": v[:k] / v.sum(), "participation": np.full(min(k, len(v)), v.sum() ** 2 / (v**2).sum())}

    return whole_matrix(df, width, fn, "component int, share double, participation double")


def persistence(df: DataFrame, windows: int = 20) -> DataFrame:
    """Deaths of the connected components of the windows' normalised count vectors as the distance grows."""
    one = F.broadcast(df.agg((F.max("t_us") + 1).alias("d")))
    c = df.join(one).groupBy(F.expr(f"(t_us * {windows}) div d").alias("bin"), "electrode").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="bin", columns="electrode", values="n").fillna(0).to_numpy()
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        d = np.linalg.norm(m[:, None] - m[None], axis=2)
        inside, near, deaths = np.zeros(len(m), bool), d[0].copy(), []
        inside[0] = True
        for _ in range(len(m) - 1):
            near[inside] = np.inf
            at = int(near.argmin())
            deaths.append(near[at])
            inside[at] = True
            near = np.minimum(near, d[at])
        return pd.DataFrame({"feature": np.arange(len(deaths)), "birth": 0.0, "death": np.sort(deaths)})

    return c.groupBy().applyInPandas(run, "feature int, birth double, death double")


def _network(edges: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(names, weights)`` on the channel network: one group of channels squared rows at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf.e1, pdf.e2]))
        i, j = np.searchsorted(names, pdf.e1), np.searchsorted(names, pdf.e2)
        w = np.zeros((len(names), len(names)))
        w[i, j] = w[j, i] = pdf.r.abs()
        return pd.DataFrame(fn(names, w))

    return edges.select("e1", "e2", "r").groupBy().applyInPandas(run, schema)


def shortest_paths(w: np.ndarray) -> np.ndarray:
    """All distances where an edge of weight w is 1 / w long."""
    with np.errstate(divide="ignore"):
        d = np.where(w > 0, 1 / w, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def betweenness(edges: DataFrame) -> DataFrame:
    """Share of the shortest weighted paths between other nodes that pass a node."""

    def fn(names: np.ndarray, w: np.ndarray) -> dict:
        n = len(names)
        d = shortest_paths(w)
        with np.errstate(divide="ignore"):
            step = np.where(w > 0, 1 / w, np.inf)
        paths = np.eye(n)
        for s in range(n):  # counts of shortest paths from s, nearest nodes first
            for v in np.argsort(d[s], kind="stable"):
                if v != s and np.isfinite(d[s, v]):
                    via = np.isclose(d[s] + step[:, v], d[s, v], rtol=1e-12)
                    paths[s, v] = paths[s, via].sum()
        score = np.zeros(n)
        for v in range(n):
            on = np.isclose(d[:, v : v + 1] + d[v : v + 1], d, rtol=1e-12) & np.isfinite(d)
            np.fill_diagonal(on, False)
            on[v] = on[:, v] = False
            score[v] = np.where(on, paths[:, v : v + 1] * paths[v : v + 1] / np.maximum(paths, 1), 0).sum() / 2
        return {"electrode": names, "betweenness": score / max((n - 1) * (n - 2) / 2, 1)}

    return _network(edges, fn, "electrode int, betweenness double")


def communities(edges: DataFrame) -> DataFrame:
    """Communities by merging the pair that raises the modularity most until none does."""

    def fn(names: np.ndarray, w: np.ndarray) -> dict:
        total, label = w.sum(), np.arange(len(names))
        e = w / total
        while len(e) > 1:
            a = e.sum(1)
            gain = 2 * (e - np.outer(a, a))
            np.fill_diagonal(gain, -np.inf)
            i, j = sorted(np.unravel_index(gain.argmax(), gain.shape))
            if gain[i, j] <= 1e-12:
                break
            e[i] += e[j]
            e[:, i] += e[:, j]
            e = np.delete(np.delete(e, j, 0), j, 1)
            label = np.where(label == j, i, label - (label > j))
        q = float(np.trace(e) - (e.sum(1) ** 2).sum())
        return {"electrode": names, "community": label, "modularity": np.full(len(names), q)}

    return _network(edges, fn, "electrode int, community int, modularity double")


def path_metrics(edges: DataFrame) -> DataFrame:
    """Mean shortest path, global efficiency and number of components."""

    def fn(names: np.ndarray, w: np.ndarray) -> dict:
        d = shortest_paths(w)
        off = d[~np.eye(len(d), dtype=bool)]
        reach = np.isfinite(d)
        return {"path_length": [float(off[np.isfinite(off)].mean()) if np.isfinite(off).any() else 0.0], "efficiency": [float((1 / off).mean())], "n_components": [len(np.unique(reach.argmax(1)))]}

    return _network(edges, fn, "path_length double, efficiency double, n_components int")

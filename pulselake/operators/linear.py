"""Linear models of lagged counts from one distributed table of cross products.

Chunks of bins, each with the bins before it that lags reach, give their part of all
products; parts are summed; models are solved from the sums, whose size is that of
the channels and lags squared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .grid import binned, r6
from .significance import variance_ratio_p

#: Bins that one task multiplies at once.
CHUNK_BINS = 8192


def lagged_products(df: DataFrame, width: int, order: int) -> DataFrame:
    """(i, a, j, b, v, bins): sum over bins t >= ``order`` of the count of channel i at t - a times that of j at t - b, for lags up to ``order``.

    Rows with j = -1 hold the sums of the counts themselves.
    """
    x = binned(df, width).groupBy("electrode", "bin", "n_bins").agg(F.count(F.lit(1)).alias("n"))
    reach = F.sequence(F.expr(f"bin div {CHUNK_BINS}"), F.expr(f"(bin + {order}) div {CHUNK_BINS}"))
    x = x.withColumn("chunk", F.explode(reach)).where(f"chunk * {CHUNK_BINS} < n_bins")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(pdf.electrode.to_numpy(), return_inverse=True)
        total, start = int(pdf.n_bins.iloc[0]), int(key[0]) * CHUNK_BINS
        m = np.zeros((CHUNK_BINS + order, len(names)))
        m[pdf.bin.to_numpy() - start + order, place] = pdf.n.to_numpy()
        rows = np.arange(max(start, order), min(start + CHUNK_BINS, total)) - start + order
        z = np.concatenate([m[rows - a] for a in range(order + 1)], axis=1)
        g = z.T @ z
        p, q = np.nonzero(g)
        e = len(names)
        k, sums = np.arange(len(g)), z.sum(0)
        i, a, j, b = (np.concatenate(x) for x in ((names[p % e], names[k % e]), (p // e, k // e), (names[q % e], np.full(len(k), -1)), (q // e, np.zeros_like(k))))
        return pd.DataFrame({"i": i, "a": a, "j": j, "b": b, "v": np.concatenate([g[p, q], sums]), "bins": total - order})

    ship(df.sparkSession)
    parts = x.groupBy("chunk").applyInPandas(run, "i int, a int, j int, b int, v double, bins long")
    return parts.groupBy("i", "a", "j", "b").agg(F.sum("v").alias("v"), F.first("bins").alias("bins"))


def _gram(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
    """The products about the lagged series' means, as (channel, lag, channel, lag)."""
    names = np.unique(pdf.i.to_numpy())
    at = {int(e): k for k, e in enumerate(names)}
    lags = int(pdf.a.max()) + 1
    g, s = np.zeros((len(names), lags, len(names), lags)), np.zeros((len(names), lags))
    mean, rest = pdf[pdf.j < 0], pdf[pdf.j >= 0]
    g[rest.i.map(at), rest.a, rest.j.map(at), rest.b] = rest.v
    s[mean.i.map(at), mean.a] = mean.v
    bins = int(pdf.bins.iloc[0])
    return g - s[:, :, None, None] * s / max(bins, 1), {"names": names, "bins": bins}


def _residual(g: np.ndarray, yy: float, xy: np.ndarray) -> float:
    return float(max(0.0, yy - xy @ np.linalg.lstsq(g, xy, rcond=None)[0]))


def _orders(g: np.ndarray, k: int, bins: int) -> list[tuple[int, float]]:
    """(order, information criterion) of autoregressions of channel k, all on the same bins."""
    out = []
    for p in range(1, g.shape[1]):
        if bins > p:
            rss = _residual(g[k, 1 : p + 1, k, 1 : p + 1], g[k, 0, k, 0], g[k, 0, k, 1 : p + 1])
            out.append((p, bins * np.log(rss / bins + 1e-300) + p * np.log(bins)))
    return out


def order_selection(df: DataFrame, width: int, most: int) -> DataFrame:
    """(electrode, order, bic, chosen): autoregressions of the busiest channel (the smaller on a tie) of every order up to ``most``; the smallest criterion is chosen."""
    top = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "electrode").limit(1)
    products = lagged_products(df, width, most).join(F.broadcast(top.select(F.col("electrode").alias("top"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, about = _gram(pdf)
        at = np.flatnonzero(about["names"] == pdf.top.iloc[0])
        found = _orders(g, int(at[0]), about["bins"]) if len(at) else []
        best = min(found, key=lambda x: (round(x[1], 9), x[0]), default=(0, 0))[0]
        return pd.DataFrame({"electrode": np.full(len(found), pdf.top.iloc[0], np.int32), "order": [p for p, _ in found], "bic": [b for _, b in found], "chosen": [int(p == best) for p, _ in found]})

    return products.groupBy().applyInPandas(run, "electrode int, order int, bic double, chosen int")


def granger_significance(df: DataFrame, width: int, most: int, alpha: float) -> DataFrame:
    """(e1, e2, order, f_stat, p, q, significant): what the past of e1 adds to that of e2 in predicting e2, with the order that the busiest channel's criterion picks.

    The models have a constant: counts have positive means, which without one any busy
    channel would help to predict. q is the false discovery rate over all pairs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, about = _gram(pdf)
        names, bins = about["names"], about["bins"]
        busiest = int(np.argmax(pdf.groupby("i").events.first().to_numpy()))  # groups come in the order of the names
        found = _orders(g, busiest, bins)
        p = min(found, key=lambda x: (round(x[1], 9), x[0]), default=(0, 0))[0]
        out = []
        for j in range(len(names) if p else 0):
            y = slice(1, p + 1)
            restricted = _residual(g[j, y, j, y], g[j, 0, j, 0], g[j, 0, j, y])
            for i in range(len(names)):
                if i == j:
                    continue
                gram = np.block([[g[j, y, j, y], g[j, y, i, y]], [g[i, y, j, y], g[i, y, i, y]]])
                full = _residual(gram, g[j, 0, j, 0], np.concatenate([g[j, 0, j, y], g[j, 0, i, y]]))
                full = max(full, 1e-12 * g[j, 0, j, 0])  # a perfect prediction leaves rounding alone
                below = bins - 2 * p - 1
                f = max(0.0, (restricted - full) / p / (full / below)) if below > 0 and full > 0 else 0.0
                out.append((int(names[i]), int(names[j]), p, f, below if below > 0 and full > 0 else 0))
        return pd.DataFrame(out, columns=["e1", "e2", "order", "f", "below"])

    events = F.broadcast(df.groupBy(F.col("electrode").alias("i")).agg(F.count(F.lit(1)).alias("events")))
    x = lagged_products(df, width, most).join(events, "i").groupBy().applyInPandas(run, "e1 int, e2 int, order int, f double, below long")
    p = F.when(F.col("below") > 0, variance_ratio_p(F.col("f"), F.col("order").cast("double"), F.col("below").cast("double"))).otherwise(1.0)
    x = x.withColumn("p", p)
    x = x.withColumn("bound", F.col("p") * F.count(F.lit(1)).over(Window.partitionBy()) / F.count(F.lit(1)).over(Window.orderBy("p")))  # channels squared
    q = F.least(F.lit(1.0), F.min("bound").over(Window.orderBy(F.desc("p"))))
    return x.select("e1", "e2", "order", r6("f").alias("f_stat"), r6("p").alias("p"), r6(q).alias("q"), (F.round(q, 9) <= alpha).cast("int").alias("significant"))

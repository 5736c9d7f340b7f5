"""Structured Streaming versions of the core windows; the same results as the batch operators on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rates(events: DataFrame, width: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts per channel and tumbling window; events later than the watermark are dropped."""
    w = F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), "electrode").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "electrode", "n")


def stream_bursts(events: DataFrame, gap: str = "60 seconds", least: int = 3, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Sessions of one channel with intervals up to ``gap`` and at least ``least`` events.

    A session's end is the last event plus the gap, as in a session window.
    """
    s = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(s.alias("s"), "electrode").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.max(time).alias("end"))
    return out.where(F.col("n") >= least).select("electrode", "start", "end", "n")


def stream_intervals(events: DataFrame, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Running count and mean interval of each channel, as rows arrive in order; state is one row per channel."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last, total = state.get if state.exists else (0, 0, 0)
        for pdf in batches:
            for t in sorted((pdf[time].astype("int64") // 1000).tolist()):
                if last and t > last:
                    n, total = n + 1, total + t - last
                last = max(last, t)
        state.update((n, last, total))
        yield pd.DataFrame({"electrode": [key[0]], "n": [n], "mean_s": [total / n / 1e6 if n else 0.0]})

    grouped = events.select("electrode", F.col(time).cast("timestamp").alias(time)).groupBy("electrode")
    return grouped.applyInPandasWithState(update, "electrode int, n long, mean_s double", "n long, last long, total long", "update", "NoTimeout")

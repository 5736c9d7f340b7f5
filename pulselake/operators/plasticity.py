"""Learning across windows, consolidation after quiet, block states, replay of activity patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import corr, dense_counts, n_bins, over, r6, windows
from .lags import lag_sums
from .pairs import sign_edges
from .signal import whole_matrix


def learning_episodes(df: DataFrame, length: int, step: int, reach: int, bar: float) -> DataFrame:
    """Mean absolute timing asymmetry of the channel pairs in each full sliding window, its change, and whether that passes ``bar``.

    A pair of events counts in the windows that hold both.
    """
    x = windows(df.select("electrode", "t_us"), length, step)
    n = {k: F.coalesce(F.sum(F.when(F.col("part") == k, F.col("n"))), F.lit(0)) for k in (0, 2)}
    sums = lag_sums(x, x, reach, sign_edges(reach), grp=F.col("win")).where("e1 < e2").groupBy(F.col("grp").alias("win"), "e1", "e2").agg(n[2].alias("lead"), n[0].alias("trail"))
    s = sums.groupBy("win").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.abs((F.col("lead") - F.col("trail")) / F.greatest(F.col("lead") + F.col("trail"), F.lit(1)))).alias("a"))
    change = F.col("a") - F.lag("a").over(Window.orderBy("win"))
    y = s.withColumn("change", change)
    return y.select("win", "pairs", r6("a").alias("asymmetry"), r6("change").alias("change"), (F.round(F.abs(F.coalesce("change", F.lit(0.0))), 9) > bar).cast("int").alias("episode"))


def consolidation_events(df: DataFrame, width: int, least_quiet: int = 2) -> DataFrame:
    """Bins at or above the 90th percentile straight after ``least_quiet`` bins or more at or below the 25th."""
    x = dense_counts(df, width)
    q = F.broadcast(x.agg(F.expr("percentile(n, 0.25)").alias("lo"), F.expr("percentile(n, 0.9)").alias("hi")))
    y = x.join(q)
    quiet = y.where("n <= lo").select("bin")
    run = quiet.withColumn("run", F.col("bin") - F.row_number().over(Window.orderBy("bin"))).groupBy("run").agg(F.max("bin").alias("end"), F.count(F.lit(1)).alias("quiet_bins")).where(F.col("quiet_bins") >= least_quiet)
    return y.where("n >= hi").join(run, F.col("bin") == F.col("end") + 1).select("bin", "n", "quiet_bins")


def mea_states(df: DataFrame, width: int) -> DataFrame:
    """Per block: share of bins above its median count, number of state changes, mean count."""
    x = dense_counts(df, width, "mea")
    m = F.broadcast(x.groupBy("mea").agg(F.expr("percentile(n, 0.5)").alias("med")))
    y = x.join(m, "mea").withColumn("up", (F.col("n") > F.col("med")).cast("int"))
    z = y.withColumn("was", F.lag("up").over(Window.partitionBy("mea").orderBy("bin")))
    return z.groupBy("mea").agg(r6(F.avg("up")).alias("up_fraction"), F.count_if(F.col("up") != F.col("was")).alias("changes"), r6(F.avg("n")).alias("mean_n"))


def pattern_replay(df: DataFrame, width: int, least: float, k: int = 20) -> DataFrame:
    """The k bin pairs most alike by cosine among those where the earlier bin is one of the busiest tenth.

    Busy bins alone are templates; they meet the other bins on shared channels.
    """
    c = df.groupBy(F.expr(f"t_us div {width}").alias("bin"), "electrode").agg(F.count(F.lit(1)).alias("n"))
    size = c.groupBy("bin").agg(F.sum("n").alias("total"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    bar = F.broadcast(size.agg(F.expr("percentile(total, 0.9)").alias("bar")))
    busy = size.join(bar).where("total >= bar").select(F.col("bin").alias("template"), F.col("norm").alias("norm0"))
    t = c.join(busy, c.bin == busy.template).select("template", "norm0", "electrode", F.col("n").alias("n0"))
    other = c.join(size, "bin").select(F.col("bin").alias("bin"), F.col("electrode").alias("electrode"), F.col("n").alias("n"), F.col("norm").alias("norm"))
    sim = F.sum(F.col("n") * F.col("n0")) / (F.first("norm") * F.first("norm0"))
    x = t.join(other, "electrode").where("bin > template").groupBy("template", "bin").agg(F.round(sim, 6).alias("similarity"))
    return x.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "template", "bin").limit(k)


def weight_changes(df: DataFrame, width: int, windows: int, penalty: float = 1.0) -> DataFrame:
    """Mean absolute change of the ridge weights between neighbouring windows of the recording."""

    def fn(names: np.ndarray, m: np.ndarray) -> dict:
        parts, found = np.array_split(m, windows), []
        for p in parts:
            z = (p - p.mean(0)) / np.maximum(p.std(0), 1e-9)
            a, b = z[:-1], z[1:]
            found.append(np.linalg.solve(a.T @ a + penalty * max(len(a), 1) * np.eye(len(names)), a.T @ b))
        delta = [float(np.abs(y - x).mean()) for x, y in zip(found, found[1:], strict=False)]
        return {"win": np.arange(1, windows), "change": delta}

    return whole_matrix(df, width, fn, "win int, change double")


def retention_curve(df: DataFrame, windows: int, width: int) -> DataFrame:
    """Similarity of each window's pair correlations to those of the first."""
    x = dense_counts(df, width, "electrode").join(F.broadcast(n_bins(df, width))).withColumn("win", F.expr(f"(bin * {windows}) div n_bins"))
    a, b = x.select("win", "bin", F.col("electrode").alias("e1"), F.col("n").alias("x")), x.select(F.col("win").alias("win"), F.col("bin").alias("bin"), F.col("electrode").alias("e2"), F.col("n").alias("y"))
    r = a.join(b, ["win", "bin"]).where("e1 < e2").groupBy("win", "e1", "e2").agg(F.coalesce(F.abs(corr("x", "y")), F.lit(0.0)).alias("r"))
    first = r.where("win = 0").select(F.col("e1").alias("e1"), F.col("e2").alias("e2"), F.col("r").alias("r0"))
    cos = over(F.sum(F.col("r") * F.col("r0")), F.sqrt(F.sum(F.col("r") * F.col("r")) * F.sum(F.col("r0") * F.col("r0"))))
    return r.join(F.broadcast(first), ["e1", "e2"]).groupBy("win").agg(r6(cos).alias("retention"))

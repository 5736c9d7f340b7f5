"""Coalitions of channels in phase, and transitions between network states, from codes per window or bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import dense_counts, n_bins, r6
from .pairs import entropy_of
from .signal import phases


def coalition_codes(df: DataFrame, width: int, per_window: int, bar: float, low: float = 0.02, high: float = 0.5) -> DataFrame:
    """(win, code, members): channels (63 at most) whose phase keeps to the population's by ``bar`` or more on average over the window, as bits."""
    u = phases(df, width, low, high)
    pop = u.groupBy("bin").agg(F.avg("c").alias("pc"), F.avg("s").alias("ps"))
    along = (F.col("c") * F.col("pc") + F.col("s") * F.col("ps")) / F.greatest(F.hypot("pc", "ps"), F.lit(1e-12))
    last = F.broadcast(n_bins(df, width).select(F.greatest(F.expr(f"n_bins div {per_window}"), F.lit(1)).alias("wins")))
    x = u.join(pop, "bin").join(last).withColumn("win", F.expr(f"bin div {per_window}")).where("win < wins")
    e = x.groupBy("win", "electrode").agg((F.round(F.avg(along), 9) >= bar).alias("member"))
    return e.groupBy("win").agg(F.coalesce(F.bit_or(F.expr("case when member then shiftleft(1L, electrode) end")), F.lit(0).cast("long")).alias("code"), F.count_if("member").alias("members"))


def coalitions(df: DataFrame, width: int, per_window: int, bar: float) -> DataFrame:
    """(code, members, windows): how often each coalition stands."""
    return coalition_codes(df, width, per_window, bar).groupBy("code", "members").agg(F.count(F.lit(1)).alias("windows"))


def coalition_entropy(df: DataFrame, width: int, per_window: int, bar: float) -> DataFrame:
    """Entropy of the coalitions in bits, how many there are, and the mean number of members."""
    c = coalitions(df, width, per_window, bar)
    size = c.agg((F.sum(F.col("members") * F.col("windows")) / F.sum("windows")).alias("size"))
    return entropy_of(c, n="windows").join(size).where("total > 0").select(r6("h").alias("entropy"), F.col("kinds").alias("coalitions"), F.col("total").alias("windows"), r6("size").alias("mean_members"))


def network_states(df: DataFrame, width: int) -> DataFrame:
    """(bin, state): which groups of channels are above their own median, as bits."""
    x = dense_counts(df, width, "mea")
    m = F.broadcast(x.groupBy("mea").agg(F.expr("percentile(n, 0.5)").alias("median")))
    return x.join(m, "mea").groupBy("bin").agg(F.sum(F.when(F.col("n") > F.col("median"), F.expr("shiftleft(1, mea)")).otherwise(0)).cast("int").alias("state"))


def _steps(df: DataFrame, width: int) -> DataFrame:
    x = network_states(df, width)
    return x.select(F.col("state").alias("s"), (F.col("bin") + 1).alias("bin")).join(x.select(F.col("state").alias("f"), F.col("bin").alias("bin")), "bin")


def metastable_transitions(df: DataFrame, width: int) -> DataFrame:
    """(s, f, n, p): counts of a state and its follower, and the chance given the state."""
    t = _steps(df, width).groupBy("s", "f").agg(F.count(F.lit(1)).alias("n"))
    return t.select("s", "f", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy("s"))).alias("p"))  # states squared


def metastable_dwell(df: DataFrame, width: int) -> DataFrame:
    """(state, visits, runs, mean_dwell): bins in a state, how often it is entered, and how many bins it lasts."""
    x = network_states(df, width)
    before = x.select((F.col("bin") + 1).alias("bin"), F.col("state").alias("was"))
    entered = F.coalesce(F.col("was") != F.col("state"), F.lit(True))
    g = x.join(before, "bin", "left").groupBy("state").agg(F.count(F.lit(1)).alias("visits"), F.count_if(entered).alias("runs"))
    return g.select("state", "visits", "runs", r6(F.col("visits") / F.col("runs")).alias("mean_dwell"))


def metastable_summary(df: DataFrame, width: int) -> DataFrame:
    """States, changes, entropy of the states and entropy rate of the chain in bits, and how far the rate is below the entropy."""
    t = _steps(df, width).groupBy("s", "f").agg(F.count(F.lit(1)).alias("n"))
    joint = entropy_of(t).select(F.col("h").alias("joint"), "total")
    own = entropy_of(t.groupBy("s").agg(F.sum("n").alias("n"))).select("h", "kinds")
    changes = t.agg(F.coalesce(F.sum(F.when(F.col("s") != F.col("f"), F.col("n"))), F.lit(0).cast("long")).alias("changes"))
    x = own.join(joint).join(changes).where("total > 0")
    return x.select(F.col("kinds").alias("states"), "changes", r6("h").alias("entropy"), r6(F.col("joint") - F.col("h")).alias("entropy_rate"), r6(2 * F.col("h") - F.col("joint")).alias("memory"))

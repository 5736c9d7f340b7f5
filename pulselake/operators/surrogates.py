"""Null models by surrogates: replicates as one more key, seeded by hashes, judged in one aggregate.

Replicate 0 is the observed recording, 1 to ``reps`` are surrogates. A surrogate's
random numbers are the leading bits of an md5 over what it moves (channel, event) and
the replicate, so any engine can repeat them and a lost task computes the same again.
Circular shifts keep each channel's own structure, jitter keeps its slow rate, random
bins keep only its number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import binned, dense_counts, n_bins, r6
from .lags import lag_sums
from .pairs import bin_edges, digitised, entropy_of
from .signal import phases


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1: the leading bits of the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def replicates(df: DataFrame, reps: int, first: int = 0) -> DataFrame:
    """Each row once for every replicate."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(reps))))


def shifts(df: DataFrame, width: int, reps: int) -> DataFrame:
    """(electrode, rep, shift, n_bins): by how many bins each replicate rotates a channel; 0 for the observed. Channels x replicates rows."""
    one = F.broadcast(n_bins(df, width))
    every = replicates(df.select("electrode").distinct(), reps).join(one)
    moved = F.when(F.col("rep") == 0, F.lit(0)).otherwise(1 + draw("rep", "electrode") % F.greatest(F.col("n_bins") - 1, F.lit(1)))
    return every.select("electrode", "rep", moved.cast("long").alias("shift"), "n_bins")


def verdict(stats: DataFrame, keys: list[str], value: str, reps: int, alpha: float) -> DataFrame:
    """(keys, value, null_mean, null_std, z, p, q, significant) from (keys, rep, value).

    A replicate without a row counts as 0. p is the share of surrogates that reach the
    observed value; q is the false discovery rate (Benjamini and Hochberg) of the
    shares with one added on both sides. The table of keys is as small as the pairs of
    channels, and so is the window over it.
    """
    v, obs, nulls, k, mean, std, p1, bound = (f"__{x}" for x in ("v", "obs", "nulls", "k", "mean", "std", "p1", "bound"))  # keys may have any name
    x = stats.withColumn(v, F.round(value, 9))
    g = x.groupBy(*keys).agg(F.max(F.when(F.col("rep") == 0, F.col(v))).alias(obs), F.array_compact(F.collect_list(F.when(F.col("rep") > 0, F.col(v)))).alias(nulls))
    total = lambda f: F.aggregate(nulls, F.lit(0.0), lambda s, y: s + f(y)) / reps
    reach = F.size(F.filter(nulls, lambda y: y >= F.col(obs))) + F.when(F.col(obs) <= 0, reps - F.size(nulls)).otherwise(0)
    g = g.where(F.col(obs).isNotNull()).select(*keys, obs, total(lambda y: y).alias(mean), total(lambda y: y * y).alias(std), reach.alias(k))
    g = g.withColumn(std, F.sqrt(F.greatest(F.col(std) - F.col(mean) * F.col(mean), F.lit(0.0)))).withColumn(p1, (F.col(k) + 1) / (reps + 1))
    g = g.withColumn(bound, F.col(p1) * F.count(F.lit(1)).over(Window.partitionBy()) / F.count(F.lit(1)).over(Window.orderBy(p1)))
    q = F.least(F.lit(1.0), F.min(bound).over(Window.orderBy(F.desc(p1))))
    z = F.when(F.col(std) > 1e-9, (F.col(obs) - F.col(mean)) / F.col(std)).otherwise(0.0)
    return g.select(
        *keys, r6(obs).alias(value), r6(mean).alias("null_mean"), r6(std).alias("null_std"), F.round(z, 4).alias("z"), r6(F.col(k) / reps).alias("p"), r6(q).alias("q"),
        (F.round(q, 9) <= alpha).cast("int").alias("significant"),
    )


def _states(occupied: DataFrame, weights: list[tuple[int, int]], name: str) -> DataFrame:
    """(electrode, bin, n_bins, name): sum of the weights of the occupied bins ``back`` bins before; bins may lie beyond the last."""
    steps = F.array(*(F.struct(F.lit(back).alias("back"), F.lit(w).alias("w")) for back, w in weights))
    x = occupied.select("electrode", "bin", "n_bins", F.explode(steps).alias("s"))
    return x.groupBy("electrode", (F.col("bin") + F.col("s.back")).alias("bin"), "n_bins").agg(F.sum("s.w").cast("int").alias(name))


def transfer_entropies(df: DataFrame, width: int, history: int, reps: int) -> DataFrame:
    """(rep, e1, e2, te): transfer entropy with the source rotated; only bins with an event in a history enter the join.

    The cells of states without events are what the margins leave, so the join grows
    with the events, not with the bins; the table of cells has a fixed size.
    """
    k, nx, ny = history, 1 << history, 1 << (history + 1)
    occupied = binned(df, width).select("electrode", "bin", "n_bins").distinct()
    own = _states(occupied, [(i, 1 << i) for i in range(k + 1)], "y").where(f"bin between {k} and n_bins - 1")
    dst = own.select(F.col("electrode").alias("e2"), F.col("bin").alias("at"), "y")
    # the wrapped end of one channel's past can meet its own beginning, so the weights are summed after the wrap
    past = _states(occupied, [(i, 1 << (i - 1)) for i in range(1, k + 1)], "w").select("electrode", (F.col("bin") % F.col("n_bins")).alias("bin"), "n_bins", "w")
    past = past.groupBy("electrode", "bin", "n_bins").agg(F.sum("w").cast("int").alias("x"))
    moved = past.join(F.broadcast(shifts(df, width, reps).drop("n_bins")), "electrode").withColumn("at", (F.col("bin") + F.col("shift")) % F.col("n_bins")).where(f"at >= {k}")
    src = moved.select("rep", F.col("electrode").alias("e1"), "at", "x")
    both = src.join(dst, "at").where("e1 <> e2").groupBy("rep", "e1", "e2", "x", "y").agg(F.count(F.lit(1)).alias("j"))
    mx = src.groupBy("rep", "e1", "x").agg(F.count(F.lit(1)).alias("mx"))
    my = dst.groupBy("e2", "y").agg(F.count(F.lit(1)).alias("my"))
    names = df.select("electrode").distinct()
    bins = F.broadcast(n_bins(df, width).select((F.col("n_bins") - k).alias("bins")))
    grid = replicates(names.select(F.col("electrode").alias("e1")), reps).join(F.broadcast(names.select(F.col("electrode").alias("e2"))), F.col("e1") != F.col("e2"))
    grid = grid.join(bins).where("bins > 0").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    c = grid.join(both, ["rep", "e1", "e2", "x", "y"], "left").join(F.broadcast(mx), ["rep", "e1", "x"], "left").join(F.broadcast(my), ["e2", "y"], "left").na.fill(0, ["j", "mx", "my"])
    w = lambda col, *by: F.sum(col).over(Window.partitionBy("rep", "e1", "e2", *by))
    c = c.withColumn("in_x", w("j", "x")).withColumn("in_y", w("j", "y")).withColumn("in", w("j"))
    c = c.withColumn("all_x", w(F.when(F.col("y") == 0, F.col("mx")).otherwise(0))).withColumn("all_y", w(F.when(F.col("x") == 0, F.col("my")).otherwise(0)))
    n = (
        F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("j")).when(F.col("y") > 0, F.col("my") - F.col("in_y")).when(F.col("x") > 0, F.col("mx") - F.col("in_x"))
        .otherwise(F.col("bins") - F.col("all_x") - F.col("all_y") + F.col("in"))
    )
    t = c.select("rep", "e1", "e2", "x", "bins", (F.col("y") % 2).alias("yf"), F.floor(F.col("y") / 2).alias("yh"), n.alias("n")).where("n > 0")
    t = t.withColumn("a", w("n", "yh")).withColumn("b", w("n", "yh", "x")).withColumn("d", w("n", "yf", "yh"))
    te = F.sum(F.col("n") / F.col("bins") * F.log2(F.col("n") * F.col("a") / (F.col("b") * F.col("d"))))
    return t.groupBy("rep", "e1", "e2").agg(te.alias("te"))


def te_significance(df: DataFrame, width: int, history: int, reps: int, alpha: float) -> DataFrame:
    """Transfer entropy of each ordered pair against rotations of the source."""
    return verdict(transfer_entropies(df, width, history, reps), ["e1", "e2"], "te", reps, alpha)


def ccg_significance(df: DataFrame, reach: int, width: int, jitter: int, reps: int, alpha: float) -> DataFrame:
    """Peak of each pair's correlogram against jitter of the first channel's events by up to ``jitter``."""
    x = df.select("spike_id", "electrode", "t_us")
    off = F.when(F.col("rep") == 0, F.lit(0)).otherwise(draw("rep", "spike_id") % (2 * jitter + 1) - jitter)
    left = replicates(x, reps).select("rep", "electrode", (F.col("t_us") + off).alias("t_us"))
    counts = lag_sums(left, x, reach, bin_edges(reach, width), F.col("rep")).where("e1 < e2")
    peak = counts.groupBy(F.col("id").cast("int").alias("rep"), "e1", "e2").agg(F.max("n").alias("n"))
    n1 = F.broadcast(df.groupBy(F.col("electrode").alias("e1")).agg(F.count(F.lit(1)).alias("n1")))
    return verdict(peak.join(n1, "e1").withColumn("peak", F.col("n") / F.col("n1") / (width / 1e6)), ["e1", "e2"], "peak", reps, alpha)


def _rotated(rows: DataFrame, df: DataFrame, width: int, reps: int, *values: str) -> DataFrame:
    """(rep, e2, bin, values): rows (electrode, bin, values) of every bin, rotated in each replicate."""
    moved = rows.join(F.broadcast(shifts(df, width, reps)), "electrode")
    return moved.select("rep", F.col("electrode").alias("e2"), ((F.col("bin") + F.col("shift")) % F.col("n_bins")).alias("bin"), *values)


def plv_significance(df: DataFrame, width: int, reps: int, alpha: float, low: float = 0.02, high: float = 0.5) -> DataFrame:
    """Phase-locking value of each pair against rotations of the second channel's phases."""
    u = phases(df, width, low, high)
    other = _rotated(u.withColumnsRenamed({"c": "c2", "s": "s2"}), df, width, reps, "c2", "s2")
    x = u.withColumnRenamed("electrode", "e1").join(other, "bin").where("e1 < e2")
    re, im = F.avg(F.col("c") * F.col("c2") + F.col("s") * F.col("s2")), F.avg(F.col("s") * F.col("c2") - F.col("c") * F.col("s2"))
    return verdict(x.groupBy("rep", "e1", "e2").agg(F.hypot(re, im).alias("plv")), ["e1", "e2"], "plv", reps, alpha)


def mi_significance(df: DataFrame, width: int, reps: int, alpha: float, levels: int = 4) -> DataFrame:
    """Mutual information of digitised counts of each pair against rotations of the second channel."""
    x = digitised(df, width, levels)
    other = _rotated(x.withColumnRenamed("level", "y"), df, width, reps, "y")
    keys = ["rep", "e1", "e2"]
    c = x.select(F.col("electrode").alias("e1"), "bin", F.col("level").alias("x")).join(other, "bin").where("e1 < e2").groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    h = lambda name, *k: entropy_of(c.groupBy(*keys, *k).agg(F.sum("n").alias("n")), *keys).select(*keys, F.col("h").alias(name))
    y = h("hxy", "x", "y").join(h("hx", "x"), keys).join(h("hy", "y"), keys)
    return verdict(y.withColumn("mi", F.col("hx") + F.col("hy") - F.col("hxy")), ["e1", "e2"], "mi", reps, alpha)


def order_null(df: DataFrame, width: int, per_window: int, reps: int, alpha: float, low: float = 0.02, high: float = 0.5) -> DataFrame:
    """Metastability (variance over windows of the mean order parameter) against rotations of every channel's phases."""
    moved = _rotated(phases(df, width, low, high), df, width, reps, "c", "s")
    r = moved.groupBy("rep", "bin").agg(F.hypot(F.avg("c"), F.avg("s")).alias("r"))
    last = F.broadcast(n_bins(df, width).select(F.greatest(F.expr(f"n_bins div {per_window}"), F.lit(1)).alias("wins")))
    win = r.join(last).withColumn("win", F.expr(f"bin div {per_window}")).where("win < wins").groupBy("rep", "win").agg(F.avg("r").alias("r"))
    stats = win.groupBy("rep").agg(F.var_pop("r").alias("variance"))
    return verdict(stats.withColumn("metastability", F.col("variance") * 1000).withColumn("what", F.lit("variance_e3")), ["what"], "metastability", reps, alpha)


def updown_null(df: DataFrame, width: int, reps: int, alpha: float) -> DataFrame:
    """Bimodality, changes and epoch variation of the up and down states against events in random bins.

    Only counts per replicate and bin leave the events; epochs are islands of the bins.
    """
    total = F.broadcast(n_bins(df, width))
    at = F.expr("cast(floor(h * n_bins / 4294967296.0) as bigint)")
    null = replicates(df.select("spike_id"), reps, 1).join(total).withColumn("h", draw("rep", "spike_id")).select("rep", at.alias("bin")).groupBy("rep", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = replicates(n_bins(df, width).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin")), reps, 1)
    x = every.join(null, ["rep", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    x = dense_counts(df, width).select(F.lit(0).alias("rep"), "bin", "n").unionByName(x.select("rep", "bin", "n"))
    m = x.groupBy("rep").agg(F.avg("n").alias("m"), F.expr("percentile(n, 0.5)").alias("median"))
    y = x.join(F.broadcast(m), "rep").withColumn("d", F.col("n") - F.col("m")).withColumn("up", (F.col("n") > F.col("median")).cast("int"))
    power = lambda k: F.avg(F.expr("*".join(["d"] * k)))
    order = Window.partitionBy("rep").orderBy("bin")
    y = y.withColumn("turn", F.coalesce((F.lag("up").over(order) != F.col("up")).cast("int"), F.lit(0))).withColumn("epoch", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shape = y.groupBy("rep").agg(power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"), F.sum("turn").alias("turns"))
    length = y.groupBy("rep", "epoch").agg(F.count(F.lit(1)).alias("k")).groupBy("rep").agg((F.stddev_pop("k") / F.avg("k")).alias("cv"))
    bc = F.when(F.col("m4") > 0, (F.col("m3") * F.col("m3") / F.pow("m2", F.lit(3.0)) + 1) / (F.col("m4") / (F.col("m2") * F.col("m2")))).otherwise(0.0)
    s = shape.join(length, "rep").select("rep", F.explode(F.create_map(F.lit("bimodality"), bc, F.lit("changes"), F.col("turns").cast("double"), F.lit("epoch_cv"), F.col("cv"))).alias("what", "value"))
    return verdict(s, ["what"], "value", reps, alpha)

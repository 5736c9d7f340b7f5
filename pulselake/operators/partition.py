"""Integrated information: what a system's state tells about its next one beyond its parts.

The recording enters as a table of transitions between states of channels packed into
bits, counted over the grid. The information of any subset of channels is that table
under a mask, so all subsets come from one exploded aggregate. Groups of eight
channels are cut in every possible way; a whole recording is cut by the minimum cut of
its graph of pair synergies, found by pendant pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .grid import binned, dense_counts, n_bins, r6
from .pairs import transitions
from .surrogates import draw, replicates, verdict

#: Channels of a group, whose 2^8 subsets are all looked at.
GROUP = 8


def _pack(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mea, bin, state): occupied channels of each group as bits."""
    return rows.groupBy(*keys, "mea", "bin").agg(F.bit_or(F.expr(f"shiftleft(1, cast(electrode % {GROUP} as int))")).alias("state"))


def group_transitions(packed: DataFrame, df: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, mea, s, f, n): counts of each group's state and its follower; bins without events are state 0."""
    every = n_bins(df, width).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))
    heads = packed.select(*keys).distinct().join(df.select("mea").distinct()) if keys else df.select("mea").distinct()
    x = every.join(F.broadcast(heads)).join(packed, [*keys, "mea", "bin"], "left").withColumn("state", F.coalesce("state", F.lit(0)))
    after = x.select(*keys, "mea", (F.col("bin") - 1).alias("bin"), F.col("state").alias("f"))
    return x.withColumnRenamed("state", "s").join(after, [*keys, "mea", "bin"]).groupBy(*keys, "mea", "s", "f").agg(F.count(F.lit(1)).alias("n"))


def subset_information(t: DataFrame, masks, *keys: str) -> DataFrame:
    """(keys, mask, mi): information in bits that the masked state holds on the masked next one; ``masks`` is an array column."""
    x = t.withColumn("mask", F.explode(masks)).withColumn("a", F.col("s").bitwiseAND(F.col("mask"))).withColumn("b", F.col("f").bitwiseAND(F.col("mask")))
    g = x.groupBy(*keys, "mask", "a", "b").agg(F.sum("n").alias("n"))
    w = lambda *by: F.sum("n").over(Window.partitionBy(*keys, "mask", *by))
    g = g.withColumn("na", w("a")).withColumn("nb", w("b")).withColumn("all", w())
    return g.groupBy(*keys, "mask").agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))


def _entropy(counts: np.ndarray) -> float:
    n = counts[counts > 0]
    return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())


def all_information(t: DataFrame, keys: str) -> DataFrame:
    """(keys, mask, mi) of all subsets of each group's channels, from (keys, s, f, n).

    A group's table has a row per pair of states at most, 2^16 whatever the events, so
    its subsets are summed where it lies; ``keys`` names the columns with their types.
    """
    names = [k.split()[0] for k in keys.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, f, n = pdf.s.to_numpy(), pdf.f.to_numpy(), pdf.n.to_numpy(float)
        size = 1 << GROUP
        mi = []
        for mask in range(1, size):
            a, b = s & mask, f & mask
            joint = np.bincount(a * size + b, n, minlength=size * size)
            mi.append(_entropy(np.bincount(a, n)) + _entropy(np.bincount(b, n)) - _entropy(joint))
        return pd.DataFrame({**dict(zip(names, key, strict=True)), "mask": np.arange(1, size, dtype=np.int32), "mi": mi})

    ship(t.sparkSession)
    return t.groupBy(*names).applyInPandas(run, f"{keys}, mask int, mi double")


def _present(df: DataFrame) -> DataFrame:
    """(mea, whole): the channels that a group has, as bits."""
    return df.groupBy("mea").agg(F.bit_or(F.expr(f"shiftleft(1, cast(electrode % {GROUP} as int))")).alias("whole"))


def _cuts(info: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """(keys, mea, mask, whole, whole_mi, part_mi): every cut of each group once, by the side with its lowest channel."""
    i = info.join(F.broadcast(present), "mea").where("mask & whole = mask")
    one = i.where("mask <> whole and (mask & (whole & -whole)) > 0").select(*keys, "mea", "mask", "whole", F.col("mi").alias("one"), (F.col("whole") - F.col("mask")).alias("rest"))
    other = i.select(*keys, "mea", F.col("mask").alias("rest"), F.col("mi").alias("two"))
    full = i.where("mask = whole").select(*keys, "mea", F.col("mi").alias("whole_mi"))
    x = one.join(other, [*keys, "mea", "rest"]).join(full, [*keys, "mea"])
    return x.select(*keys, "mea", "mask", "whole", "whole_mi", (F.col("one") + F.col("two")).alias("part_mi"))


def _information(df: DataFrame, width: int) -> DataFrame:
    packed = _pack(binned(df, width))
    return all_information(group_transitions(packed, df, width), "mea int")


def _phi(whole, parts):
    return F.greatest(F.lit(0.0), whole - parts)


def phi_exact(df: DataFrame, width: int) -> DataFrame:
    """Of each group the cut that loses least (the smaller mask on a tie), and what it loses."""
    c = _cuts(_information(df, width), _present(df))
    best = c.groupBy("mea").agg(F.min(F.struct(F.round(_phi(F.col("whole_mi"), F.col("part_mi")), 9).alias("phi"), "mask", "whole", "whole_mi", "part_mi")).alias("b"))
    return best.select("mea", F.col("b.mask").alias("part"), (F.col("b.whole") - F.col("b.mask")).alias("rest"), r6("b.whole_mi").alias("whole_mi"), r6("b.part_mi").alias("part_mi"), r6("b.phi").alias("phi"))


def phi_mip(df: DataFrame, width: int) -> DataFrame:
    """Of each group the cut of least pair synergy (the smaller mask on a tie), and the information lost there.

    The synergy of a pair is what its joint state tells beyond both channels alone.
    """
    info, present = _information(df, width), _present(df)
    pairs = [((1 << i) | (1 << j), 1 << i, 1 << j) for i in range(GROUP) for j in range(i + 1, GROUP)]
    spec = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, a, b in pairs))).alias("p")
    p = present.select("mea", "whole", spec).select("mea", "p.*", "whole").where("mask & whole = mask")
    own = lambda c, name: info.select("mea", F.col("mask").alias(c), F.col("mi").alias(name))
    w = p.join(own("mask", "both"), ["mea", "mask"]).join(own("a", "one"), ["mea", "a"]).join(own("b", "two"), ["mea", "b"])
    w = w.select("mea", "a", "b", F.greatest(F.lit(0.0), F.col("both") - F.col("one") - F.col("two")).alias("w"))
    cuts = _cuts(info, present)
    cut = cuts.join(F.broadcast(w), "mea")  # 127 cuts x 28 pairs of each group
    weight = F.sum(F.when((F.col("a").bitwiseAND(F.col("mask")) > 0) != (F.col("b").bitwiseAND(F.col("mask")) > 0), F.col("w")).otherwise(0.0))
    best = cut.groupBy("mea", "mask", "whole", "whole_mi", "part_mi").agg(F.round(weight, 9).alias("weight")).groupBy("mea").agg(F.min(F.struct("weight", "mask", "whole", "whole_mi", "part_mi")).alias("b"))
    return best.select(
        "mea", F.col("b.mask").alias("part"), (F.col("b.whole") - F.col("b.mask")).alias("rest"), r6("b.weight").alias("weight"), r6("b.whole_mi").alias("whole_mi"), r6("b.part_mi").alias("part_mi"),
        r6(_phi(F.col("b.whole_mi"), F.col("b.part_mi"))).alias("phi"),
    )


def phi_null(df: DataFrame, width: int, reps: int, alpha: float) -> DataFrame:
    """The exact phi of each group against channels whose bins are shuffled apart from each other."""
    bits = dense_counts(df, width, "electrode", "mea").select("electrode", "mea", "bin", (F.col("n") > 0).alias("bit"))
    null = replicates(bits, reps, 1)
    order = Window.partitionBy("rep", "electrode").orderBy(draw("rep", "electrode", "bin"), "bin")
    moved = null.withColumn("bin", (F.row_number().over(order) - 1).cast("long")).unionByName(bits.withColumn("rep", F.lit(0)))
    t = group_transitions(_pack(moved.where("bit"), "rep"), df, width, "rep")
    c = _cuts(all_information(t, "rep int, mea int"), _present(df), "rep")
    return verdict(c.groupBy("rep", "mea").agg(F.min(_phi(F.col("whole_mi"), F.col("part_mi"))).alias("phi")), ["mea"], "phi", reps, alpha)


def pair_synergy(df: DataFrame, width: int) -> DataFrame:
    """(e1, e2, w) of all pairs of channels: transition information of the pair beyond both alone."""
    t = transitions(df, width)
    names = df.select("electrode").distinct()
    a, b = names.select(F.col("electrode").alias("e1")), names.select(F.col("electrode").alias("e2"))
    pairs = F.broadcast(a.join(b, F.col("e1") <= F.col("e2")))  # a channel with itself stands for the channel alone
    bit = lambda e: F.expr(f"shiftleft(1L, {e})")
    x = t.join(pairs).withColumn("mask", bit("e1").bitwiseOR(bit("e2")))
    g = x.groupBy("e1", "e2", F.col("s").bitwiseAND(F.col("mask")).alias("a"), F.col("f").bitwiseAND(F.col("mask")).alias("b")).agg(F.sum("n").alias("n"))
    w = lambda *by: F.sum("n").over(Window.partitionBy("e1", "e2", *by))
    g = g.withColumn("na", w("a")).withColumn("nb", w("b")).withColumn("all", w())
    mi = g.groupBy("e1", "e2").agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))
    own = mi.where("e1 = e2")
    y = mi.where("e1 < e2").join(F.broadcast(own.select("e1", F.col("mi").alias("m1"))), "e1").join(F.broadcast(own.select("e2", F.col("mi").alias("m2"))), "e2")
    return y.select("e1", "e2", F.greatest(F.lit(0.0), F.col("mi") - F.col("m1") - F.col("m2")).alias("w"))


def minimum_cut(weights: np.ndarray) -> tuple[float, list[int]]:
    """Least weight of a cut of a graph, and one side: merge the last two of each maximum-adjacency order until one node is left."""
    w = np.array(weights, float)
    np.fill_diagonal(w, 0.0)
    members = [[i] for i in range(len(w))]
    left, best = list(range(len(w))), (np.inf, [])
    while len(left) > 1:
        tied = np.where(np.isin(np.arange(len(w)), left), 0.0, -np.inf)
        last = before = left[0]
        for _ in left:
            before, last = last, int(np.argmax(tied))
            cut = tied[last]
            tied[last] = -np.inf
            tied[np.isfinite(tied)] += w[last][np.isfinite(tied)]
        best = min(best, (float(cut), sorted(members[last])), key=lambda x: x[0])
        members[before] += members[last]
        w[before] += w[last]
        w[:, before] = w[before]
        w[before, before] = 0.0
        left.remove(last)
    return best


def phi_network(df: DataFrame, width: int) -> DataFrame:
    """The cut of least pair synergy of the whole recording (63 channels at most) and the information lost there.

    Only the table of pairs, channels squared in size, meets in one task.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.e1, *pdf.e2})
        at = {e: i for i, e in enumerate(names)}
        w = np.zeros((len(names), len(names)))
        for a, b, x in zip(pdf.e1, pdf.e2, pdf.w, strict=True):
            w[at[a], at[b]] = w[at[b], at[a]] = x
        weight, side = minimum_cut(w)
        part, whole = sum(1 << int(names[i]) for i in side), sum(1 << int(e) for e in names)
        rest = whole - part
        part, rest = (part, rest) if part & (whole & -whole) else (rest, part)
        return pd.DataFrame({"weight": [weight], "part": [part], "rest": [rest]})

    found = F.broadcast(pair_synergy(df, width).groupBy().applyInPandas(cut, "weight double, part long, rest long"))
    t = transitions(df, width).join(found)
    i = subset_information(t, F.array("part", "rest", F.col("part") + F.col("rest")), "weight", "part", "rest")
    parts = F.sum(F.when(F.col("mask") != F.col("part") + F.col("rest"), F.col("mi")))
    whole = F.sum(F.when(F.col("mask") == F.col("part") + F.col("rest"), F.col("mi")))
    x = i.groupBy("weight", "part", "rest").agg(whole.alias("whole_mi"), parts.alias("part_mi"))
    return x.select("part", "rest", r6("weight").alias("weight"), r6("whole_mi").alias("whole_mi"), r6("part_mi").alias("part_mi"), r6(_phi(F.col("whole_mi"), F.col("part_mi"))).alias("phi"))

"""Time grids, ordered scans and run detection shared by the operators.

All times are integer microseconds from the first event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunk of time (of one key, if any) that one task scans in order; chunks are stitched by their edges.
CHUNK_US = 3_600_000_000


def r6(c: Column | str) -> Column:
    """Six decimals, the output policy of every double."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def over(a: Column | str, b: Column | str) -> Column:
    """a / b, and null where b is 0."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def corr(x: Column | str, y: Column | str) -> Column:
    """Correlation over the rows where both are given, and null where either is constant, on which Spark's own fails."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return over(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def span(df: DataFrame) -> DataFrame:
    """One row: duration (last time), number of events, number of channels."""
    return df.agg(F.max("t_us").alias("dur"), F.count(F.lit(1)).alias("n_all"), F.countDistinct("electrode").alias("n_e"))


def binned(df: DataFrame, width: int) -> DataFrame:
    """Rows with bin (last bin closed) and n_bins of the grid of ``width``."""
    one = F.broadcast(df.agg(F.max("t_us").alias("__dur")))
    n = F.greatest(F.lit(1).cast("long"), F.expr(f"(__dur + {width - 1}) div {width}"))
    return df.join(one).withColumn("n_bins", n).withColumn("bin", F.least(F.expr(f"t_us div {width}"), F.col("n_bins") - 1)).drop("__dur")


def n_bins(df: DataFrame, width: int) -> DataFrame:
    """One row: n_bins."""
    return df.agg(F.greatest(F.lit(1).cast("long"), F.expr(f"(max(t_us) + {width - 1}) div {width}")).alias("n_bins"))


def sparse_counts(df: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, bin, n) of the bins that hold events."""
    return binned(df, width).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def dense_counts(df: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, bin, n) of every bin of the grid, zeros included."""
    bins = n_bins(df, width).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))
    grid = df.select(*keys).distinct().join(F.broadcast(bins)) if keys else bins
    return grid.join(sparse_counts(df, width, *keys), [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def previous(df: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """``value`` of the event before, in time order, within the keys or, without keys, of all.

    The scan is cut into chunks of time that are ordered apart, so neither a key nor
    the recording is one task; the first event of a chunk takes the last value of the
    chunk before, which comes from one row a chunk.
    """
    keys = [*by, "__chunk"]
    cut = df.withColumn("__chunk", F.expr(f"t_us div {CHUNK_US}"))
    last = cut.groupBy(*keys).agg(F.max_by(value, F.struct("t_us", "spike_id")).alias("__last"))
    before = last.select(*keys, F.lag("__last").over(Window.partitionBy(*by).orderBy("__chunk")).alias("__before"))
    own = cut.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy("t_us", "spike_id")))
    return own.join(before, keys).withColumn(name, F.coalesce(name, "__before")).drop("__chunk", "__before")


def with_previous(df: DataFrame, *by: str) -> DataFrame:
    """prev_us: time of the event before."""
    return previous(df, "t_us", "prev_us", *by)


def running_sums(df: DataFrame, values: dict[str, Column], *by: str) -> DataFrame:
    """Running sum of each named value in time order, within the keys or over all, in stitched chunks and one scan."""
    keys = [*by, "__chunk"]
    cut = df.withColumn("__chunk", F.expr(f"t_us div {CHUNK_US}")).withColumns({f"__v_{k}": v for k, v in values.items()})
    sums = cut.groupBy(*keys).agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values])
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, *[F.coalesce(F.sum(f"__s_{k}").over(earlier), F.lit(0)).alias(f"__b_{k}") for k in values])
    upto = Window.partitionBy(*keys).orderBy("t_us", "spike_id").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({k: F.sum(f"__v_{k}").over(upto) for k in values})
    return own.join(before, keys).withColumns({k: F.col(k) + F.col(f"__b_{k}") for k in values}).drop("__chunk", *[f"__{x}_{k}" for k in values for x in "vb"])


def running_sum(df: DataFrame, value: Column, name: str, *by: str) -> DataFrame:
    """Running sum in time order, within the keys or over all, in stitched chunks."""
    return running_sums(df, {name: value}, *by)


def runs(df: DataFrame, flag: Column, order: str, *by: str) -> DataFrame:
    """Rows with flag set and run, a number that changes wherever the flag is broken."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__f", flag).withColumn("run", F.col(order) - F.row_number().over(Window.partitionBy(*by, "__f").orderBy(order))).where("__f").drop("__f") if order == "bin" else df.withColumn("run", F.sum(F.when(flag, 0).otherwise(1)).over(w)).where(flag)


def windows(df: DataFrame, length: int, step: int) -> DataFrame:
    """One row per event and full sliding window that covers it, both ends closed: win, win_start."""
    one = F.broadcast(df.agg(F.max("t_us").alias("__dur")))
    last = F.least(F.expr(f"t_us div {step}"), F.expr(f"(__dur - {length}) div {step}"))
    first = F.greatest(F.lit(0).cast("long"), F.expr(f"(t_us - {length} + {step - 1}) div {step}"))
    covered = df.join(one).where(F.col("__dur") >= length).withColumn("__a", first).withColumn("__b", last).where("__a <= __b")
    return covered.withColumn("win", F.explode(F.sequence("__a", "__b"))).withColumn("win_start", F.col("win") * step).drop("__a", "__b", "__dur")


def pairs_within(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Event pairs with |t2 - t1| <= reach, as (a struct, b struct): an equi-join on buckets of ``reach``.

    The left side is copied to its three neighbouring buckets; each pair meets once.
    """
    a = left.select(F.struct(*left.columns).alias("a"), F.explode(F.array(*[F.expr(f"t_us div {reach}") + k for k in (-1, 0, 1)])).alias("__bucket"))
    b = right.select(F.struct(*right.columns).alias("b"), F.expr(f"t_us div {reach}").alias("__bucket"))
    return a.join(b, "__bucket").where(F.abs(F.col("b.t_us") - F.col("a.t_us")) <= reach).drop("__bucket")

"""Per-channel and population descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import corr, dense_counts, over, previous, r6, span, with_previous


def firing_rates(df: DataFrame, width: int) -> DataFrame:
    """Counts and rate of every channel in every bin."""
    return dense_counts(df, width, "electrode").select("electrode", "bin", "n", r6(F.col("n") / (width / 1e6)).alias("rate_hz"))


def mean_rates(df: DataFrame, width: int) -> DataFrame:
    """Mean over bins of the binned rate; each empty bin counts as zero."""
    per = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n"))
    bins = F.greatest(F.lit(1).cast("long"), F.expr(f"(dur + {width - 1}) div {width}"))
    return per.join(F.broadcast(span(df).select("dur"))).select("electrode", "n", r6(F.col("n") / bins / (width / 1e6)).alias("mean_rate_hz"))


def intervals(df: DataFrame) -> DataFrame:
    """Positive intervals between events of one channel, in microseconds."""
    return with_previous(df, "electrode").withColumn("isi", F.col("t_us") - F.col("prev_us")).where("isi > 0")


def isi_stats(df: DataFrame, refractory: int) -> DataFrame:
    x = intervals(df).withColumn("s", F.col("isi") / 1e6)
    sd, mean = F.stddev_pop("s"), F.avg("s")
    y = x.groupBy("electrode").agg(
        F.count(F.lit(1)).alias("n_intervals"), r6(mean).alias("mean_s"), r6(sd).alias("std_s"), r6(sd / mean).alias("cv"), r6(F.min("s")).alias("min_s"), r6(F.max("s")).alias("max_s"),
        F.expr("percentile(s, array(0.05, 0.5, 0.95))").alias("q"), F.count_if(F.col("isi") < refractory).alias("violations"),
    )
    p = lambda i: r6(F.get("q", F.lit(i)))  # noqa: E731  one buffer of values for all three
    return y.select("electrode", "n_intervals", "mean_s", p(1).alias("median_s"), "std_s", "cv", "min_s", "max_s", p(0).alias("p5_s"), p(2).alias("p95_s"), "violations")


def isi_histogram(df: DataFrame, per_decade: int = 10) -> DataFrame:
    """Counts of intervals in logarithmic buckets."""
    bucket = F.floor(F.round(F.log10(F.col("isi").cast("double")), 9) * per_decade).cast("int")
    return intervals(df).groupBy("electrode", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def amplitude_stats(df: DataFrame) -> DataFrame:
    """Mean, deviation, median, median absolute deviation, range and tails of the amplitudes."""
    own = df.groupBy("electrode").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("amplitude")).alias("mean"), r6(F.stddev_pop("amplitude")).alias("std"), F.expr("percentile(amplitude, array(0.1, 0.5, 0.9))").alias("q"),
        r6(F.min("amplitude")).alias("min"), r6(F.max("amplitude")).alias("max"),
    )
    p = lambda i: F.get("q", F.lit(i))  # noqa: E731  one buffer of values for all three
    far = df.join(F.broadcast(own.select("electrode", p(1).alias("med"))), "electrode").groupBy("electrode").agg(r6(F.expr("percentile(abs(amplitude - med), 0.5)")).alias("mad"))
    return own.join(far, "electrode").select("electrode", "n", "mean", "std", r6(p(1)).alias("median"), "mad", "min", "max", r6(p(0)).alias("p10"), r6(p(2)).alias("p90"))


def amplitude_histogram(df: DataFrame, buckets: int = 50) -> DataFrame:
    """Equal-width buckets over each channel's range, the last one closed."""
    edges = df.groupBy("electrode").agg(F.min("amplitude").alias("lo"), F.max("amplitude").alias("hi"))
    at = F.least(F.floor((F.col("amplitude") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets) + 1, F.lit(buckets)).cast("int")
    return df.join(F.broadcast(edges), "electrode").where("hi > lo").groupBy("electrode", at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def summary_electrodes(df: DataFrame) -> DataFrame:
    own = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n"), F.avg("amplitude").alias("am"), F.stddev_pop("amplitude").alias("asd"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    isi = intervals(df).groupBy("electrode").agg(F.avg(F.col("isi") / 1e6).alias("im"), F.stddev_pop(F.col("isi") / 1e6).alias("isd"))
    x = own.join(isi, "electrode", "left").join(F.broadcast(span(df).select("dur")))
    return x.select("electrode", "n", r6(over("n", F.col("dur") / 1e6)).alias("rate_hz"), r6("am").alias("amp_mean"), r6("asd").alias("amp_std"), r6("im").alias("isi_mean_s"), r6(over("isd", "im")).alias("isi_cv"), "first_us", "last_us")


def summary_population(df: DataFrame) -> DataFrame:
    """Spread of the channel rates, and the most and least active channel (the smaller on a tie)."""
    x = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(span(df).select("dur"))).withColumn("rate", over("n", F.col("dur") / 1e6))
    key = F.struct("n", -F.col("electrode"))
    return x.agg(
        F.sum("n").alias("n_spikes"), F.count(F.lit(1)).alias("n_electrodes"), r6(F.avg("rate")).alias("mean_rate"), r6(F.stddev_pop("rate")).alias("std_rate"),
        r6(F.min("rate")).alias("min_rate"), r6(F.max("rate")).alias("max_rate"), F.max_by("electrode", key).alias("most_active"), F.min_by("electrode", F.struct("n", "electrode")).alias("least_active"),
    )


def stability_halves(df: DataFrame) -> DataFrame:
    """Rates of the first and second half and the change in percent."""
    x = df.join(F.broadcast(span(df).select("dur")))
    half = F.col("dur") / 2
    n1, n2 = F.count_if(F.col("t_us") < half), F.count_if(F.col("t_us") >= half)
    per = x.groupBy("electrode").agg(over(n1, F.first("dur") / 2e6).alias("a"), over(n2, F.first("dur") / 2e6).alias("b"))
    return per.select("electrode", r6("a").alias("first_hz"), r6("b").alias("second_hz"), r6(F.when(F.col("a") > 0, (F.col("b") - F.col("a")) / F.col("a") * 100).otherwise(0.0)).alias("change_pct"))


def quality_snr(df: DataFrame) -> DataFrame:
    """p90 over p10 of the absolute amplitude, of channels with more than ten events."""
    x = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(abs(amplitude), 0.9)").alias("hi"), F.expr("percentile(abs(amplitude), 0.1)").alias("lo"))
    return x.where("n > 10 and lo > 0").select("electrode", r6(F.col("hi") / F.col("lo")).alias("snr"))


def quality_gaps(df: DataFrame, gap: int) -> DataFrame:
    """Gaps longer than ``gap`` between neighbouring events of all channels."""
    x = with_previous(df).withColumn("gap", F.col("t_us") - F.col("prev_us"))
    return x.agg(F.count_if(F.col("gap") > gap).alias("n_gaps"), r6(F.max(F.col("gap") / 1e6)).alias("longest_s"))


def silent_electrodes(df: DataFrame) -> DataFrame:
    """Channels from 0 to the largest that have no event."""
    every = df.agg(F.max("electrode").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("electrode"))
    return every.join(df.select("electrode").distinct(), "electrode", "left_anti")


def temporal_trend(df: DataFrame, width: int) -> DataFrame:
    """Linear trend and variation of the population rate."""
    x = dense_counts(df, width).withColumn("rate", F.col("n") / (width / 1e6)).withColumn("mid", (F.col("bin") + 0.5) * (width / 1e6))
    return x.agg(
        F.round(F.regr_slope("rate", "mid") * 1e6, 6).alias("slope_per_ms"), r6(F.pow(corr("rate", "mid"), 2)).alias("r2"), r6(over(F.stddev_pop("rate"), F.avg("rate"))).alias("cv"), r6(F.avg("n")).alias("mean_n")
    )


def fano_factors(df: DataFrame, width: int) -> DataFrame:
    """Variance over mean of the binned counts."""
    return dense_counts(df, width, "electrode").groupBy("electrode").agg(r6(F.var_pop("n") / F.avg("n")).alias("fano"))


def rate_windows(df: DataFrame, width: int) -> DataFrame:
    """Population rate in half-open windows that fit the recording whole; the tail is dropped."""
    one = df.agg(F.expr(f"(max(t_us) + {width - 1}) div {width} - 1").alias("k"))
    bins = one.where("k > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("bin"))
    grid = df.select("electrode").distinct().join(F.broadcast(bins))
    counts = df.groupBy("electrode", F.expr(f"t_us div {width}").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["electrode", "bin"], "left").select("electrode", "bin", (F.coalesce("n", F.lit(0)) / (width / 1e6)).alias("rate"))


def homeostasis(df: DataFrame, width: int) -> DataFrame:
    """Variation, trend and compensation events (below half the mean, then rebound above 1.3 times) of windowed rates."""
    x = rate_windows(df, width)
    mean = F.avg("rate").over(Window.partitionBy("electrode"))
    back = F.lag("rate").over(Window.partitionBy("electrode").orderBy("bin"))
    x = x.withColumn("mean", mean).withColumn("back", back)
    return x.groupBy("electrode").agg(
        r6(F.stddev_pop("rate") / F.greatest(F.avg("rate"), F.lit(0.01))).alias("cv"), F.round(F.regr_slope("rate", F.col("bin")) * 1e6, 4).alias("slope_e6"),
        F.count_if((F.col("back") < 0.5 * F.col("mean")) & (F.col("rate") > 1.3 * F.col("mean"))).alias("compensations"),
    )


def suffering_flags(df: DataFrame, width: int) -> DataFrame:
    """Windows with extreme rates, high variation and decline of each channel, and the sum of flags."""
    x = rate_windows(df, width).withColumn("mean", F.avg("rate").over(Window.partitionBy("electrode"))).withColumn("k", F.max("bin").over(Window.partitionBy("electrode")) + 1)
    second = F.col("bin") >= F.expr("k div 2")
    y = x.groupBy("electrode").agg(
        F.count_if(F.col("rate") > 5 * F.col("mean")).alias("high"), F.count_if(F.col("rate") < 0.1 * F.col("mean")).alias("low"), over(F.stddev_pop("rate"), F.avg("rate")).alias("cv"),
        F.avg(F.when(~second, F.col("rate"))).alias("a"), F.avg(F.when(second, F.col("rate"))).alias("b"),
    )
    flags = {"excited": F.col("high") >= 3, "silenced": F.col("low") >= 2, "unstable": F.col("cv") > 2, "declining": F.col("b") < 0.3 * F.col("a")}
    return y.select("electrode", *[f.cast("int").alias(k) for k, f in flags.items()], sum((f.cast("int") for f in flags.values()), F.lit(0)).alias("n_flags"))


def health_flags(df: DataFrame) -> DataFrame:
    """Rule-based 0 to 100 score from activity, variation and silence."""
    pop = summary_population(df)
    top = df.agg((F.max("electrode") + 1).alias("expected"))
    x = pop.join(F.broadcast(top)).withColumn("silent", F.col("expected") - F.col("n_electrodes")).withColumn("spread", over("std_rate", "mean_rate")).where("n_electrodes > 0")
    low = F.coalesce((F.col("mean_rate") < 0.001).cast("int"), F.lit(0))  # one instant has no rate
    uneven, silent = F.coalesce((F.col("spread") > 1).cast("int"), F.lit(0)), (F.col("silent") > 0).cast("int")
    return x.select(low.alias("low_activity"), uneven.alias("uneven"), silent.alias("has_silent"), F.greatest(F.lit(0), 100 - 30 * low - 20 * uneven - 15 * silent).alias("score"))


def rate_forecast(df: DataFrame, width: int, steps: int) -> DataFrame:
    """Linear forecast of each channel's rate for the next bins, never negative, with a 95 % band."""
    x = dense_counts(df, width, "electrode").withColumn("rate", F.col("n") / (width / 1e6)).withColumn("x", (F.col("bin") + 0.5) * (width / 1e6))
    fit = x.groupBy("electrode").agg(
        F.count(F.lit(1)).alias("k"), F.regr_slope("rate", "x").alias("slope"), F.regr_intercept("rate", "x").alias("icept"), F.regr_sxx("rate", "x").alias("sxx"), F.regr_syy("rate", "x").alias("syy"),
        F.regr_sxy("rate", "x").alias("sxy"), F.avg("x").alias("mx"),
    ).where("k >= 3")
    fit = fit.join(F.broadcast(span(df).select("dur"))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("fx", F.col("dur") / 1e6 + F.col("step") * (width / 1e6))
    err = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") ** 2 / F.col("sxx"), F.lit(0.0)) / (F.col("k") - 2) / F.col("sxx"))
    band = 1.96 * err * F.sqrt(1 + 1 / F.col("k") + (F.col("fx") - F.col("mx")) ** 2 / F.col("sxx"))
    value = F.greatest(F.lit(0.0), F.col("slope") * F.col("fx") + F.col("icept"))
    return fit.select("electrode", "step", r6(value).alias("forecast"), r6(F.greatest(F.lit(0.0), value - band)).alias("lo"), r6(value + band).alias("hi"))


def spatial_entropy(df: DataFrame, active_hz: float) -> DataFrame:
    """Entropy of the share of events over channels, its evenness, and the share of active channels."""
    n = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(span(df)))
    p = F.col("n") / F.col("n_all")
    x = n.agg((-F.sum(p * F.log2(p))).alias("h"), F.count(F.lit(1)).alias("k"), F.avg((over("n", F.col("dur") / 1e6) > active_hz).cast("int")).alias("active"))
    return x.select(r6("h").alias("entropy"), r6(F.col("h") / F.greatest(F.log2(F.col("k").cast("double")), F.lit(1e-10))).alias("uniformity"), r6("active").alias("active_fraction"))


def organoid_blocks(df: DataFrame, burst_isi: int) -> DataFrame:
    """Per block of eight channels: rate, burst onsets, interval variation, composite score and rank."""
    isi = with_previous(df, "mea").withColumn("isi", F.col("t_us") - F.col("prev_us"))
    isi = previous(isi, "isi", "before", "mea")
    isi = isi.withColumn("onset", (F.col("isi") < burst_isi) & (F.coalesce("before", F.lit(1 << 60)) >= burst_isi))
    x = isi.groupBy("mea").agg(F.count(F.lit(1)).alias("n"), F.count_if("onset").alias("bursts"), over(F.stddev_pop("isi"), F.avg("isi")).alias("cv")).join(F.broadcast(span(df).select("dur")))
    x = x.withColumn("rate", over("n", F.col("dur") / 1e6))
    top = F.broadcast(x.agg(F.max("rate").alias("top")))
    x = x.join(top).withColumn("score", 0.4 * F.coalesce(over("rate", "top"), F.lit(0.0)) + 0.3 * F.least(F.col("bursts") / 10, F.lit(1.0)) + 0.3 * F.least(F.coalesce("cv", F.lit(0.0)), F.lit(2.0)) / 2)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "mea"))
    return x.select("mea", "n", r6("rate").alias("rate_hz"), "bursts", r6("cv").alias("cv"), r6("score").alias("score"), rank.alias("rank"))


def block_correlation(df: DataFrame, width: int) -> DataFrame:
    """Correlation of the binned rates of each pair of blocks."""
    x = dense_counts(df, width, "mea")
    a, b = x.select(F.col("mea").alias("a"), "bin", F.col("n").alias("x")), x.select(F.col("mea").alias("b"), F.col("bin").alias("bin"), F.col("n").alias("y"))
    return a.join(b, "bin").where("a < b").groupBy("a", "b").agg(r6(corr("x", "y")).alias("r"))


def tracker_delta(df: DataFrame) -> DataFrame:
    """Counts before and after the middle of the recording, with the change in percent (from 0 to some: 100)."""
    x = df.join(F.broadcast(span(df).select("dur"))).withColumn("late", F.col("t_us") * 2 >= F.col("dur"))
    pre = x.where("not late").groupBy("electrode").agg(F.count(F.lit(1)).alias("pre"))
    post = x.where("late").groupBy("electrode").agg(F.count(F.lit(1)).alias("post"))
    zero = F.lit(0).cast("long")
    y = pre.join(post, "electrode", "full_outer").select("electrode", F.coalesce("pre", zero).alias("pre"), F.coalesce("post", zero).alias("post"))
    pct = F.when(F.col("pre") > 0, (F.col("post") - F.col("pre")) / F.col("pre") * 100).when(F.col("post") > 0, 100.0).otherwise(0.0)
    return y.select("electrode", "pre", "post", (F.col("post") - F.col("pre")).alias("change"), r6(pct).alias("pct"))


def center_of_activity(df: DataFrame) -> DataFrame:
    """Rate-weighted centre of the eight positions of a 2 x 4 grid, and each position's distance to it."""
    n = df.groupBy(F.pmod("electrode", F.lit(8)).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    at = n.withColumn("x", F.pmod("site", F.lit(4)).cast("double")).withColumn("y", F.floor(F.col("site") / 4).cast("double"))
    c = at.agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("cx"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("cy"))
    return at.join(F.broadcast(c)).select("site", "n", r6("cx").alias("cx"), r6("cy").alias("cy"), r6(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("distance"))


def fingerprint_rates(df: DataFrame, ranks: int = 8) -> DataFrame:
    """Shares of the most active channels, padded with zeros to a fixed length."""
    n = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(span(df).select("n_all")))
    top = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "electrode"))).where(F.col("rank") <= ranks)
    every = df.sparkSession.range(1, ranks + 1).select(F.col("id").cast("int").alias("rank"))
    return every.join(F.broadcast(top), "rank", "left").select("rank", r6(F.coalesce(F.col("n") / F.col("n_all"), F.lit(0.0))).alias("share"))

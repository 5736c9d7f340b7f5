"""Tests and p-values on columns: rank sums from histograms, correlations, variance ratios, bootstraps of heavy tails.

Special functions are series on columns, so p-values are computed where the rows are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bursts import avalanches, powerlaw_mle
from .grid import corr, dense_counts, n_bins, r6
from .structure import powerlaw_tests
from .surrogates import draw, replicates


def _series(first: Column, ratio, terms: int) -> Column:
    """first * (1 + r(1) + r(1) r(2) + ...), ``terms`` of them."""
    start = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))

    def step(a: Column, k: Column) -> Column:
        t = a["t"] * ratio(k)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda a: a["s"])


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value: 1 - erf(|z| / sqrt 2), by the series with positive terms alone."""
    x = F.least(F.abs(z), F.lit(8.0)) / math.sqrt(2)
    erf = F.exp(-x * x) * _series(2 * x / math.sqrt(math.pi), lambda k: x * x / (k + 0.5), 160)
    return F.greatest(F.lit(0.0), 1 - erf)


def log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps above x."""
    y = x + 8
    tail = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    below = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - below


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 500) -> Column:
    """Regularised incomplete beta function, by its series on the side where that falls fast."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(1 - y)) / p
    value = front * _series(F.lit(1.0), lambda k: (p + q + k - 1) / (p + k) * y, terms)
    inside = F.when(swap, 1 - value).otherwise(value)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of a t value."""
    return incomplete_beta(dof / (dof + t * t), dof / 2, F.lit(0.5))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson correlation of n points, three at least."""
    return F.when(n > 2, incomplete_beta(1 - r * r, (n - 2) / 2, F.lit(0.5)))


def variance_ratio_p(f: Column, above: Column, below: Column) -> Column:
    """Chance of a variance ratio of f or more."""
    return incomplete_beta(below / (below + above * f), below / 2, above / 2)


def rank_sum(rows: DataFrame, group: str, value: str, *by: str) -> DataFrame:
    """(by, n1, n0, u, z, p): Mann-Whitney test of the rows with ``group`` 1 against those with 0, corrected for ties.

    Ranks come from the histogram of the values, so what is ordered is the distinct
    values of each key, not the rows.
    """
    h = rows.groupBy(*by, value).agg(F.count_if(F.col(group) == 1).alias("h1"), F.count(F.lit(1)).alias("h"))
    before = F.sum("h").over(Window.partitionBy(*by).orderBy(value)) - F.col("h")
    h = h.withColumn("rank", before + (F.col("h") + 1) / 2)
    cube = F.sum(F.col("h").cast("double") * F.col("h") * F.col("h") - F.col("h"))
    g = h.groupBy(*by).agg(F.sum("h1").alias("n1"), (F.sum("h") - F.sum("h1")).alias("n0"), F.sum(F.col("h1") * F.col("rank")).alias("r"), cube.alias("ties"))
    n = F.col("n1") + F.col("n0")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n0") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    g = g.where("n1 > 0 and n0 > 0").withColumn("u", u).withColumn("var", var)
    z = F.when(F.col("var") > 1e-12, (F.col("u") - F.col("n1") * F.col("n0") / 2) / F.sqrt("var")).otherwise(0.0)
    return g.withColumn("z", z).select(*by, "n1", "n0", "u", "z", normal_p(F.col("z")).alias("p"))


def _code_of_busiest(df: DataFrame, width: int, k: int) -> DataFrame:
    """(bin, state) of every bin: which of the k busiest channels (the smaller on a tie) fired, busiest in the lowest bit."""
    top = df.groupBy("electrode").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "electrode").limit(k)
    place = top.select("electrode", (F.row_number().over(Window.orderBy(F.desc("n"), "electrode")) - 1).alias("place"))  # k rows
    x = dense_counts(df, width, "electrode").join(F.broadcast(place), "electrode")
    return x.groupBy("bin").agg(F.sum(F.when(F.col("n") > 0, F.expr("shiftleft(1, place)")).otherwise(0)).cast("int").alias("state"))


def prediction_errors(df: DataFrame, width: int, history: int, bits: int = 5) -> DataFrame:
    """(bin, error): bits in which a bin's state differs from the commonest of the ``history`` bins before (the smaller on a tie)."""
    s = _code_of_busiest(df, width, bits)
    told = s.withColumn("bin", F.explode(F.transform(F.sequence(F.lit(1), F.lit(history)), lambda k: F.col("bin") + k)))
    votes = told.groupBy("bin", "state").agg(F.count(F.lit(1)).alias("k"))
    guess = votes.groupBy("bin").agg(F.max_by("state", F.struct("k", -F.col("state"))).alias("guess"))
    return s.join(guess, "bin").where(f"bin >= {history}").select("bin", F.bit_count(F.col("state").bitwiseXOR(F.col("guess"))).alias("error"))


def _error_correlations(df: DataFrame, width: int, history: int) -> DataFrame:
    x = dense_counts(df, width, "electrode").join(prediction_errors(df, width, history), "bin")
    c = x.groupBy("electrode").agg(corr("n", "error").alias("r"), F.count(F.lit(1)).alias("k"), F.stddev_pop("n").alias("sn"), F.stddev_pop("error").alias("se"))
    return c.where("sn > 1e-10 and se > 1e-10 and k > 2").select("electrode", "r", "k", correlation_p(F.col("r"), F.col("k")).alias("p"))


def prediction_error_electrodes(df: DataFrame, width: int, history: int, alpha: float = 0.05) -> DataFrame:
    """Correlation of each channel's counts with the prediction error, its p, and the p corrected for the channels with a positive one."""
    c = _error_correlations(df, width, history)
    m = F.broadcast(c.agg(F.count_if(F.col("r") > 0).alias("m")))
    fixed = F.when(F.col("r") > 0, F.least(F.lit(1.0), F.col("p") * F.col("m")))
    return c.join(m).select("electrode", r6("r").alias("r"), r6("p").alias("p"), r6(fixed).alias("p_corrected"), F.coalesce((F.round(fixed, 9) < alpha).cast("int"), F.lit(0)).alias("significant"))


def prediction_error_summary(df: DataFrame, width: int, history: int) -> DataFrame:
    """Whether the channels' correlations with the prediction error are above 0 on the whole: t, one-sided p, effect size."""
    a = _error_correlations(df, width, history).agg(F.count(F.lit(1)).alias("tested"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.stddev_pop("r").alias("pd")).where("tested >= 3 and sd > 1e-12")
    a = a.withColumn("t", F.col("mean") / (F.col("sd") / F.sqrt("tested"))).withColumn("half", student_p(F.col("t"), F.col("tested") - F.lit(1.0)) / 2)
    a = a.withColumn("p", F.when(F.col("mean") < 0, 1 - F.col("half")).otherwise(F.col("half"))).withColumn("effect", F.col("mean") / F.greatest("pd", F.lit(1e-10)))
    detected = (F.round("p", 9) < 0.01) & (F.col("effect") > 0.3)
    return a.select("tested", r6("mean").alias("mean_r"), F.round("t", 4).alias("t"), r6("p").alias("p"), r6("effect").alias("effect"), detected.cast("int").alias("detected"))


def deviant_response(df: DataFrame, width: int, history: int) -> DataFrame:
    """Each channel's counts in bins whose state was not predicted, ranked against those in predicted ones."""
    x = dense_counts(df, width, "electrode").join(prediction_errors(df, width, history).select("bin", (F.col("error") > 0).cast("int").alias("deviant")), "bin")
    return rank_sum(x, "deviant", "n", "electrode").select("electrode", F.col("n1").alias("deviants"), F.col("n0").alias("standards"), "u", F.round("z", 4).alias("z"), r6("p").alias("p"))


def powerlaw_pvalues(df: DataFrame, width: int) -> DataFrame:
    """The likelihood-ratio tests of the sizes' power law with their two-sided p."""
    x = powerlaw_tests(df, width)
    return x.select("alternative", "tail", "ratio", "z", r6(normal_p(F.col("z"))).alias("p"))


#: Chances of at most 0, 1, 2, ... events of a Poisson variable of mean 1.
_POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def _alpha(size: Column, xmin: Column, n: Column) -> Column:
    return 1 + F.sum(n) / F.sum(n * F.log(size / (xmin - 0.5)))


def powerlaw_bootstrap(df: DataFrame, width: int, reps: int) -> DataFrame:
    """Interval (95 %) of the sizes' exponent, and how often a sample of the fitted law lies as far from its own fit as the sizes do.

    Avalanches carry a Poisson weight of mean 1 in each replicate, so a replicate is an
    aggregate of weights, never a drawn sample. Samples of the law come avalanche by
    avalanche from the inverse distribution; below the cut nothing changes the fit.
    Both are histograms over sizes as soon as they leave the avalanches.
    """
    fit = powerlaw_mle(df, width).select("xmin", "alpha", "ks")
    tail = replicates(avalanches(df, width).select("start_bin", "size").join(F.broadcast(fit)).where("size >= xmin"), reps, 1)
    u = lambda kind: (draw(F.lit(kind), "rep", "start_bin") + 0.5) / float(1 << 32)
    weight = sum(((u("w") > c).cast("int") for c in _POISSON), F.lit(0))
    own = tail.withColumn("w", weight).groupBy("rep", "size", "xmin").agg(F.sum("w").alias("w")).where("w > 0")
    alphas = own.groupBy("rep").agg(_alpha(F.col("size"), F.col("xmin"), F.col("w")).alias("a"))
    ci = alphas.agg(F.expr("percentile(a, array(0.025, 0.975))").alias("q"))
    drawn = F.greatest(F.col("xmin"), F.floor(F.col("xmin") * F.pow(1 - u("g"), -1 / (F.col("alpha") - 1))).cast("long"))
    made = tail.withColumn("drawn", drawn).groupBy("rep", "xmin", F.col("ks").alias("seen"), "drawn").agg(F.count(F.lit(1)).alias("n"))
    made = made.join(made.groupBy("rep").agg(_alpha(F.col("drawn"), F.col("xmin"), F.col("n")).alias("a"), F.sum("n").alias("k")), "rep")
    upto = F.sum("n").over(Window.partitionBy("rep").orderBy("drawn"))  # distinct sizes of a replicate
    made = made.withColumn("upto", upto).withColumn("cdf", 1 - F.pow(F.col("drawn") / F.col("xmin"), 1 - F.col("a")))
    far = F.greatest(F.abs(F.col("upto") / F.col("k") - F.col("cdf")), F.abs((F.col("upto") - F.col("n") + 1) / F.col("k") - F.col("cdf")))
    gof = made.groupBy("rep", "seen").agg(F.max(far).alias("far")).agg(F.avg((F.round("far", 6) >= F.col("seen")).cast("double")).alias("p"))
    return fit.join(ci).join(gof).select("xmin", "alpha", r6(F.get("q", F.lit(0))).alias("alpha_low"), r6(F.get("q", F.lit(1))).alias("alpha_high"), "ks", r6("p").alias("fit_p"))

"""Composite scores and catalogs built from the other operators' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bursts, evolution, pairs, rates
from .grid import over, r6


def gaussian(value: Column, optimum: float, width: float) -> Column:
    return F.exp(-((value - optimum) ** 2) / (2 * width**2))


def sigmoid(value: Column, middle: float, steepness: float = 10.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(steepness * (value - middle), F.lit(30.0)), F.lit(-30.0))))


def composite(df: DataFrame, width: int, avalanche: int) -> DataFrame:
    """0 to 100 score of activity spread, variability, criticality and coupling, each from 0 to 1."""
    h = rates.spatial_entropy(df, 0.0).select(F.col("uniformity").alias("spread"))
    cv = rates.temporal_trend(df, width).select(gaussian(F.col("cv"), 1.0, 0.5).alias("variability"))
    br = bursts.branching_ratio(df, avalanche).select(gaussian(F.col("mean"), 1.0, 0.3).alias("criticality"))
    mi = pairs.cofiring_phi(df, width, 3.29).agg(sigmoid(F.avg(F.abs("phi")), 0.05).alias("coupling"))
    x = h.join(cv).join(br).join(mi)
    names = ["spread", "variability", "criticality", "coupling"]
    return x.select(*[r6(c).alias(c) for c in names], F.round(100 * sum(F.col(c) for c in names) / len(names), 4).alias("score"))


def welfare(df: DataFrame, window: int) -> DataFrame:
    """Health score lowered by the share of flagged channels, with a recommendation."""
    risk = rates.suffering_flags(df, window).agg(F.least(F.lit(1.0), F.avg(F.col("n_flags") / 4)).alias("risk"))
    x = rates.health_flags(df).select("score").join(risk)
    value = F.col("score") * (1 - F.col("risk"))
    return x.select("score", r6("risk").alias("risk"), r6(value).alias("welfare"), F.when(value >= 70, "continue").when(value >= 40, "monitor").otherwise("rest").alias("advice"))


def swarm(df: DataFrame, coupling: float = 0.3, rounds: int = 10) -> DataFrame:
    """Block rates after rounds of linear coupling to their mean, which closes to a power."""
    x = df.groupBy("mea").agg(F.count(F.lit(1)).alias("n"))
    m = F.broadcast(x.agg(F.avg("n").alias("m")))
    keep = (1 - coupling) ** rounds
    return x.join(m).select("mea", "n", r6(F.col("m") + (F.col("n") - F.col("m")) * keep).alias("coupled"))


def report(df: DataFrame, width: int) -> DataFrame:
    """(section, metric, value): the summary figures in one long table."""
    pop = rates.summary_population(df)
    parts = [
        pop.select(F.lit("population").alias("section"), F.stack(F.lit(3), F.lit("n_spikes"), F.col("n_spikes").cast("double"), F.lit("mean_rate"), F.col("mean_rate"), F.lit("std_rate"), F.col("std_rate")).alias("metric", "value")),
        rates.temporal_trend(df, width).select(F.lit("temporal").alias("section"), F.stack(F.lit(2), F.lit("cv"), F.col("cv"), F.lit("r2"), F.col("r2")).alias("metric", "value")),
        rates.spatial_entropy(df, 0.0001).select(F.lit("spatial").alias("section"), F.stack(F.lit(2), F.lit("entropy"), F.col("entropy"), F.lit("uniformity"), F.col("uniformity")).alias("metric", "value")),
        pairs.joint_entropy(df, width).select(F.lit("information").alias("section"), F.lit("joint_entropy").alias("metric"), F.col("h").alias("value")),
        evolution.cosinor(df, width, 24.0).select(F.lit("rhythm").alias("section"), F.stack(F.lit(2), F.lit("mesor"), F.col("mesor"), F.lit("amplitude"), F.col("amplitude")).alias("metric", "value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similarity_to_profiles(df: DataFrame, profiles: DataFrame, width: int) -> DataFrame:
    """Weighted cosine and distance of the recording's min-max scaled features to each named profile.

    ``profiles`` has (system, feature, value, weight); the bounds are the profiles'
    own, widened by a fifth of their span.
    """
    own = rates.temporal_trend(df, width).select(F.lit("cv").alias("feature"), F.col("cv").alias("x"))
    own = own.unionByName(bursts.branching_ratio(df, width).select(F.lit("branching").alias("feature"), F.col("mean").alias("x")))
    own = own.unionByName(rates.spatial_entropy(df, 0.0).select(F.lit("uniformity").alias("feature"), F.col("uniformity").alias("x")))
    span = profiles.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select("feature", (F.col("lo") - (F.col("hi") - F.col("lo")) * 0.2).alias("lo"), (F.col("hi") + (F.col("hi") - F.col("lo")) * 0.2).alias("hi"))
    scale = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(v) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))))
    x = profiles.join(span, "feature").join(own, "feature").withColumn("a", scale("x")).withColumn("b", scale("value"))
    w = F.col("weight") * F.col("weight")
    cos = over(F.sum(F.col("a") * F.col("b") * w), F.sqrt(F.sum(F.col("a") * F.col("a") * w) * F.sum(F.col("b") * F.col("b") * w)))
    return x.groupBy("system").agg(r6(cos).alias("cosine"), r6(F.sqrt(F.sum(F.col("weight") * (F.col("a") - F.col("b")) ** 2))).alias("distance"))

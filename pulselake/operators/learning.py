"""Waveform and window clustering on pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evolution import window_features
from .grid import r6


def waveform_vectors(embeddings: DataFrame, spikes: DataFrame) -> DataFrame:
    """(spike_id, electrode, features) of the events that have a waveform."""
    from pyspark.ml.functions import array_to_vector

    w = embeddings.select(F.col("vec_id").alias("spike_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return w.join(spikes.select("spike_id", "electrode"), "spike_id")


def _few(rows: DataFrame, least: int = 2) -> bool:
    """Fewer rows than a fit needs; reads no more than that."""
    return rows.limit(least).count() < least


def pca_waveforms(vectors: DataFrame, k: int = 3) -> DataFrame:
    """Scores on the leading components; no rows without two waveforms."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    if _few(vectors):
        return vectors.select("spike_id", *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(k)]).where("false")
    x = PCA(k=k, inputCol="features", outputCol="scores").fit(vectors).transform(vectors).withColumn("s", vector_to_array("scores"))
    return x.select("spike_id", *[r6(F.col("s")[i]).alias(f"pc{i + 1}") for i in range(k)])


def kmeans_waveforms(vectors: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Cluster of each waveform: spike sorting on the leading components; no rows without two waveforms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA

    if _few(vectors):
        return vectors.select("spike_id", "electrode", F.lit(None).cast("int").alias("cluster")).where("false")
    steps = [PCA(k=5, inputCol="features", outputCol="scores"), KMeans(k=k, seed=seed, featuresCol="scores", predictionCol="cluster")]
    return Pipeline(stages=steps).fit(vectors).transform(vectors).select("spike_id", "electrode", "cluster")


def window_vectors(df: DataFrame, width: int) -> DataFrame:
    """(win, features): population features of every window."""
    from pyspark.ml.feature import VectorAssembler

    x = window_features(df, width).groupBy("win").agg(F.sum("rate").alias("rate"), F.avg("amp_mean").alias("amp"), F.avg("amp_std").alias("amp_sd"), F.avg("cv_isi").alias("cv"), F.count(F.lit(1)).cast("double").alias("active"))
    return VectorAssembler(inputCols=["rate", "amp", "amp_sd", "cv", "active"], outputCol="raw").transform(x.fillna(0.0))


def state_clusters(df: DataFrame, width: int, k: int = 4, seed: int = 42) -> DataFrame:
    """Cluster of each window on scaled features; no rows without two windows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    x = window_vectors(df, width)
    if _few(x):
        return x.select("win", F.lit(None).cast("int").alias("state")).where("false")
    steps = [StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=k, seed=seed, featuresCol="features", predictionCol="state")]
    return Pipeline(stages=steps).fit(x).transform(x).select("win", "state")


def anomaly_windows(df: DataFrame, width: int, bar: float = 2.5) -> DataFrame:
    """Windows whose features lie ``bar`` deviations from their mean, root mean square over features."""
    x = window_features(df, width).groupBy("win").agg(F.sum("rate").alias("rate"), F.avg("amp_mean").alias("amp"), F.avg("amp_std").alias("amp_sd"), F.avg("cv_isi").alias("cv"))
    names = ["rate", "amp", "amp_sd", "cv"]
    m = F.broadcast(x.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]))
    score = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(1e-9))) ** 2 for c in names) / len(names))
    return x.join(m).select("win", r6(score).alias("score"), (score > bar / 2).cast("int").alias("anomaly"))

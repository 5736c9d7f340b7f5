"""Library entry points: load a recording, run an operator by name, hand rows to JSON."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bursts, dynamics, emergence, evolution, graph, pairs, plasticity, rates, scores, signal, structure
from .sources.events import read_spikes, write_spikes

__all__ = ["analyze", "as_json", "load", "operators", "parameters", "save", "select", "summary"]

load: Callable[..., DataFrame] = read_spikes
save: Callable[[DataFrame, str], None] = write_spikes


def operators() -> dict[str, Callable[..., DataFrame]]:
    """Every operator on a recording, by name."""
    found = {}
    for module in (rates, bursts, pairs, evolution, dynamics, emergence, plasticity, signal, scores, structure):
        for name, fn in vars(module).items():
            if inspect.isfunction(fn) and fn.__module__ == module.__name__ and not name.startswith("_") and next(iter(inspect.signature(fn).parameters), "") == "df":
                found[name] = fn
    return found


def network_operators() -> dict[str, Callable[..., DataFrame]]:
    """Every operator on an edge table (e1, e2, r), by name."""
    return {n: f for m in (graph, signal, structure) for n, f in vars(m).items() if inspect.isfunction(f) and not n.startswith("_") and next(iter(inspect.signature(f).parameters), "") == "edges"}


def parameters(name: str) -> dict[str, object]:
    """Parameters of an operator and their defaults; Ellipsis marks one that must be given."""
    fn = (operators() | network_operators())[name]
    return {p.name: ... if p.default is p.empty else p.default for p in list(inspect.signature(fn).parameters.values())[1:] if p.kind != p.VAR_KEYWORD}


def analyze(df: DataFrame, name: str, **params) -> DataFrame:
    """Run the operator ``name`` on a recording, or on an edge table for network operators."""
    every = operators() | network_operators()
    if name not in every:
        raise KeyError(f"unknown operator {name}; known: {', '.join(sorted(every))}")
    return every[name](df, **params)


def select(df: DataFrame, start_us: int | None = None, end_us: int | None = None, electrodes: list[int] | None = None) -> DataFrame:
    """Events of a closed time range and of the given channels; both filters reach the scan."""
    if start_us is not None:
        df = df.where(F.col("t_us") >= start_us)
    if end_us is not None:
        df = df.where(F.col("t_us") <= end_us)
    return df.where(F.col("electrode").isin(electrodes)) if electrodes is not None else df


def summary(df: DataFrame) -> DataFrame:
    """One row: number of events and channels, first and last time, duration in seconds."""
    x = df.agg(F.count(F.lit(1)).alias("n_spikes"), F.countDistinct("electrode").alias("n_electrodes"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))
    return x.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / 1e6)


def as_json(df: DataFrame) -> DataFrame:
    """(json) one document per row; values that are not finite become 0."""
    clean = [F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean)).alias("json"))


def example(spark: SparkSession, duration_s: float = 30.0, electrodes: int = 8, rate_hz: float = 10.0, seed: int = 42) -> DataFrame:
    """A synthetic recording: uniform times, normal amplitudes, made in parallel from a seed."""
    n = int(duration_s * electrodes * rate_hz)
    x = spark.range(n).select(
        F.col("id").alias("spike_id"), (F.rand(seed) * duration_s * 1e6).cast("long").alias("t_us"), F.floor(F.rand(seed + 1) * electrodes).cast("int").alias("electrode"), (F.randn(seed + 2) * 20 - 50).alias("amplitude")
    )
    return x.withColumn("mea", F.expr("cast(electrode div 8 as int)")).select("spike_id", "t_us", "electrode", "mea", "amplitude")

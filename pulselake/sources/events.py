"""Readers that bring recordings of any supported layout to the canonical point-event schema.

Canonical columns: spike_id BIGINT, t_us BIGINT (microseconds from the first
event), electrode INT, mea INT, amplitude DOUBLE; a waveform ARRAY<FLOAT> may follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted names of each column, in order of preference.
TIME_NAMES = ["time", "timestamp", "t", "time_s", "time_sec", "_time", "times"]
ELECTRODE_NAMES = ["electrode", "channel", "ch", "electrode_id", "chan", "index", "electrodes", "channels"]
AMPLITUDE_NAMES = ["amplitude", "amp", "voltage", "value", "amplitude_uv", "_value", "amplitudes"]

ELECTRODES = 32
PER_MEA = 8


def _canonical(rows: DataFrame) -> DataFrame:
    """From (spike_id, u, electrode, amplitude): times from the first event on.

    The first time is a one-row aggregate that joins by broadcast.
    """
    first = F.broadcast(rows.agg(F.min("u").alias("u0")))
    return rows.join(first).select(
        "spike_id",
        (F.col("u") - F.col("u0")).alias("t_us"),
        F.col("electrode").cast("int").alias("electrode"),
        F.expr(f"cast(electrode div {PER_MEA} as int)").alias("mea"),
        F.col("amplitude").cast("double").alias("amplitude"),
    )


def from_events(events: DataFrame) -> DataFrame:
    """The event log as a recording: user_id modulo 32 is the channel, value the amplitude."""
    return _canonical(
        events.select(
            F.col("event_id").alias("spike_id"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("u"),
            F.pmod("user_id", F.lit(ELECTRODES)).alias("electrode"),
            F.col("value").alias("amplitude"),
        )
    )


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def stimuli(spark: SparkSession, sf_dir: str, kind: str = "purchase", step: float = 50.0) -> DataFrame:
    """(stim_id, t_us, dose) of the marker events of one kind."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.broadcast(events.agg(F.min(u).alias("u0")))
    marks = events.where(F.col("event_type") == kind).select(F.col("event_id").alias("stim_id"), u.alias("u"), F.floor(F.col("value") / step).cast("int").alias("dose"))
    return marks.join(first).select("stim_id", (F.col("u") - F.col("u0")).alias("t_us"), "dose")


def _pick(df: DataFrame, names: list[str]) -> str | None:
    own = {c.lower().strip(): c for c in df.columns}
    return next((own[n] for n in names if n in own), None)


def resolve(df: DataFrame) -> DataFrame:
    """Canonical rows of a table with any accepted column names.

    Without a known time column the first numeric columns stand for time,
    electrode and amplitude in that order. A string time is an ISO-8601 instant, a
    number counts seconds. Channels are taken modulo 32; a missing channel or
    amplitude is 0.
    """
    numeric = [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")]
    t, e, a = _pick(df, TIME_NAMES), _pick(df, ELECTRODE_NAMES), _pick(df, AMPLITUDE_NAMES)
    if t is None and "t_us" in df.columns:  # an export of this engine
        df = df.withColumn("time", F.col("t_us") / 1e6)
        t = "time"
    if t is None:
        if len(numeric) < 2:
            raise ValueError(f"no time column among {df.columns}")
        t, e, a = numeric[0], numeric[1], numeric[2] if len(numeric) > 2 else None
    text = dict(df.dtypes)[t] in ("string", "timestamp", "timestamp_ntz")
    u: Column = F.unix_micros(F.to_timestamp(F.col(t)).cast("timestamp")) if text else F.round(F.col(t).cast("double") * 1_000_000).cast("long")
    rows = df.select(
        u.alias("u"),
        (F.pmod(F.col(e).cast("int"), F.lit(ELECTRODES)) if e else F.lit(0)).alias("electrode"),
        F.coalesce(F.col(a).cast("double"), F.lit(0.0)).alias("amplitude") if a else F.lit(0.0).alias("amplitude"),
    ).where("u is not null")
    return _canonical(rows.withColumn("spike_id", F.monotonically_increasing_id()))


def read_spikes(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Canonical rows of a CSV, TSV, Parquet, JSON or HDF5 file, told by its suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return resolve(spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else sep))
    if kind in ("parquet", "pq"):
        return resolve(spark.read.parquet(path))
    if kind == "json":
        raw = spark.read.json(path, multiLine=True)
        arrays = [c for c, t in raw.dtypes if t.startswith("array")]
        if arrays:
            raw = raw.select(F.explode(F.arrays_zip(*arrays)).alias("r")).select("r.*")
        return resolve(raw)
    if kind in ("h5", "hdf5", "hdf", "nwb"):
        return _read_hdf5(spark, path)
    raise ValueError(f"unsupported file format: .{kind}")


def _read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    try:
        import h5py  # noqa: F401
    except ImportError as error:
        raise ImportError("reading HDF5 needs the h5py package") from error

    def run(batches):
        import io

        import h5py
        import pandas as pd

        for files in batches:
            for content in files["content"]:
                with h5py.File(io.BytesIO(content)) as f:
                    g = f["spikes"]
                    channel = g["electrodes"] if "electrodes" in g else g["channels"]
                    amplitude = g["amplitudes"][:] if "amplitudes" in g else 0.0
                    yield pd.DataFrame({"time": g["times"][:], "electrode": channel[:], "amplitude": amplitude})

    files = spark.read.format("binaryFile").load(path).select("content")
    return resolve(files.mapInPandas(run, "time double, electrode long, amplitude double"))


def write_spikes(spikes_df: DataFrame, path: str) -> None:
    """Export by suffix: CSV, JSON lines or Parquet (partitioned by channel)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        spikes_df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        spikes_df.write.mode("overwrite").json(path)
    elif kind in ("parquet", "pq"):
        spikes_df.write.mode("overwrite").partitionBy("electrode").parquet(path)
    else:
        raise ValueError(f"unsupported file format: .{kind}")

"""Daily integrity digest of a recording.

For every day of the recording and every channel: events, active hours, rate,
intervals, amplitudes, bursts, coincident (artifact) events and a verdict: silent,
artifact, noisy or ok. A second table lists the bursts. Both are written as Parquet
partitioned by day with dynamic partition overwrite, so a rerun replaces exactly the
days it computes and gives the same files' content.

    python -m jobs.recording_digest --events s3a://lab/events --out s3a://lab/digest
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from pulselake.operators.bursts import burst_events, bursts_max_interval
from pulselake.operators.evolution import artifact_flags
from pulselake.operators.grid import r6, with_previous
from pulselake.sources.events import from_events

NAME = "recording_digest"
CHANNELS = "electrode int, n long, active_hours long, rate_hz double, isi_mean_s double, isi_cv double, amp_mean double, amp_std double, bursts long, in_bursts long, artifacts long, status string, day int"
BURSTS = "electrode int, start_us long, end_us long, n long, day int"


def bursts(df: DataFrame, p: dict) -> tuple[DataFrame, DataFrame]:
    """(electrode, start_us, end_us, n, day) of the bursts, and (day, electrode, in_bursts) of the events in them."""
    day = lambda c: F.expr(f"cast({c} div {p['day_us']} as int)").alias("day")
    found = bursts_max_interval(df, p["burst_begin_us"], p["burst_end_us"], p["burst_gap_us"], p["burst_events"], 0, "electrode")
    inside = burst_events(df, found, p["burst_bucket_us"], "electrode")
    table = inside.groupBy("electrode", "start_us", "end_us").agg(F.count(F.lit(1)).alias("n")).select("electrode", "start_us", "end_us", "n", day("start_us"))
    return table, inside.groupBy(day("t_us"), "electrode").agg(F.count(F.lit(1)).alias("in_bursts"))


def digest(df: DataFrame, table: DataFrame, inside: DataFrame, p: dict) -> DataFrame:
    """One row per day and channel of the recording, days without events included."""
    day = F.expr(f"cast(t_us div {p['day_us']} as int)").alias("day")
    isi = F.col("t_us") - F.col("prev_us")
    own = with_previous(df, "electrode").groupBy(day, "electrode").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.expr("t_us div 3600000000")).alias("active_hours"), F.avg(isi).alias("m"), F.stddev_pop(isi).alias("sd"),
        F.avg("amplitude").alias("a"), F.stddev_pop("amplitude").alias("asd"),
    )
    flagged = artifact_flags(df, p["artifact_bin_us"]).groupBy(day, "electrode").agg(F.sum("flag").alias("artifacts"))
    count = table.groupBy("day", "electrode").agg(F.count(F.lit(1)).alias("bursts"))
    days = df.agg(F.max("t_us").alias("t_us")).select(F.explode(F.sequence(F.lit(0), day)).alias("day"))
    x = df.select("electrode").distinct().crossJoin(days)  # channels x days, the size of the output
    for part in (own, flagged, count, inside):
        x = x.join(part, ["day", "electrode"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    middle = x.groupBy("day").agg(F.expr("percentile(coalesce(n, 0), 0.5)").alias("middle"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    status = (
        F.when(n == 0, "silent").when(F.col("artifacts") > p["artifact_share"] * n, "artifact").when(n > p["noisy_times_median"] * F.col("middle"), "noisy").otherwise("ok")
    )
    return x.join(middle, "day").select(
        "electrode", n.alias("n"), zero("active_hours"), r6(n / (p["day_us"] / 1e6)).alias("rate_hz"), r6(F.col("m") / 1e6).alias("isi_mean_s"),
        r6(F.try_divide("sd", "m")).alias("isi_cv"), r6("a").alias("amp_mean"), r6("asd").alias("amp_std"), zero("bursts"), zero("in_bursts"), zero("artifacts"), status.alias("status"), "day",
    )


def run(spark: SparkSession, events: str, out: str, p: dict) -> dict:
    """Digest the event table at ``events`` into ``out``/channels and ``out``/bursts; returns what was read and written."""
    raw = spark.read.parquet(events)
    df = from_events(raw)
    table, inside = bursts(df, p)
    put(table, f"{out}/bursts")
    table = read(spark, out, "bursts")  # the days just written are those of this recording
    put(digest(df, table, inside, p), f"{out}/channels")
    told = {"read": raw.count(), "channel_days": read(spark, out, "channels").count(), "bursts": table.count()}
    log.info("%s: read %d events of %s; %s holds %d channel days and %d bursts", NAME, told["read"], events, out, told["channel_days"], told["bursts"])
    return told


def put(df: DataFrame, path: str) -> None:
    """A file a day; only days that ``df`` holds are replaced."""
    df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read(spark: SparkSession, out: str, table: str = "channels") -> DataFrame:
    """The written table as it stands."""
    return spark.read.schema({"channels": CHANNELS, "bursts": BURSTS}[table]).parquet(f"{out}/{table}")


if __name__ == "__main__":
    main(NAME, run, {"events": "event table, Parquet", "out": "folder of the digest"})

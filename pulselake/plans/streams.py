"""The streaming operators on the whole event log as a batch; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.events import ELECTRODES
from ..streaming import rates
from .registry import register_raw


def channel_events(events: DataFrame) -> DataFrame:
    """(ts, electrode) with an instant that watermarks accept."""
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.pmod("user_id", F.lit(ELECTRODES)).cast("int").alias("electrode"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


register_raw(
    "stream_rates", lambda spark, d: rates.stream_rates(_read(spark, d)).select(F.unix_seconds("start").alias("start_s"), "electrode", "n"),
    "select epoch_us(ts) // 3600000000 * 3600 as start_s, cast(user_id % 32 as integer) as electrode, count(*) as n from events group by 1, 2",
)
register_raw(
    "stream_bursts", lambda spark, d: rates.stream_bursts(_read(spark, d), gap="1 hour").select("electrode", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"),
    """with x as (select cast(user_id % 32 as integer) as electrode, epoch_us(ts) as t from events), y as (select *, case when t - lag(t) over (partition by electrode order by t) <= 3600000000 then 0 else 1 end as nw from x),
z as (select *, sum(nw) over (partition by electrode order by t rows unbounded preceding) as g from y) select electrode, min(t) as start_us, max(t) as end_us, count(*) as n from z group by electrode, g having count(*) >= 3""",
)

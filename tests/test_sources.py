"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from pulselake.plans.streams import channel_events
from pulselake.sources import events as src
from pulselake.streaming import rates

SF = "/root/testdata/sf0.001"


def test_csv_aliases_and_modulo(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Time,Channel,amp\n0.5,33,-10\n1.5,2,-20\n")
    rows = sorted((r.t_us, r.electrode, r.mea, r.amplitude) for r in src.read_spikes(spark, str(p)).collect())
    assert rows == [(0, 1, 0, -10.0), (1_000_000, 2, 0, -20.0)]


def test_vendor_csv_with_instants(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text("_time,_value,index\n2024-01-01T00:00:01Z,-5,3\n2024-01-01T00:00:03Z,-6,40\n")
    assert sorted((r.t_us, r.electrode) for r in src.read_spikes(spark, str(p)).collect()) == [(0, 3), (2_000_000, 8)]


def test_json_of_arrays_and_rows(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"times": [0.0, 2.0], "electrodes": [1, 2], "amplitudes": [3.0, 4.0]}))
    b.write_text(json.dumps([{"time": 0.0, "electrode": 1, "amplitude": 3.0}, {"time": 2.0, "electrode": 2, "amplitude": 4.0}]))
    read = lambda p: sorted((r.t_us, r.electrode, r.amplitude) for r in src.read_spikes(spark, str(p)).collect())
    assert read(a) == read(b) == [(0, 1, 3.0), (2_000_000, 2, 4.0)]


def test_round_trip(spark, tmp_path):
    x = src.spikes(spark, SF).limit(50)
    x = x.cache()
    t0 = min(r.t_us for r in x.collect())
    want = sorted((r.t_us - t0, r.electrode, round(r.amplitude, 6)) for r in x.collect())
    for kind in ("csv", "parquet", "json"):
        src.write_spikes(x, f"{tmp_path}/o.{kind}")
        back = src.resolve(spark.read.json(f"{tmp_path}/o.json")) if kind == "json" else src.read_spikes(spark, f"{tmp_path}/o.{kind}")
        assert sorted((r.t_us, r.electrode, round(r.amplitude, 6)) for r in back.collect()) == want
    with pytest.raises(ValueError):
        src.read_spikes(spark, "x.xyz")


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return channel_events(spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(SF))


def test_stream_equals_batch(spark):
    batch = channel_events(spark.read.parquet(f"{SF}/events.parquet"))
    for name, op in (("r", rates.stream_rates), ("b", lambda d: rates.stream_bursts(d, gap="6 hours"))):
        got = _run(spark, op(_stream(spark)), f"t_{name}", "complete" if name == "r" else "complete")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, op(batch).collect()))


def test_running_intervals(spark):
    got = {r.electrode: (r.n, round(r.mean_s, 3)) for r in _run(spark, rates.stream_intervals(_stream(spark)), "t_i", "update").collect()}
    batch = channel_events(spark.read.parquet(f"{SF}/events.parquet")).groupBy("electrode").agg(F.count("*").alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("s"))
    assert got == {r.electrode: (r.n - 1, round(r.s / (r.n - 1), 3)) for r in batch.collect()}

"""Operators by name, selection, JSON and the command line."""

import json

import pytest

from pulselake import api
from pulselake.__main__ import main


def test_every_operator_is_listed():
    assert {"firing_rates", "bursts_max_interval", "ccg_counts", "evolution_windows", "granger", "composite"} <= set(api.operators())
    assert {"triad_census", "betweenness"} <= set(api.network_operators())
    assert api.parameters("firing_rates") == {"width": ...}


def test_analyze_by_name(spark):
    df = api.example(spark, duration_s=10)
    assert api.summary(df).first().n_spikes == 800
    assert api.analyze(df, "firing_rates", width=1_000_000).where("n < 0").count() == 0
    assert api.select(df, 0, 5_000_000, [1, 2]).where("t_us > 5000000 or electrode > 2").count() == 0
    with pytest.raises(KeyError):
        api.analyze(df, "nothing")


def test_json_has_no_odd_numbers(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "a int, b double")
    assert sorted((json.loads(r.json)["a"], json.loads(r.json)["b"]) for r in api.as_json(df).collect()) == [(1, 0.0), (2, 0.0), (3, 0.5)]


def test_command_line(capsys):
    assert main(["list"]) == 0 and "firing_rates" in capsys.readouterr().out
    assert main(["show", "firing_rates"]) == 0 and main([]) == 2

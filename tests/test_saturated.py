"""Recordings that fill every bin or repeat every instant, against the queries' SQL."""

import datetime

import duckdb
import numpy as np
import pytest
from test_catalog import _flat

from pulselake.operators import pairs
from pulselake.plans import catalog

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
T = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def steady(spark, tmp_path_factory):
    """Four channels that fire together every ten minutes for three days."""
    path = str(tmp_path_factory.mktemp("steady"))
    rows = [(4 * i + e, T + datetime.timedelta(minutes=10 * i), e, ["view", "purchase"][i % 2], 1.0 + i % 5, "{}") for i in range(433) for e in range(4)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def both(spark, path, name):
    """Rows of the query and of its SQL, sorted."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet/*.parquet')")
    con.execute("set timezone = 'UTC'")
    cur = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = sorted(str([_flat(float(v) if type(v).__name__ == "Decimal" else v) for v in r]) for r in cur.fetchall())
    return sorted(str([_flat(r[c]) for c in columns]) for r in catalog.QUERIES[name](spark, path).collect()), want


@pytest.mark.parametrize("name", ["prediction_error_electrodes", "prediction_error_summary", "trends"])
def test_constant_series_have_no_correlation(spark, steady, name):
    got, want = both(spark, steady, name)
    assert got == want


def test_channels_that_fill_every_bin(spark, steady):
    got, want = both(spark, steady, "cofiring_phi")
    assert got == want and len(got) == 6


@pytest.mark.parametrize("name", ["powerlaw_tests", "powerlaw_pvalues"])
def test_one_avalanche_has_an_empty_tail(spark, steady, name):
    got, want = both(spark, steady, name)
    assert got == want and "0" in got[0]


def test_pairs_are_counted_without_being_made(spark):
    """Many events at few instants, and many at instants of their own: counts as by brute force, from a plan without a join."""
    rng = np.random.default_rng(4)
    reach, width = 60_000_000, 20_000_000
    for times in (rng.integers(0, 20, 600) * 10_000_000, rng.integers(0, 300_000_000, 600)):
        e = rng.integers(0, 3, 600)
        df = spark.createDataFrame([(i, int(t), int(c)) for i, (t, c) in enumerate(zip(times, e, strict=True))], "spike_id long, t_us long, electrode int")
        dt = times[None, :] - times[:, None]
        near = (np.abs(dt) <= reach) & (e[:, None] != e[None, :])
        want = {}
        for i, j in zip(*np.nonzero(near & (e[:, None] < e[None, :])), strict=True):
            key = int(e[i]), int(e[j]), min(int(dt[i, j] + reach) // width, 2 * reach // width - 1)
            want[key] = want.get(key, 0) + 1
        counts = pairs.ccg_counts(df, reach, width)
        assert {(r.e1, r.e2, r.lag_bin): r.n for r in counts.collect()} == want
        assert "Join" not in counts._jdf.queryExecution().executedPlan().toString()
        for r in pairs.stdp_pairs(df, reach).collect():
            d = dt[near & (e[:, None] == r.e1) & (e[None, :] == r.e2)]
            assert (r.ltp, r.ltd) == ((d > 0).sum(), (d < 0).sum())
            assert r.mean_lead_s == pytest.approx(d[d > 0].mean() / 1e6, abs=6e-4) and r.mean_trail_s == pytest.approx(d[d < 0].mean() / 1e6, abs=6e-4)


@pytest.mark.parametrize("name", ["ccg_peak", "stdp_pairs", "learning_episodes", "ccg_significance", "stim_trials", "stim_electrodes", "dose_response"])
def test_pairs_of_repeated_instants(spark, steady, name):
    got, want = both(spark, steady, name)
    assert got == want and got

"""Queries against their SQL on the smallest data, and the registry's contract."""

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry_module
from pulselake.plans import catalog

SF = "/root/testdata/sf0.001"
#: One or two of each family; the whole catalogue runs the same way.
NAMES = [
    "firing_rates", "isi_stats", "amplitude_histogram", "downsample_even", "quality_gaps", "suffering_flags", "rate_forecast", "bursts_max_interval", "bursts_per_electrode",
    "network_bursts", "avalanches", "powerlaw_mle", "updown_epochs", "ccg_counts", "stdp_pairs", "stim_trials", "cofiring_phi", "lagged_corr", "transition_mi", "transfer_entropy",
    "evolution_windows", "critical_moments", "phase_windows", "artifact_flags", "sequence_motifs", "burst_profiles", "mea_bins", "forgetting", "state_landscape", "snapshot", "dense_buckets", "surprise", "cosinor_24h", "triad_census", "rich_club", "stream_rates", "stream_bursts",
]


def _flat(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(str([_flat(r[c]) for c in names]) for r in df.collect())
    want = sorted(str([_flat(float(v) if type(v).__name__ == "Decimal" else v) for v in r]) for r in cur.fetchall())
    assert got == want


def test_all_others_match_sql(spark, duck):
    """The rest of the catalogue, several at a time."""
    names = sorted(set(catalog.ORACLE_SQL) - set(NAMES))
    with ThreadPoolExecutor(8) as pool:
        frames = list(pool.map(lambda n: catalog.QUERIES[n](spark, SF).toArrow().to_pylist(), names))
    wrong = []
    for name, rows in zip(names, frames, strict=True):
        cur = duck.execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in cur.description]
        want = sorted(str([_flat(float(v) if type(v).__name__ == "Decimal" else v) for v in r]) for r in cur.fetchall())
        if sorted(str([_flat(r[c]) for c in columns]) for r in rows) != want:
            wrong.append(name)
    assert not wrong


def test_entry_points(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_unknown_operator(spark):
    with pytest.raises(KeyError):
        catalog.run("nothing", spark, SF)


@pytest.mark.parametrize("name", ["welch_psd", "granger", "betweenness", "communities", "hmm_updown", "persistence", "lz76"])
def test_rows_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

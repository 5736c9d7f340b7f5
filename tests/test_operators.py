"""Micro-fixtures with results worked out by hand, and planted signals."""

import math

import numpy as np
import pytest

from pulselake.operators import bursts, evolution, graph, grid, pairs, rates, signal

S = 1_000_000
SCHEMA = "spike_id long, t_us long, electrode int, mea int, amplitude double"


def make(spark, rows):
    return spark.createDataFrame([(i, int(t), e, e // 8, 1.0) for i, (t, e) in enumerate(rows)], SCHEMA)


def test_grid_closes_the_last_bin(spark):
    df = make(spark, [(0, 0), (10 * S, 0), (20 * S, 0)])
    got = {(r.bin, r.n) for r in grid.dense_counts(df, 10 * S, "electrode").collect()}
    assert got == {(0, 1), (1, 2)}  # the event on the last edge belongs to the last bin


def test_sliding_windows_are_closed_on_both_ends(spark):
    df = make(spark, [(0, 0), (10 * S, 0), (20 * S, 0), (25 * S, 0)])
    got = sorted((r.win, r.t_us // S) for r in grid.windows(df, 10 * S, 10 * S).collect())
    assert got == [(0, 0), (0, 10), (1, 10), (1, 20)]


def test_chunked_scan_equals_global_order(spark):
    day = grid.CHUNK_US
    times = [0, 5, day - 1, day, 3 * day + 7, 3 * day + 7, 5 * day]
    df = make(spark, [(t, 0) for t in times])
    prev = {r.spike_id: r.prev_us for r in grid.with_previous(df).collect()}
    assert [prev[i] for i in range(len(times))] == [None, *times[:-1]]
    run = {r.spike_id: r.k for r in grid.running_sum(df, grid.F.lit(1), "k").collect()}
    assert [run[i] for i in range(len(times))] == list(range(1, len(times) + 1))


def test_one_burst(spark):
    times = [0, 100, 200, 200.05, 200.1, 200.15, 200.2, 300, 400]
    df = make(spark, [(t * S, 0) for t in times])
    wide = bursts.bursts_max_interval(df, S // 10, S // 5, S, 3, 0).collect()
    assert [(r.start_us, r.end_us) for r in wide] == [(200 * S, int(200.2 * S))]
    narrow = bursts.bursts_max_interval(df, S // 10, S // 50, S, 3, 0).collect()
    assert [(r.start_us, r.end_us) for r in narrow] == [(200 * S, int(200.2 * S))]
    assert bursts.bursts_max_interval(df, S // 10, S // 5, S, 6, 0).count() == 0


def test_bursts_merge_below_the_gap(spark):
    times = [0, 0.05, 0.1, 0.6, 0.65, 0.7]
    df = make(spark, [(t * S, 0) for t in times])
    assert bursts.bursts_max_interval(df, S // 10, S // 5, S, 3, 0).count() == 1
    assert bursts.bursts_max_interval(df, S // 10, S // 5, S // 10, 3, 0).count() == 2


def test_lag_pair(spark):
    base = [i * 100 for i in range(50)]
    df = make(spark, [(t * S, 0) for t in base] + [((t + 10) * S, 1) for t in base])
    peak = pairs.ccg_peak(df, 30 * S, 4 * S).first()
    assert peak.lag_s == 12.0 or abs(peak.lag_s - 10) <= 4
    asym = {(r.e1, r.e2): r.asymmetry for r in pairs.stdp_pairs(df, 30 * S).collect()}
    assert asym[0, 1] == 1.0 and asym[1, 0] == -1.0


def test_independent_channels_share_little(spark):
    rng = np.random.default_rng(3)
    rows = [(int(t), e) for e in range(2) for t in rng.uniform(0, 3600 * S, 600)]
    df = make(spark, sorted(rows))
    assert abs(pairs.cofiring_phi(df, S, 3.29).first().phi) < 0.08
    assert pairs.mi_pairs(df, S).first().mi < 0.01
    assert all(r.te < 0.02 for r in pairs.transfer_entropy(df, S, 2).collect())


def test_planted_artifacts(spark):
    rng = np.random.default_rng(5)
    real = [(int(t), e) for e in range(16) for t in rng.uniform(0, 6000 * S, 50)]
    fake = [(int(t) // 1000 * 1000, e) for t in rng.uniform(0, 6000 * S, 20) for e in range(16)]
    flags = {r.spike_id: r.flag for r in evolution.artifact_flags(make(spark, real + fake), S // 500).collect()}
    planted = [flags[i] for i in range(len(real), len(real) + len(fake))]
    assert np.mean(planted) > 0.9 and np.mean([flags[i] for i in range(len(real))]) < 0.1


def test_triangle_and_chain(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.5), (2, 3, 0.5)], "e1 int, e2 int, r double")
    nodes = spark.createDataFrame([(i,) for i in range(5)], "electrode int")
    got = graph.triad_census(edges, nodes).first()
    assert (got.triangle, got.chain + got.star, got.single_edge) == (1, 2, 5)
    deg = {r.electrode: r.degree for r in graph.node_degree(edges).collect()}
    assert deg == {0: 2, 1: 2, 2: 3, 3: 1}
    between = {r.electrode: r.betweenness for r in signal.betweenness(edges).collect()}
    assert between[2] == pytest.approx(2 / 3) and between[0] == 0


def test_sine_rate(spark):
    hours = 24 * 10
    rows = []
    for h in range(hours):
        n = round(20 + 15 * math.cos(2 * math.pi * (h - 6) / 24))
        rows += [(h * 3600 * S + k * 1000, 0) for k in range(n)]
    rows.append((hours * 3600 * S - 1, 0))
    df = make(spark, rows)
    c = evolution.cosinor(df, 3600 * S, 24.0).first()
    assert c.acrophase_h == pytest.approx(6, abs=0.2) and c.r_squared > 0.95
    auto = {r.lag: r.r for r in evolution.autocorrelation(df, 3600 * S, 24).collect()}
    assert auto[0] == 1.0 and auto[24] > 0.8 > 0 > auto[12]


def test_two_tones_are_coherent(spark):
    rows = []
    for b in range(256):
        n = 3 + (b % 8 < 4) * 4
        rows += [(b * S + k, e) for e in (0, 1) for k in range(n)]
    got = signal.phase_locking(make(spark, rows), S, 0.1, 0.5).first()
    assert got.plv == pytest.approx(1.0)


def test_lempel_ziv():
    assert signal.lempel_ziv(np.array([0] * 64)) < signal.lempel_ziv(np.array([0, 1] * 32)) + 1
    rng = np.random.default_rng(1)
    assert signal.lempel_ziv(rng.integers(0, 2, 512)) > 3 * signal.lempel_ziv(np.array([0, 1] * 256))


@pytest.mark.parametrize("op", [lambda d: rates.firing_rates(d, S), lambda d: rates.isi_stats(d, S), rates.amplitude_stats, lambda d: bursts.avalanches(d, S), lambda d: pairs.cofiring_phi(d, S, 3.0), lambda d: evolution.artifact_flags(d, S)])
def test_degenerate_inputs(spark, op):
    empty = spark.createDataFrame([], SCHEMA)
    assert op(empty).count() == 0
    op(make(spark, [(0, 0)])).collect()
    op(make(spark, [(0, 0), (5 * S, 0)])).collect()


def test_spikes_in_a_raw_signal(spark):
    from pulselake.operators.emergence import detect_in_signal

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 4000)
    for at in (500, 1500, 3000):
        x[at] -= 40
    raw = spark.createDataFrame([(3, 10_000, x.tolist())], "electrode int, start long, samples array<double>")
    got = detect_in_signal(raw, factor=8.0).collect()
    assert [(r.electrode, r.sample) for r in got] == [(3, 10_500), (3, 11_500), (3, 13_000)] and all(len(r.waveform) == 90 for r in got)

"""Filters, half waves, local rates and lagged models against plain versions and planted signals."""

import math

import numpy as np
import pytest
from test_significance import S, coupled, make

from pulselake.operators import linear, waves


def counts_to_rows(x):
    return [(b * S + k, e) for e, row in enumerate(x) for b, n in enumerate(row) for k in range(int(n))]


def dense(rows, bins):
    m = np.zeros((max(e for _, e in rows) + 1, bins))
    for t, e in rows:
        m[e, min(t // S, bins - 1)] += 1
    return m


def test_filter_equals_a_convolution(spark):
    rng = np.random.default_rng(1)
    rows = sorted((int(t), 0) for t in rng.uniform(0, 300 * S, 500))
    x = dense(rows, max(1, -(-rows[-1][0] // S) if rows[0][0] == 0 else -(-rows[-1][0] // S)))[0]
    kernel = waves.band_kernel(0.1, 0.5, 6)
    assert sum(kernel) == pytest.approx(0, abs=1e-12)
    got = [r.y for r in waves.band_passed(make(spark, rows), S, 0.1, 0.5, 6).orderBy("bin").collect()]
    assert np.allclose(got, np.convolve(x, kernel)[6:-6], atol=1e-8)


def test_half_waves_of_a_sine_across_chunks(spark):
    """Forty bins a wave over more than one chunk of the stitched scan."""
    bins = 400
    x = [[round(10 + 8 * math.sin(2 * math.pi * b / 40)) for b in range(bins)]]
    rows = [(b * 60 * S + k, 0) for b, n in enumerate(x[0]) for k in range(n)]
    got = sorted(waves.half_waves(make(spark, rows), 60 * S, 0.02, 0.1, 30, 10, 30).collect(), key=lambda r: r.start_bin)
    inner = [r for r in got if 60 < r.start_bin < 340]
    assert len(inner) >= 12 and all(abs(r.bins - 20) <= 1 for r in inner) and all((r.peak > 0) == bool(r.positive) for r in inner)
    assert all(a.positive != b.positive for a, b in zip(inner, inner[1:], strict=False))


def test_slow_band_holds_a_slow_sine(spark):
    x = [[round(10 + 8 * math.sin(2 * math.pi * b / 16)) for b in range(320)]]
    got = {r.band: r for r in waves.slow_oscillation(make(spark, counts_to_rows(x)), S, 64, {"slow": (1, 6), "fast": (7, 32)}).collect()}
    assert got["slow"].peak_step == 4 and got["slow"].share > 0.9 and got["slow"].detected == 1 and got["fast"].detected == 0


def test_local_rates_by_brute_force(spark):
    rng = np.random.default_rng(2)
    hour = 3600 * S
    rows = sorted((int(t), int(e)) for e in range(2) for t in np.concatenate([rng.uniform(0, 6 * hour, 60), [hour, hour + 1, 2 * hour - 1]]))
    got = {r.spike_id: r for r in waves.local_rates(make(spark, rows), hour).collect()}
    assert len(got) == len(rows)
    for i, (t, e) in enumerate(rows):
        own = [u for u, f in rows if f == e]
        n = sum(abs(u - t) <= hour // 2 for u in own)
        span = max(1, min(t + hour // 2, max(own)) - max(t - hour // 2, min(own)))
        assert got[i].n == n and got[i].rate_hz == pytest.approx(n / (span / 1e6), abs=1e-6)


def test_lagged_products_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(linear, "CHUNK_BINS", 16)
    rows = coupled(5, 60)
    rows = [(0, 0), *rows]
    bins = -(-max(t for t, _ in rows) // S)
    m, p = dense(rows, bins), 3
    got = linear.lagged_products(make(spark, rows), S, p).collect()
    want = {}
    for i in range(3):
        for j in range(3):
            for a in range(p + 1):
                for b in range(p + 1):
                    v = float(m[i, p - a : bins - a] @ m[j, p - b : bins - b])
                    if v:
                        want[i, a, j, b] = v
    want |= {(i, a, -1, 0): m[i, p - a : bins - a].sum() for i in range(3) for a in range(p + 1)}
    assert {(r.i, r.a, r.j, r.b): r.v for r in got} == want and {r.bins for r in got} == {bins - p}


def test_order_and_granger_by_least_squares(spark):
    rng = np.random.default_rng(7)
    rows = [(0, 0), *((t, e) for t, e in coupled(6, 500) if e != 1 or rng.random() < 0.7)]
    bins = -(-max(t for t, _ in rows) // S)
    m, most = dense(rows, bins), 4
    df = make(spark, rows)
    lagged = lambda e, p: np.stack([m[e, most - k : bins - k] for k in range(1, p + 1)], 1)
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    rss = lambda x, y: float(((y - one(x) @ np.linalg.lstsq(one(x), y, rcond=None)[0]) ** 2).sum())
    top = int(np.bincount([e for _, e in rows]).argmax())
    n = bins - most
    bic = {p: n * math.log(rss(lagged(top, p), m[top, most:]) / n) + p * math.log(n) for p in range(1, most + 1)}
    got = {r.order: r for r in linear.order_selection(df, S, most).collect()}
    assert all(got[p].bic == pytest.approx(bic[p]) for p in bic) and [p for p in got if got[p].chosen] == [min(bic, key=bic.get)]
    p = min(bic, key=bic.get)
    out = {(r.e1, r.e2): r for r in linear.granger_significance(df, S, most, 0.05).collect()}
    for (i, j), r in out.items():
        y = m[j, most:]
        a, b = rss(lagged(j, p), y), rss(np.hstack([lagged(j, p), lagged(i, p)]), y)
        assert r.f_stat == pytest.approx((a - b) / p / (b / (n - 2 * p - 1)), abs=1e-5)
    assert out[0, 1].significant == 1 and out[0, 1].p < 1e-6 and out[2, 1].p > 0.001


def test_coalition_of_channels_in_phase(spark):
    """Two channels share a rhythm, a third keeps its own."""
    from pulselake.operators import metastable

    rng = np.random.default_rng(11)
    beat = [6 + round(5 * math.sin(2 * math.pi * b / 12)) for b in range(240)]
    x = [beat, beat, rng.integers(0, 3, 240).tolist()]
    got = metastable.coalitions(make(spark, counts_to_rows(x)), S, 48, 0.6).collect()
    assert sum(r.windows for r in got) == 5 and all(r.code & 3 == 3 for r in got)
    assert max(got, key=lambda r: r.windows).code == 3


def test_network_states_by_hand(spark):
    """Group 0 is busy in even pairs of bins, group 1 in odd ones: two states of two bins each."""
    from pulselake.operators import metastable

    rows = [(b * S + k, 0 if b // 2 % 2 == 0 else 8) for b in range(40) for k in range(3)] + [(b * S + 9, e) for b in range(40) for e in (0, 8)] + [(40 * S - 1, 8)]
    df = make(spark, rows)
    dwell = {r.state: (r.visits, r.runs, r.mean_dwell) for r in metastable.metastable_dwell(df, S).collect()}
    assert dwell == {1: (20, 10, 2.0), 2: (20, 10, 2.0)}
    steps = {(r.s, r.f): r.n for r in metastable.metastable_transitions(df, S).collect()}
    assert steps == {(1, 1): 10, (1, 2): 10, (2, 2): 10, (2, 1): 9}
    assert metastable.metastable_summary(df, S).first().changes == 19

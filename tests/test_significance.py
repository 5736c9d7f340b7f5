"""Surrogates, rank tests, p-values, bootstraps and cuts: planted effects, brute force and known values."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import pairs, partition, significance, surrogates

S = 1_000_000
SCHEMA = "spike_id long, t_us long, electrode int, mea int, amplitude double"


def make(spark, rows):
    return spark.createDataFrame([(i, int(t), int(e), int(e) // 8, 1.0) for i, (t, e) in enumerate(rows)], SCHEMA)


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def coupled(seed, n=400, lag=1):
    """Channel 1 repeats channel 0 one second later; channel 2 is its own."""
    rng = np.random.default_rng(seed)
    a, c = np.sort(rng.choice(3000, n, replace=False)), rng.uniform(0, 3000, n)
    return sorted([(t * S + 500, 0) for t in a] + [((t + lag) * S + 500, 1) for t in a] + [(int(t * S), 2) for t in c])


def test_draws_can_be_repeated(spark):
    got = spark.range(3).select(surrogates.draw(F.lit("w"), "id").alias("h")).collect()
    assert [r.h for r in got] == [draw("w", i) for i in range(3)]


def test_transfer_entropy_finds_the_driver(spark):
    got = {(r.e1, r.e2): r for r in surrogates.te_significance(make(spark, coupled(1)), S, 2, 20, 0.3).collect()}
    assert len(got) == 6 and got[0, 1].p == 0 and got[0, 1].z > 10 and got[0, 1].significant == 1
    assert got[2, 0].significant == 0 and got[2, 1].significant == 0


def test_sparse_cells_equal_dense_ones(spark):
    df = make(spark, coupled(2, 150))
    sparse = {(r.e1, r.e2): r.te for r in surrogates.transfer_entropies(df, S, 2, 0).collect()}
    dense = {(r.e1, r.e2): r.te for r in pairs.transfer_entropy(df, S, 2).collect()}
    assert sparse.keys() == dense.keys() and all(sparse[k] == pytest.approx(dense[k], abs=1e-6) for k in dense)


def test_correlogram_and_information_against_surrogates(spark):
    df = make(spark, coupled(3, lag=0))
    ccg = {(r.e1, r.e2): r for r in surrogates.ccg_significance(df, 5 * S, S // 2, 4 * S, 20, 0.2).collect()}
    mi = {(r.e1, r.e2): r for r in surrogates.mi_significance(df, 2 * S, 20, 0.2).collect()}
    for got in (ccg, mi):
        assert got[0, 1].p == 0 and got[0, 1].z > 5 and got[0, 1].significant == 1
        assert got[0, 2].z < 4 and got[0, 2].significant == 0


def test_phase_locking_against_rotations(spark):
    rng = np.random.default_rng(4)
    rows = []
    for b in range(512):
        beat = 3 + 4 * (math.sin(b / 5 + 3 * math.sin(b / 40)) > 0)
        rows += [(b * S + k, e) for e in (0, 1) for k in range(beat + rng.integers(0, 2))] + [(b * S + k, 2) for k in range(rng.integers(1, 8))]
    got = {(r.e1, r.e2): r for r in surrogates.plv_significance(make(spark, rows), S, 20, 0.2).collect()}
    assert got[0, 1].p == 0 and got[0, 1].plv > 0.9 and got[0, 2].plv < 0.4


def test_verdict_by_hand(spark):
    rows = [("a", 0, 3.0), ("a", 1, 1.0), ("a", 2, 3.0), ("b", 0, 5.0), ("b", 1, 1.0), ("c", 1, 9.0)]  # b lacks a replicate, c an observation
    got = {r.k: r for r in surrogates.verdict(spark.createDataFrame(rows, "k string, rep int, v double"), ["k"], "v", 2, 0.5).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].null_mean, got["a"].null_std, got["a"].p, got["a"].z) == (2.0, 1.0, 0.5, 1.0)
    assert (got["b"].null_mean, got["b"].p) == (0.5, 0.0)
    assert got["b"].q == pytest.approx(2 / 3, abs=1e-6) and got["a"].q == pytest.approx(2 / 3, abs=1e-6)


def test_states_in_random_bins(spark):
    rng = np.random.default_rng(5)
    bins = [b for b in range(400) for _ in range(20 if b // 20 % 2 else 2)]
    got = {r.what: r for r in surrogates.updown_null(make(spark, [(b * S + int(rng.integers(0, S)), 0) for b in bins]), S, 20, 0.2).collect()}
    assert got["bimodality"].p == 0 and got["changes"].value == 19 and got["changes"].p == 1.0  # far fewer changes than by chance


def test_special_functions(spark):
    z = [0.0, 0.1, 1.0, 1.96, 3.0, 5.0, -2.5, 9.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(significance.normal_p(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [math.erfc(abs(v) / math.sqrt(2)) for v in z], atol=1e-9)

    def beta(x, a, b):  # midpoint rule
        t = (np.arange(400_000) + 0.5) / 400_000
        w = t ** (a - 1) * (1 - t) ** (b - 1)
        return w[t < x].sum() / w.sum()

    cases = [(0.3, 2.0, 3.0), (0.9, 5.0, 1.5), (0.999, 350.0, 2.0), (0.5, 40.0, 40.0), (0.2, 1.5, 60.0)]
    df = spark.createDataFrame(cases, "x double, a double, b double")
    got = [r.v for r in df.select(significance.incomplete_beta(F.col("x"), F.col("a"), F.col("b")).alias("v")).collect()]
    assert np.allclose(got, [beta(*c) for c in cases], atol=1e-4)
    edge = spark.createDataFrame([(0.0, 1.0, 2.0), (1.0, 1.0, 2.0)], "x double, a double, b double").select(significance.incomplete_beta(F.col("x"), F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in edge] == [0.0, 1.0]
    one = spark.range(1).select(significance.student_p(F.lit(2.228), F.lit(10.0)).alias("t"), significance.variance_ratio_p(F.lit(3.4928), F.lit(2.0), F.lit(20.0)).alias("f")).first()
    assert one.t == pytest.approx(0.05, abs=1e-4) and one.f == pytest.approx(0.05, abs=1e-4)  # the tables' five per cent points


def test_rank_sum_with_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(g), int(rng.integers(0, 6) + g * (k == 1))) for k in (0, 1) for g in rng.integers(0, 2, 80)]
    for r in significance.rank_sum(spark.createDataFrame(rows, "k int, g int, v int"), "g", "v", "k").collect():
        x, y = ([v for k, g, v in rows if k == r.k and g == s] for s in (1, 0))
        u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
        n, ties = len(x) + len(y), sum(c**3 - c for c in np.bincount(x + y).tolist())
        z = (u - len(x) * len(y) / 2) / math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
        assert (r.n1, r.n0, r.u) == (len(x), len(y), u) and r.z == pytest.approx(z) and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)
    assert significance.rank_sum(spark.createDataFrame([(0, 1, 2)], "k int, g int, v int"), "g", "v", "k").count() == 0


def test_prediction_error_channel(spark):
    """Five channels keep a state that breaks now and then; channel 5 fires only at the breaks."""
    rng, rows = np.random.default_rng(7), []
    for b in range(600):
        odd = b > 10 and rng.random() < 0.1
        rows += [(b * S + e, e) for e in range(5) if (e < 3) != odd] + ([(b * S + 9, 5)] if odd else [])
        rows += [(b * S + 20, 6)] * int(rng.random() < 0.05)
    got = {r.electrode: r for r in significance.prediction_error_electrodes(make(spark, rows), S, 6).collect()}
    assert got[5].r > 0.9 and got[5].significant == 1 and got[6].significant == 0


def test_bootstrap_of_a_true_power_law(spark, monkeypatch):
    """One avalanche per run of bins, sizes drawn from a power law of exponent 2.5."""
    rng = np.random.default_rng(8)
    sizes = np.minimum(np.floor(3 * (1 - rng.random(600)) ** (-1 / 1.5)), 2000).astype(int)
    rows = [(2 * i * S + k, 0) for i, n in enumerate(sizes) for k in range(n)]
    r = significance.powerlaw_bootstrap(make(spark, rows), S, 20).first()
    assert r.alpha_low < r.alpha < r.alpha_high and r.alpha_high - r.alpha_low < 0.8 and 0 <= r.fit_p <= 1


def plain_information(states, mask):
    from collections import Counter

    x = [s & mask for s in states]
    joint, a, b, n = Counter(zip(x, x[1:], strict=False)), Counter(x[:-1]), Counter(x[1:]), len(x) - 1
    return sum(c / n * math.log2(c * n / (a[i] * b[j])) for (i, j), c in joint.items())


def plain_phi(states, whole):
    low = whole & -whole
    cuts = [m for m in range(1, whole) if m & whole == m and m & low]
    return min((round(max(0.0, plain_information(states, whole) - plain_information(states, m) - plain_information(states, whole - m)), 9), m) for m in cuts)


@pytest.fixture(scope="module")
def small_network():
    rng = np.random.default_rng(9)
    states, s = [], 0
    for _ in range(200):
        s = ((s << 1) & 0b11110) | int(rng.random() < 0.4) if rng.random() < 0.8 else int(rng.integers(0, 32))
        states.append(s)
    states[-1] = 31
    return states, [(b * S, e) for b, s in enumerate(states) for e in range(5) if s >> e & 1]


def test_exact_cut_and_its_null(spark, small_network):
    states, rows = small_network
    df = make(spark, rows)
    states = states[:-2] + [states[-2] | states[-1]]  # the last edge closes the bin before it
    phi, mask = plain_phi(states, 31)
    got = partition.phi_exact(df, S).first()
    assert (got.part, got.rest) == (mask, 31 - mask) and got.phi == pytest.approx(phi, abs=1e-6)
    null = []
    for rep in range(1, 4):
        out = [0] * len(states)
        for e in range(5):
            order = sorted(range(len(states)), key=lambda b: (draw(rep, e, b), b))
            for place, b in enumerate(order):
                out[place] |= (states[b] >> e & 1) << e
        null.append(plain_phi(out, 31)[0])
    r = partition.phi_null(df, S, 3, 0.5).first()
    assert r.phi == pytest.approx(phi, abs=1e-6) and r.null_mean == pytest.approx(np.mean(null), abs=1e-6) and r.p == pytest.approx(np.mean([x >= phi for x in null]), abs=1e-6)


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(10)
    for n in (2, 3, 5, 8):
        for _ in range(20):
            w = rng.random((n, n)) * (rng.random((n, n)) < 0.7)
            w = np.triu(w, 1) + np.triu(w, 1).T
            weight, side = partition.minimum_cut(w)
            every = [list(c) for k in range(1, n) for c in itertools.combinations(range(n), k)]
            cost = lambda c: w[np.ix_(c, [i for i in range(n) if i not in c])].sum()
            assert weight == pytest.approx(min(map(cost, every))) and cost(side) == pytest.approx(weight)


def test_network_cut_equals_the_groups_cut(spark, small_network):
    df = make(spark, small_network[1])
    a, b = partition.phi_mip(df, S).first(), partition.phi_network(df, S).first()
    assert a.weight == pytest.approx(b.weight, abs=1e-6) and a.whole_mi == pytest.approx(b.whole_mi, abs=1e-6)

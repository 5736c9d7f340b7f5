"""Queries on spectra, states, learning and weighted networks; SQL checks those whose sums it can write down."""

from __future__ import annotations

from ..operators import learning, signal
from ..sources.events import spikes
from .evolving import DAY, H, _edges
from .registry import dense_sql, register, register_raw, rounded, waves_sql


def _vectors(spark, sf_dir):
    return learning.waveform_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), spikes(spark, sf_dir))


#: Fourier sums (e, i, f, re, im) of half-overlapping Hann-windowed segments of 64 bins; the recording has 64 at least.
SEG = f""", {dense_sql(H)}, sg as (select e, i, b - i * 32 as j, n from dn cross join (select unnest(range(0, ((select max(b) + 1 from dn) - 64) // 32 + 1)) as i) where b between i * 32 and i * 32 + 63),
hn as (select e, i, j, (n - avg(n) over (partition by e, i)) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) as v from sg),
ft as (select e, i, f, sum(v * cos(2 * pi() * f * j / 64)) as re, -sum(v * sin(2 * pi() * f * j / 64)) as im from hn cross join (select unnest(range(0, 33)) as f) group by 1, 2, 3)"""
#: Phases as unit vectors (e, b, c, s).
PHASES = f""", {dense_sql(H)}, {waves_sql('dn', 'e', 0.02, 0.5, 'z')}, u as (select e, b, zr / sqrt(zr * zr + zi * zi) as c, zi / sqrt(zr * zr + zi * zi) as s from z)"""
KURAMOTO = f"{PHASES}, ku as (select b, sqrt(pow(avg(c), 2) + pow(avg(s), 2)) as r from u group by 1)"

register(
    "welch_psd", lambda df: rounded(signal.welch_psd(df, H), 4),
    f"""{SEG} select e as electrode, round(f / (64 * 3600.0), 4) as freq_hz, round(avg(re * re + im * im) * 3600 / (select sum(pow(0.5 - 0.5 * cos(2 * pi() * j / 64), 2)) from (select unnest(range(0, 64)) as j)) * case when f in (0, 32) then 1 else 2 end, 4) as power
from ft group by e, f""",
)
register(
    "coherence", lambda df: rounded(signal.coherence(df, H)),
    f"""{SEG}, ow as (select e, f, avg(re * re + im * im) as p from ft group by 1, 2),
cx as (select a.e as e1, b.e as e2, a.f, pow(avg(a.re * b.re + a.im * b.im), 2) + pow(avg(a.im * b.re - a.re * b.im), 2) as p from ft a join ft b on a.i = b.i and a.f = b.f and a.e < b.e where a.f > 0 group by 1, 2, 3)
select e1, e2, round(avg(cx.p / greatest(x.p * y.p, 1e-300)), 6) as coherence from cx join ow x on x.e = e1 and x.f = cx.f join ow y on y.e = e2 and y.f = cx.f group by 1, 2""",
)
register(
    "plv", lambda df: rounded(signal.phase_locking(df, H)),
    f"{PHASES} select a.e as e1, b.e as e2, round(sqrt(pow(avg(a.c * b.c + a.s * b.s), 2) + pow(avg(a.s * b.c - a.c * b.s), 2)), 6) as plv from u a join u b on a.b = b.b and a.e < b.e group by 1, 2",
)
register("kuramoto", lambda df: rounded(signal.kuramoto(df, H)), f"{KURAMOTO} select b as bin, round(r, 6) as order_parameter from ku")
register("granger", lambda df: signal.granger(df, H))
register("ridge_weights", lambda df: signal.ridge_weights(df, H))
register("memory_capacity", lambda df: signal.memory_capacity(df, H))
register("lz76", lambda df: signal.lz_complexity(df, H))
register(
    "sample_entropy", lambda df: rounded(signal.sample_entropy(df, H)),
    f""", {dense_sql(H)}, x as (select e, b, n as x0, lead(n, 1) over (partition by e order by b) as x1, lead(n, 2) over (partition by e order by b) as x2, 0.2 * stddev_pop(n) over (partition by e) as tol from dn),
p as (select a.e, count(*) as m2, count(*) filter (abs(a.x2 - b.x2) <= a.tol) as m3 from x a join x b on a.e = b.e and a.b < b.b and abs(a.x0 - b.x0) <= a.tol and abs(a.x1 - b.x1) <= a.tol where a.x2 is not null and b.x2 is not null group by 1)
select g.e as electrode, round(case when m2 > 0 and m3 > 0 then -ln(m3 / m2) else 0.0 end, 6) as sampen from (select distinct e from dn) g left join p using (e)""",
)
register("hmm_updown", lambda df: signal.hmm_updown(df, H))
register("partial_correlation", lambda df: signal.partial_correlations(df, H))
register("state_space_pca", lambda df: signal.pca_states(df, H))
register("persistence", signal.persistence)
register("betweenness", lambda df: signal.betweenness(_edges(df)))
register("communities", lambda df: signal.communities(_edges(df)))
register("path_metrics", lambda df: signal.path_metrics(_edges(df)))
register_raw("pca_waveforms", lambda spark, d: learning.pca_waveforms(_vectors(spark, d)))
register_raw("kmeans_waveforms", lambda spark, d: learning.kmeans_waveforms(_vectors(spark, d)))
register("state_clusters", lambda df: learning.state_clusters(df, DAY))
register("anomaly_windows", lambda df: learning.anomaly_windows(df, DAY))

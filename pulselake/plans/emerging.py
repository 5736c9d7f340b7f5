"""Queries on causal strength, synchrony states, rhythm grids and simulation."""

from __future__ import annotations

import math

from ..operators import emergence as op
from ..operators.evolution import lif_parameters
from .bursting import islands_sql
from .evolving import H
from .pairwise import TE, M, states_sql
from .registry import dense_sql, register, rounded, waves_sql
from .signals import KURAMOTO, PHASES

register(
    "effective_information", lambda df: op.effective_information(df, 10 * M),
    f""", {states_sql(10 * M)}, t as (select a.st as s, b.st as f, count(*) as n from stt a join stt b on b.b = a.b + 1 group by 1, 2), p as (select *, n / sum(n) over (partition by s) as p from t), k as (select count(distinct s) as k, count(distinct f) as m from t),
e as (select -sum(q * log2(q)) as h from (select sum(p) / (select k from k) as q from p group by f)), c as (select -sum(p * log2(p)) / (select k from k) as noise from p)
select k as causes, round(h - noise, 6) as ei, round(1 - noise / greatest(log2(m), 1e-12), 6) as determinism, round(1 - h / greatest(log2(m), 1e-12), 6) as degeneracy from e cross join c cross join k""",
)
register("recurrent_processing", lambda df: op.recurrent_processing(df, H), f"{TE} select round(sum(least(x.te, y.te)) / greatest(sum(x.te), 1e-12), 6) as recurrence from te x join te y on x.e1 = y.e2 and x.e2 = y.e1")
register(
    "burst_probability", lambda df: op.burst_probability(df, M, 2 * M, 5 * M, H),
    f"""{islands_sql('', M, 2 * M, 5 * M, 3)}, mw as (select count(*) as bursts, (max(start_us) - min(start_us)) / (count(*) - 1) as mean, max(start_us) as last from f having count(*) >= 2)
select bursts, round(mean / 1e6, 3) as mean_wait_s, round(least(0.95, (1 - exp(-{H} / mean)) * case when dur - last > mean then 1.5 else 1 end), 6) as probability from mw cross join d""",
)
PERIODS = [6.0, 12.0, 18.0, 24.0, 30.0, 36.0, 48.0]
register(
    "lomb_scargle", lambda df: op.lomb_scargle(df, H, PERIODS),
    f""", {dense_sql(H)}, pp as (select b, cast(sum(n) as double) as n from dn group by 1), y as (select b as t, n - (select avg(n) from pp) as z, (select var_pop(n) from pp) as v, cast(p as double) as period_h, {repr(2 * math.pi)} / p as w from pp cross join (select unnest({PERIODS}) as p)),
ta as (select period_h as ph, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / (2 * any_value(w)) as tau from y group by 1), q as (select period_h, z, v, cos(w * (t - tau)) as a, sin(w * (t - tau)) as b from y join ta on ph = period_h)
select period_h, round((pow(sum(z * a), 2) / sum(a * a) + pow(sum(z * b), 2) / sum(b * b)) / (2 * any_value(v)), 4) as power from q group by 1""",
)
register(
    "chimera", lambda df: rounded(op.chimera(df, H, 24)),
    f"""{PHASES}, bl as (select e // 8 as g, b, sqrt(pow(avg(c), 2) + pow(avg(s), 2)) as r from u group by 1, 2), wg as (select b // 24 as win, g, avg(r) as r from bl where b < (select (max(b) + 1) // 24 * 24 from dn) group by 1, 2)
select win, round(avg(r), 6) as mean_r, round(stddev_pop(r) / greatest(avg(r), 1e-12), 6) as cv, cast(stddev_pop(r) / greatest(avg(r), 1e-12) > 0.3 as bigint) as chimera from wg group by 1""",
)
register(
    "sync_dwell", lambda df: op.sync_dwell(df, H),
    f"""{KURAMOTO}, sy as (select b, cast(r >= 0.3 as integer) as sync from ku), ru as (select *, row_number() over (order by b) - row_number() over (partition by sync order by b) as run from sy)
select sync, min(b) as start_bin, count(*) as bins from ru group by sync, run""",
)
register("integration", lambda df: op.integration(df, H))
register("ising_couplings", lambda df: op.ising(df, 10 * M))
register("information_split", lambda df: op.information_split(df, 10 * M))
register(
    "phase_amplitude_coupling", lambda df: rounded(op.phase_amplitude_coupling(df, H)),
    f""", {dense_sql(H)}, po as (select 0 as e, b, cast(sum(n) as double) as n from dn group by b), {waves_sql('po', 'e', 0.01, 0.1, 'sl')}, {waves_sql('po', 'e', 0.2, 0.9, 'fa')},
am as (select cast(least(floor((atan2(sl.zi, sl.zr) + pi()) / (2 * pi()) * 18), 17) as integer) as part, avg(sqrt(fa.zr * fa.zr + fa.zi * fa.zi)) as a from sl join fa on sl.b = fa.b group by 1),
pr as (select a / (select sum(a) from am) as p from am) select round((ln(18) + sum(p * ln(p)) filter (p > 0)) / ln(18), 6) as modulation_index from pr""",
)
register("simulate_lif", lambda df: op.simulate_lif(lif_parameters(df)))

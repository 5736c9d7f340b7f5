"""Queries on burst shapes, trends, states, forgetting and surprise."""

from __future__ import annotations

from ..operators import dynamics as op
from .bursting import NETWORK, network_sql
from .evolving import DAY, EV, EVO, FC, H, WC
from .pairwise import M, TE, states_sql
from .registry import dense_sql, register

register(
    "burst_profiles", lambda df: op.burst_profiles(df, 20, **NETWORK),
    f"{network_sql()}, x as (select burst, least(((t - start_us) * 20) // (end_us - start_us), 19) as part, count(*) as n from nb_s group by 1, 2) select burst, part, n, round(n / sum(n) over (partition by burst), 6) as share from x",
)
register(
    "mea_bins", lambda df: op.mea_bins(df, H, 1.5),
    f""", nb as (select greatest(1, (dur + {H - 1}) // {H}) as bins from d), a as (select mea, t // {H} as b, count(distinct e) as k, count(*) as n from s group by 1, 2),
th as (select mea, sum(k) / any_value(bins) + 1.5 * sqrt(greatest(sum(k * k) / any_value(bins) - pow(sum(k) / any_value(bins), 2), 0)) as bar from a cross join nb group by 1)
select mea, count(*) as hot_bins, cast(sum(n) as bigint) as events, round(count(*) / (select bins from nb), 6) as share from a join th using (mea) where round(k - bar, 9) >= 0 group by 1""",
)
register(
    "trends", lambda df: op.trends(df, **EVO),
    f"""{EV}, lo as (select win, 'rate' as metric, rate as v from evo union all select win, 'complexity', complexity from evo union all select win, 'synchrony', synchrony from evo)
select metric, count(*) as windows, round(regr_slope(v, win) * 1000, 6) as slope_e3, round(pow(corr(v, win), 2), 6) as r2 from lo group by 1""",
)


def _scale(w: int) -> str:
    nb = f"(select greatest(1, (dur + {w - 1}) // {w}) from d)"
    pop = f"(select x.b, coalesce(c.n, 0) as n from (select unnest(range(0, {nb})) as b) x left join (select least(t // {w}, {nb} - 1) as b, count(*) as n from s group by 1) c on c.b = x.b)"
    up = f"(select *, cast(n > (select quantile_cont(n, 0.5) from {pop}) as integer) as up from {pop})"
    return f"select cast({w // 1_000_000} as integer) as width_s, round(avg(up), 6) as up_fraction, count(*) filter (up <> was) as changes, round(stddev_pop(n) / avg(n), 6) as cv from (select *, lag(up) over (order by b) as was from {up})"


SCALES = [10 * M, H, 6 * H, DAY]
register("multiscale_states", lambda df: op.multiscale_states(df, SCALES), " " + " union all ".join(_scale(w) for w in SCALES))
POP = f", {dense_sql(H)}, pp as (select b, cast(sum(n) as bigint) as n from dn group by 1)"
register(
    "bimodality", lambda df: op.bimodality(df, H),
    f"""{POP}, x as (select n - (select avg(n) from pp) as z from pp), m as (select avg(z * z) as m2, avg(z * z * z) as m3, avg(z * z * z * z) as m4 from x), k as (select m3 / pow(m2, 1.5) as sk, m4 / (m2 * m2) as ku from m)
select round(sk, 6) as skewness, round(ku, 6) as kurtosis, round((sk * sk + 1) / ku, 6) as bimodality from k""",
)
register(
    "repeated_events", lambda df: op.repeated_events(df, H),
    f"{POP}, h as (select b, n from pp where n > (select avg(n) + stddev_pop(n) from pp)) select cast(row_number() over (order by b) as integer) as event, b as bin, n, round(n / first(n) over (order by b), 6) as relative from h",
)
register(
    "information_flow", lambda df: op.information_flow(df, H),
    f"{TE}, o as (select e1 as e, sum(te) as o from te group by 1), i as (select e2 as e, sum(te) as i from te group by 1) select e as electrode, round(o, 6) as out, round(i, 6) as into, round(o - i, 6) as net from o join i using (e)".replace(" as out,", ' as "out",').replace(" as into,", ' as "into",'),
)
register(
    "forgetting", lambda df: op.forgetting(df, 4, H),
    f""", {dense_sql(H)}, nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), x as (select *, (b * 4) // (select k from nb) as w from dn), r as (select p.w, p.e as e1, q.e as e2, coalesce(abs(corr(p.n, q.n)), 0) as r from x p join x q on p.b = q.b and p.e < q.e group by 1, 2, 3)
select p.w as a, q.w as b, round(greatest(0, least(1, 1 - sum(p.r * q.r) / sqrt(sum(p.r * p.r) * sum(q.r * q.r)))), 6) as distance from r p join r q on p.e1 = q.e1 and p.e2 = q.e2 and p.w < q.w group by 1, 2""",
)
register(
    "state_landscape", lambda df: op.state_landscape(df, 10 * M),
    f""", {states_sql(10 * M)}, x as (select *, coalesce(lag(st) over (order by b) <> st, true) as enter from stt)
select st as state, count(*) as visits, round(-log2(count(*) / (select count(*) from stt)), 6) as energy, count(*) filter (enter) as entries, round(count(*) / count(*) filter (enter), 6) as mean_dwell from x group by 1 having count(*) >= 2""",
)
register(
    "snapshot", lambda df: op.snapshot(df, 10 * M),
    f""", x as (select *, t - lag(t) over (order by t, spike_id) as isi, lead(t, 3) over (order by t, spike_id) - t as ahead from s)
select count(*) as n, count(distinct e) as electrodes, round(count(*) / ((select dur from d) / 1e6), 6) as rate_hz, round(avg(isi) / 1e6, 6) as isi_mean_s, round(stddev_pop(isi) / avg(isi), 6) as isi_cv, round(avg(amp), 6) as amp_mean, round(stddev_pop(amp), 6) as amp_std,
count(*) filter (ahead < {10 * M}) as clusters from x""",
)
register(
    "surprise", lambda df: op.surprise(df, H),
    f"""{POP}, y as (select b, cast(n > (select quantile_cont(n, 0.25) from pp) as integer) + cast(n > (select quantile_cont(n, 0.5) from pp) as integer) + cast(n > (select quantile_cont(n, 0.75) from pp) as integer) as lv from pp),
t as (select x.lv as s, z.lv as f, count(*) as n from y x join y z on z.b = x.b + 1 group by 1, 2), p as (select *, n / sum(n) over (partition by s) as p from t) select s, f, n, round(p, 6) as p, round(-log2(p), 6) as surprise from p""",
)
register(
    "representational_similarity", lambda df: op.representational_similarity(df, **FC),
    f"{WC}, r as (select win, e1, e2, coalesce(r, 0) as r from wc) select a.win, round(corr(a.r, b.r), 6) as similarity from r a join r b on b.win = a.win + 1 and a.e1 = b.e1 and a.e2 = b.e2 group by 1",
)
register("bursts_poisson_surprise", op.bursts_poisson_surprise)
register("bursts_rank_surprise", op.bursts_rank_surprise)
register(
    "dense_buckets", lambda df: op.estimated_stimuli(df, 10 * M, 4, 0),
    f"select t // {10 * M} * {10 * M} as t_us, count(*) as n from s group by 1 having count(*) >= 4",
)
register(
    "estimated_stimuli", lambda df: op.estimated_stimuli(df, 10 * M, 5, 6 * H),
    f""", hot as (select t // {10 * M} * {10 * M} as t_us, count(*) as n from s group by 1 having count(*) >= 5),
kp as (with recursive r(t) as (select min(t_us) from hot union all select (select min(h.t_us) from hot h where h.t_us >= r.t + {6 * H}) from r where r.t is not null) select t from r where t is not null)
select t_us, n from hot where t_us in (select t from kp)""",
)
register("betti_curve", lambda df: op.betti_curve(df, 20, 20))

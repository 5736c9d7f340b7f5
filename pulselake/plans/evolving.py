"""Queries on sliding windows, artifacts, sequences, rhythms and the channel graph."""

from __future__ import annotations

import math

from ..operators import evolution as op
from ..operators import graph
from .pairwise import corr_sql
from .registry import dense_sql, register

M = 60_000_000
H = 60 * M
DAY = 24 * H
EVO = dict(length=DAY, step=DAY // 2, burst_isi=M, sync=M // 2)

EV = f""", lastw as (select (dur - {DAY}) // {DAY // 2} as k from d), ix as (select *, lag(t) over (order by t, spike_id) as pv from s),
nr as (select a.spike_id, min(case when b.t <= a.t then a.t - b.t end) as bf, min(case when b.t >= a.t then b.t - a.t end) as af from s a join s b on a.e <> b.e and abs(b.t - a.t) < {M // 2} and b.t between a.t - {M} and a.t + {M} group by 1),
wd as (select w * {DAY // 2} as ws, w from (select unnest(range(0, (select k + 1 from lastw))) as w)),
iw as (select w, ws, t, ix.spike_id, case when pv >= ws then t - pv end as own, coalesce(t - bf >= ws, false) or coalesce(t + af <= ws + {DAY}, false) as sy from ix join wd on t between ws and ws + {DAY} left join nr using (spike_id)),
io as (select *, coalesce(own < {M} and lag(own) over (partition by w order by t, spike_id) >= {M}, false) as onset from iw),
evo as (select w as win, count(*) as n, round(count(*) / 86400.0, 6) as rate, round(count(*) filter (onset) / 86400.0, 9) as burst_rate, round(coalesce(stddev_pop(own) / avg(own), 0), 6) as complexity, round(avg(cast(sy as integer)), 6) as synchrony from io group by 1)"""
register("evolution_windows", lambda df: op.evolution_windows(df, **EVO), f"{EV} select * from evo")
register(
    "critical_moments", lambda df: op.critical_moments(df, bar=1.5, k=50, **EVO),
    f"""{EV}, fu as (select w as win, coalesce(rate, 0) as rate, coalesce(burst_rate, 0) as burst_rate, coalesce(complexity, 0) as complexity, coalesce(synchrony, 0) as synchrony from wd left join evo on evo.win = wd.w),
lo as (select win, 'rate' as metric, rate as value from fu union all select win, 'burst_rate', burst_rate from fu union all select win, 'complexity', complexity from fu union all select win, 'synchrony', synchrony from fu),
z as (select *, sum(value) over v / 5 as mean, greatest(stddev_pop(value) over v, 1e-10) as sd from lo window v as (partition by metric order by win rows between 2 preceding and 2 following)),
y as (select win, metric, value, mean, round((value - mean) / sd, 4) as z from z)
select win, metric, round(value, 6) as value, round(mean, 6) as mean, z from y where abs(z) > 1.5 order by abs(z) desc, metric, win limit 50""",
)
register(
    "window_features", lambda df: op.window_features(df, DAY),
    f""", x as (select *, t // {DAY} as win, t - lag(t) over (partition by e, t // {DAY} order by t, spike_id) as isi from s where t // {DAY} < (select dur // {DAY} from d))
select win, e as electrode, round(count(*) / 86400.0, 6) as rate, round(avg(amp), 6) as amp_mean, round(stddev_pop(amp), 6) as amp_std, round(coalesce(stddev_pop(isi) / avg(isi), 0), 6) as cv_isi from x group by 1, 2""",
)
WC = f""", {dense_sql(H)}, lastw as (select (dur - {DAY * 5}) // {DAY} as k from d), wb as (select w, e, b, n from dn join (select unnest(range(0, (select k + 1 from lastw))) as w) on b >= w * 24 and b < w * 24 + 120),
wc as (select x.w as win, x.e as e1, y.e as e2, corr(x.n, y.n) as r from wb x join wb y on x.w = y.w and x.b = y.b and x.e < y.e group by 1, 2, 3)"""
FC = dict(length=5 * DAY, step=DAY, width=H)
register("dynamic_fc", lambda df: op.dynamic_fc(df, **FC), f"{WC} select win, e1, e2, round(r, 6) as r from wc")
register(
    "stable_edges", lambda df: op.stable_edges(df, 0.03, **FC),
    f"{WC}, g as (select e1, e2, avg(r) as m, stddev_pop(r) as sd from wc group by 1, 2) select e1, e2, round(m, 6) as mean_r, round(sd, 6) as sd_r, cast(round(m, 9) >= 0.03 and sd <= (select quantile_cont(sd, 0.25) from g) as integer) as stable from g",
)
PW = f"""{WC}, od as (select win, avg(abs(r)) as o from wc group by 1), ne as (select count(distinct e) as k from s), cn as (select w as win, e, sum(n) as n from wb group by 1, 2),
pw as (select cn.win, cast(sum(n) as bigint) as n, round(any_value(o), 6) as order_parameter, round(sum(n * n) / any_value(k) - pow(sum(n) / any_value(k), 2), 6) as susceptibility, round(sum(n) / {5 * 86400}, 6) as population_rate from cn join od using (win) cross join ne group by 1)"""
register("phase_windows", lambda df: op.phase_windows(df, **FC), f"{PW} select * from pw")
register("change_points", lambda df: op.change_points(df, k=1.5, **FC), f"{PW}, j as (select win, abs(order_parameter - lag(order_parameter) over (order by win)) as jump from pw) select win, round(jump, 6) as jump from j where jump > (select avg(jump) + 1.5 * stddev_pop(jump) from j)")
register(
    "retention_windows", lambda df: op.retention_windows(df, 10),
    """, c as (select (t * 10) // (select dur + 1 from d) as win, e, count(*) as n from s group by 1, 2), nm as (select win, sqrt(sum(n * n)) as norm from c group by 1), f as (select e, n as n0 from c where win = 0)
select c.win, round(sum(n * n0) / any_value(norm) / (select norm from nm where win = 0), 6) as similarity from c join f using (e) join nm on nm.win = c.win group by 1""",
)
AF = f""", sl as (select t // {M} as slot, count(distinct e) as n_e, count(distinct mea) as n_g from s group by 1), fl as (select s.*, n_e, n_g, cast(n_g - 1 >= 1 or n_e >= greatest(2, ceil(0.5 * (select count(distinct e) from s))) as integer) as flag from s join sl on s.t // {M} = sl.slot)"""
register("artifact_flags", lambda df: op.artifact_flags(df, M).select("spike_id", "n_e", "n_g", "flag"), f"{AF} select spike_id, n_e, n_g, flag from fl")
register(
    "artifact_by_group", lambda df: op.artifact_by_group(df, M),
    f"{AF} select mea, count(*) as n, cast(sum(flag) as bigint) as flagged, round(avg(flag), 6) as fraction, round(quantile_cont(amp, 0.5) filter (flag = 1), 6) as amp_flagged, round(quantile_cont(amp, 0.5) filter (flag = 0), 6) as amp_clean from fl group by 1",
)
register("artifact_clean", lambda df: op.artifact_clean(df, M), f"{AF} select spike_id, t as t_us, e as electrode from fl where flag = 0")
register(
    "sequence_motifs", lambda df: op.sequence_motifs(df, 30 * M),
    f""", o as (select *, row_number() over (order by t, spike_id) as rn from s), w as (select a.rn, a.t as t0, b.rn as rb, b.e from o a join o b on b.rn between a.rn and a.rn + 4 and b.t - a.t <= {30 * M}),
f as (select rn, t0, e, min(rb) as pos from w group by 1, 2, 3), q as (select rn, t0, list(e order by pos) as seq from f group by 1, 2 having count(*) >= 3),
z as (select t0, array_to_string(seq[1:k.ln], '-') as key from q cross join (select unnest([3, 4, 5]) as ln) k where k.ln <= len(seq))
select key, count(*) as n, round((max(t0) - min(t0)) / (count(*) - 1) / 1e6, 3) as mean_interval_s from z group by 1 having count(*) >= 3""",
)
POP = f", {dense_sql(H)}, pp as (select b, cast(sum(n) as double) as n from dn group by 1)"
W24 = repr(2 * math.pi / 24)
register(
    "cosinor_24h", lambda df: op.cosinor(df, H, 24.0),
    f"""{POP}, x as (select n / 3600 as y, cos(b * {W24}) as c, sin(b * {W24}) as s from pp), a as (select covar_pop(c, c) as cc, covar_pop(s, s) as ss, covar_pop(c, s) as cs, covar_pop(c, y) as cy, covar_pop(s, y) as sy, covar_pop(y, y) as yy, avg(y) as my, avg(c) as mc, avg(s) as ms from x),
b as (select *, (cy * ss - sy * cs) / (cc * ss - cs * cs) as b, (sy * cc - cy * cs) / (cc * ss - cs * cs) as g from a), p as (select *, atan2(g, b) / {W24} as ph from b)
select round(my - b * mc - g * ms, 6) as mesor, round(sqrt(b * b + g * g), 6) as amplitude, round(case when ph < 0 then ph + 24 else ph end, 6) as acrophase_h, round((b * cy + g * sy) / yy, 6) as r_squared from p""",
)
register(
    "autocorr_hourly", lambda df: op.autocorrelation(df, H, 48),
    f"""{POP}, x as (select b, n - (select avg(n) from pp) as d from pp) select cast(lag as integer) as lag, round(sum(x.d * y.d) / (select sum(d * d) from x), 6) as r from x cross join (select unnest(range(0, 49)) as lag) join x y on y.b = x.b + lag group by 1""",
)
register(
    "chi2_periodogram", lambda df: op.chi2_periodogram(df, H, (18, 30)),
    f"""{POP}, y as (select cast(p as integer) as p, b % p as ph, n from pp cross join (select unnest(range(18, 31)) as p) where b < ((select count(*) from pp) // p) * p), f as (select p, ph, avg(n) as m from y group by 1, 2), v as (select p, var_pop(m) as v from f group by 1)
select y.p, round(any_value(v) * count(*) / var_pop(n), 4) as qp from y join v using (p) group by 1""",
)
register(
    "lif_parameters", op.lif_parameters,
    """, i as (select *, (t - lag(t) over (partition by e order by t, spike_id)) / 1e3 as isi from s)
select e as electrode, round(avg(isi) filter (isi > 0) * 0.3 * (1 + stddev_pop(isi) filter (isi > 0) / avg(isi) filter (isi > 0)), 2) as tau_m, round(greatest(1.0, min(isi) filter (isi > 0) * 0.8), 2) as tau_ref,
round(-40 - avg(abs(amp)) * 0.05, 4) as v_threshold, round(0.5 + count(*) / ((select dur from d) / 1e6) * 0.05, 6) as i_background from i group by 1 having count(*) >= 10""",
)
THR = 0.04
ED = f"{corr_sql(0)}, ed as (select e1, e2, r from cr where e1 < e2 and abs(r) >= {THR}), bo as (select e1 as u, e2 as v, abs(r) as w from ed union all select e2, e1, abs(r) from ed), dg as (select u, count(*) as k, sum(w) as st from bo group by 1)"


def _edges(df):
    from ..operators.pairs import correlations

    return correlations(df, H, 0).where((graph.F.col("e1") < graph.F.col("e2")) & (graph.F.abs("r") >= THR)).select("e1", "e2", "r")


register("node_degree", lambda df: graph.node_degree(_edges(df)), f"{ED} select u as electrode, k as degree, round(st, 6) as strength from dg")
register(
    "mea_density", lambda df: graph.mea_density(_edges(df), df),
    f"""{ED}, mm as (select mea, count(distinct e) as k from s group by 1), p as (select sum(k * (k - 1) // 2) as pw, sum(k) * (sum(k) - 1) // 2 as al from mm)
select count(*) filter (e1 // 8 = e2 // 8) as within, count(*) filter (e1 // 8 <> e2 // 8) as across, round(count(*) filter (e1 // 8 = e2 // 8) / (select pw from p), 6) as density_within, round(count(*) filter (e1 // 8 <> e2 // 8) / (select al - pw from p), 6) as density_across from ed""",
)
register(
    "triad_census", lambda df: graph.triad_census(_edges(df), df),
    f"""{ED}, n as (select distinct e from s), t as (select a.e as i, b.e as j, c.e as k, (a.e, b.e) in (select (e1, e2) from ed) as ij, (b.e, c.e) in (select (e1, e2) from ed) as jk, (a.e, c.e) in (select (e1, e2) from ed) as ik from n a join n b on a.e < b.e join n c on b.e < c.e),
q as (select *, cast(ij as integer) + cast(jk as integer) + cast(ik as integer) as c from t)
select count(*) filter (c = 3) as triangle, count(*) filter (c = 2 and jk) as chain, count(*) filter (c = 2 and not jk) as star, count(*) filter (c = 1) as single_edge,
round((select count(*) from ed) * 2 / ((select count(*) from n) * ((select count(*) from n) - 1)), 6) as density from q""",
)
register(
    "rich_club", lambda df: graph.rich_club(_edges(df)),
    f"""{ED}, k as (select distinct k from dg), n as (select k.k, count(*) as nodes from k join dg on dg.k >= k.k group by 1 having count(*) >= 2),
mm as (select k.k, count(*) as m from k join (select least(a.k, b.k) as lo from ed join dg a on a.u = e1 join dg b on b.u = e2) on lo >= k.k group by 1) select n.k, nodes, round(coalesce(m, 0) * 2 / (nodes * (nodes - 1)), 6) as phi from n left join mm using (k)""",
)
register(
    "clustering", lambda df: graph.clustering(_edges(df)),
    f"""{ED} select x.u as electrode, round(avg(case when (x.v, y.v) in (select (e1, e2) from ed) then 1 else 0 end), 6) as clustering from bo x join bo y on x.u = y.u and x.v < y.v group by 1""",
)

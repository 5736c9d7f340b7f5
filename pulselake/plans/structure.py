"""Queries on adaptive grids, samples, network structure, power-law tests, burst evolution and adaptation."""

from __future__ import annotations

from ..operators import structure as op
from .bursting import AV, NETWORK, H, M, UD, islands_sql, network_sql
from .evolving import DAY, ED, THR, _edges
from .registry import register

register(
    "adaptive_grid", op.adaptive_grid,
    """, m as (select (max(t) - min(t)) / (count(*) - 1) as m from s group by e having count(*) > 1 and max(t) > min(t))
select round(dur / 1e6, 6) as duration_s, round(greatest(0.001, dur / 1e6 / 100000), 6) as bin_s, case when dur <= 3600e6 then 1.0 when dur <= 43200e6 then 60.0 else 300.0 end::double as window_s,
round(greatest(0.5, least(50.0, (select exp(avg(ln(m))) from m) / 1e3)), 6) as avalanche_ms from d""",
)
register(
    "stratified_counts", lambda df: op.stratified_counts(df, 0.1),
    f"select e as electrode, count(*) as n, count(*) filter (('0x' || substr(md5(cast(spike_id as varchar)), 1, 8))::bigint < {int(0.1 * (1 << 32))}) as kept from s group by 1",
)
register(
    "sample_windows", lambda df: op.sample_windows(df, 10, 2 * H),
    f"""select cast(win as integer) as win, round(case when dur <= {30 * H} then 0 else win * ((dur - {2 * H}) / 9) end / 1e6, 6) as start_s, round(case when dur <= {30 * H} then dur else win * ((dur - {2 * H}) / 9) + {2 * H} end / 1e6, 6) as end_s
from d cross join (select unnest(range(0, 10)) as win) where dur > {30 * H} or win = 0""",
)
register(
    "variable_electrodes", lambda df: op.variable_electrodes(df, H, 8),
    f""", nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), p as (select e, count(distinct least(t // {H}, (select k from nb) - 1)) / (select k from nb) as p from s group by 1)
select e as electrode, round(p * (1 - p), 6) as variance from p order by variance desc, e limit 8""",
)
register(
    "assortativity", lambda df: op.assortativity(_edges(df)),
    f"""{ED}, ends as (select a.k as a, b.k as b from ed join dg a on a.u = e1 join dg b on b.u = e2), mid as (select (avg(a) + avg(b)) / 2 as md from ends),
va as (select count(*) as edges, sqrt(avg(pow(a - md, 2)) * avg(pow(b - md, 2))) as sd, avg((a - md) * (b - md)) as c from ends cross join mid) select edges, round(case when edges >= 2 and sd > 1e-12 then c / sd else 0 end, 6) as assortativity from va""",
)
register(
    "participation", lambda df: op.participation(_edges(df)),
    f"{ED}, g as (select u, v // 8 as g, sum(w) as w from bo group by 1, 2) select u as electrode, round(1 - sum(w * w) / pow(sum(w), 2), 6) as participation from g group by 1",
)
register(
    "betti_numbers", lambda df: op.betti_numbers(_edges(df), df, THR),
    f"""{ED}, nd as (select distinct e from s),
rc as (with recursive r(a, b) as (select e, e from nd union select r.a, bo.v from r join bo on bo.u = r.b) select a, min(b) as l from r group by 1),
c as (select count(distinct l) as parts from rc), k4 as (select 1 - x.w as d1, 1 - y.w as d2, 1 - z.w as d3, 1 - p.w as d4, 1 - q.w as d5, 1 - r.w as d6
from bo x join bo y on y.u = x.u and y.v > x.v join bo z on z.u = x.u and z.v > y.v join bo p on p.u = x.v and p.v = y.v join bo q on q.u = x.v and q.v = z.v join bo r on r.u = y.v and r.v = z.v where x.v > x.u)
select parts as beta0, greatest(0, (select count(*) from ed) - (select count(*) from nd) + parts) as beta1, (select count(*) from k4 where list_stddev_pop([d1, d2, d3, d4, d5, d6]) > 0.3 * {1 - THR!r}) as beta2, (select count(*) from ed) as edges from c""",
)
PL = f"""{AV}, z as (select size, count(*) as n from av group by 1), tl as (select a.size as xmin, b.size, b.n from z a join z b on b.size >= a.size),
ft as (select xmin, sum(n) as k, 1 + sum(n) / sum(n * ln(size / (xmin - 0.5))) as alpha from tl group by 1 having sum(n) >= 30),
w as (select tl.xmin, alpha, sum(n) over (partition by tl.xmin order by size) as u, n, k, 1 - pow(size / tl.xmin, 1 - alpha) as cdf from tl join ft on ft.xmin = tl.xmin),
ks as (select xmin, alpha, max(greatest(abs(u / k - cdf), abs((u - n + 1) / k - cdf))) as ks from w group by 1, 2),
fit as (select xmin, round(alpha, 6) as alpha from ks order by round(ks, 9), xmin limit 1)"""
register(
    "powerlaw_tests", lambda df: op.powerlaw_tests(df, 10 * M),
    f"""{PL}, x as (select size, ln(size) as l, size - xmin + 0.5 as s, xmin, alpha from av cross join fit where size >= xmin), m as (select count(*) as k, 1 / avg(s) as lam, avg(l) as mu, stddev_samp(l) as sd from x),
y as (select -alpha * l + ln(alpha - 1) + (alpha - 1) * ln(xmin - 0.5) as pw, ln(lam) - lam * s as ex, -l - ln(sd) - 0.5 * ln(2 * pi()) - 0.5 * pow((l - mu) / sd, 2) as lg from x cross join m where k >= 10 and sd > 1e-12)
select 'exponential' as alternative, count(*) as tail, round(sum(pw - ex), 4) as ratio, round(sum(pw - ex) / (stddev_pop(pw - ex) * sqrt(count(*))), 4) as z from y
union all select 'lognormal', count(*), round(sum(pw - lg), 4), round(sum(pw - lg) / (stddev_samp(pw - lg) * sqrt(count(*))), 4) from y""",
)
register(
    "criticality_deviation", lambda df: op.criticality_deviation(df, 10 * M),
    f"""{AV}, x as (select duration, avg(size) as m, pow(duration, 2.0) as p from av group by 1 having count(*) >= 2), k as (select count(*) as durations, avg(p * (select sum(m) / sum(p) from x) / m) as kappa from x)
select durations, round(kappa, 4) as kappa, case when kappa between 0.9 and 1.1 then 'critical' when kappa < 0.9 then 'subcritical' else 'supercritical' end as verdict from k where durations >= 3""",
)
register(
    "criticality_windows", lambda df: op.criticality_windows(df, 10 * M, 144),
    f"{AV} select start_bin // 144 as win, count(*) as n, round(avg(size), 6) as mean_size, round(avg(duration), 6) as mean_duration, max(size) as largest from av group by 1",
)
register(
    "burst_evolution", lambda df: op.burst_evolution(df, DAY, **NETWORK),
    f"""{network_sql()}, b as (select start_us, end_us, count(distinct e) as k from nb_s group by 1, 2), g as (select start_us // {DAY} as win, count(*) as n, avg((end_us - start_us) / 1e6) as du, avg(k) as e from b group by 1)
select w.win, coalesce(n, 0) as n_bursts, round(du, 6) as mean_duration_s, round(e, 6) as mean_electrodes from (select unnest(range(0, (select dur // {DAY} + 1 from d))) as win) w left join g using (win)""",
)
register(
    "block_bursts", lambda df: op.block_bursts(df, 20 * M, 40 * M, 5 * M, 3),
    f"""{islands_sql('mea', 20 * M, 40 * M, 5 * M, 3)}, b as (select mea, count(*) as k, avg((end_us - start_us) / 1e6) as du from f group by 1), x as (select g.mea, coalesce(k, 0) as k, du from (select distinct mea from s) g left join b using (mea))
select mea, k as n_bursts, round(k / (select dur / 6e7 from d), 6) as per_minute, round(du, 6) as mean_duration_s, round(k - (select avg(k) from x), 6) as above_mean from x""",
)
LV = f"{UD}, q as (select quantile_cont(n, 0.33) as a, quantile_cont(n, 0.66) as z from p), lv as (select b, n, cast(n >= a as integer) + cast(n >= z as integer) as level from p cross join q)"
register(
    "mismatch_response", lambda df: op.mismatch_response(df, H),
    f"""{LV}, r as (select *, row_number() over (order by b) - row_number() over (partition by level order by b) as run from lv),
g as (select min(b) as start_bin, max(b) as last, level, count(*) as reps, regr_slope(n, b) as sl, arg_max(n, b) as en from r group by level, run having count(*) >= 3)
select start_bin, level, reps, round(sl, 6) as slope, round(case when en > 0 then lv.n / en end, 6) as boost from (select start_bin, last, level, reps, sl, en from g) left join (select b, n from lv) lv on lv.b = last + 1""",
)
register(
    "bayesian_surprise", lambda df: op.bayesian_surprise(df, H, 24),
    f"""{LV}, c as (select b // 24 as win, level, count(*) as n from lv group by 1, 2), bo as (select coalesce(x.win, y.win + 1) as win, coalesce(x.n, 0) as a, coalesce(y.n, 0) as b from c x full join c y on y.win + 1 = x.win and y.level = x.level),
t as (select win, sum(a) as ta, sum(b) as tb, count(*) as k from bo group by 1 having sum(a) > 0 and sum(b) > 0 and count(*) >= 2)
select win, round(greatest(sum((a + 1) / (ta + k) * ln((a + 1) / (ta + k) / ((b + 1) / (tb + k)))), 0), 6) as surprise, cast(any_value(k) as integer) as levels from bo join t using (win) group by 1""",
)

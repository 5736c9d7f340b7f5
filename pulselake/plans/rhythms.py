"""Queries on slow waves, local rates and lagged linear models."""

from __future__ import annotations

from ..operators import linear, metastable, waves
from .bursting import H, M
from .nulls import ALPHA
from .registry import dense_sql, register, rounded
from .signals import PHASES

BIN, LOW, HIGH, TAPS = 10 * M, 0.05, 0.4, 12
SLOW = dict(width=BIN, low=LOW, high=HIGH, taps=TAPS, least=2, most=12)
BANDS = {"slow": (1, 6), "delta": (7, 20), "theta": (21, 32)}
HALF_WAVES = f""", nb as (select greatest(1, (dur + {BIN - 1}) // {BIN}) as k from d), c as (select least(t // {BIN}, (select k from nb) - 1) as b, count(*) as n from s group by 1),
ker as (select unnest({waves.band_kernel(LOW, HIGH, TAPS)}::double[]) as h, unnest(range({-TAPS}, {TAPS + 1})) as step), fy as (select b + step as b, sum(n * h) as y from c cross join ker group by 1),
y as (select g.b, round(coalesce(fy.y, 0), 9) as y from (select unnest(range(0, (select k from nb))) as b) g left join fy using (b)),
w as (select *, sum(turn) over (order by b rows unbounded preceding) as wave from (select *, cast(y > 0 as integer) as up, case when lag(y > 0) over (order by b) = (y > 0) then 0 else 1 end as turn from y)),
hw as (select min(b) as start_bin, max(up) as positive, count(*) as bins, arg_max(y, (abs(y), -b)) as peak, arg_max(b, (abs(y), -b)) as pb from w group by wave having count(*) between 2 and 12)"""

register("half_waves", lambda df: waves.half_waves(df, **SLOW), f"{HALF_WAVES} select start_bin, positive, bins, round(peak, 6) as peak, round(peak / (pb - start_bin + 1), 6) as slope from hw")
register(
    "slow_waves", lambda df: waves.slow_waves(df, **SLOW),
    f"{HALF_WAVES} select positive, count(*) as waves, round(count(*) / ((select k from nb) * {BIN / 3.6e9}), 6) as per_hour, round(avg(bins), 6) as mean_bins, round(avg(round(peak, 6)), 6) as mean_peak, round(max(abs(round(peak, 6))), 6) as largest from hw group by 1",
)
register(
    "slow_oscillation", lambda df: waves.slow_oscillation(df, BIN, 64, BANDS),
    f""", {dense_sql(BIN)}, po as (select b, sum(n)::double as n from dn group by b), sg as (select b // 32 - k as seg, b - (b // 32 - k) * 32 as j, n from po cross join (select unnest([0, 1]) as k)),
sv as (select * from sg where seg >= 0 and seg * 32 + 64 <= (select max(b) + 1 from po)), ft as (select seg, regr_slope(n, j) as b, regr_intercept(n, j) as a from sv group by 1),
v as (select seg, j, (n - a - b * j) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) as v from sv join ft using (seg)),
fs as (select seg, f, sum(v * cos(2 * pi() * f * j / 64)) as re, sum(v * sin(2 * pi() * f * j / 64)) as im from v cross join (select unnest(range(0, 33)) as f) group by 1, 2),
pw as (select f, avg(re * re + im * im) * case when f in (0, 32) then 1 else 2 end as power from fs group by f), tt as (select sum(power) as total, avg(power) as mean from pw),
bd as (select 'slow' as band, 1 as lo, 6 as hi union all select 'delta', 7, 20 union all select 'theta', 21, 32),
g as (select band, sum(power) as power, arg_max(f, (round(power, 6), -f)) as pf, max(round(power, 6)) as top from pw join bd on f between lo and hi group by 1)
select band, round(power / total, 6) as share, cast(pf as integer) as peak_step, round(pf / (64 * {BIN / 1e6}) * 1e3, 6) as peak_mhz, cast(round(power / total, 9) > 0.2 and top > 2 * mean as integer) as detected from g cross join tt where total > 1e-12""",
)
LOCAL = f""", r as (select *, count(*) over (partition by e order by t range between {H // 2} preceding and {H // 2} following) as n, min(t) over (partition by e) as a, max(t) over (partition by e) as z from s),
lr as (select spike_id, e, t, a, z, n, round(n / (greatest(least(t + {H // 2}, z) - greatest(t - {H // 2}, a), 1) / 1e6), 6) as rate_hz from r)"""
register("local_rates", lambda df: waves.local_rates(df, H), f"{LOCAL} select spike_id, e as electrode, n, rate_hz from lr")
register(
    "local_rate_summary", lambda df: waves.local_rate_summary(df, H),
    f"""{LOCAL}, m as (select e, case when max(t) > min(t) then count(*) / ((max(t) - min(t)) / 1e6) end as mean from s group by 1)
select e as electrode, round(avg(rate_hz), 6) as mean_local_hz, round(max(rate_hz), 6) as max_local_hz, round(avg(coalesce(cast(rate_hz > 3 * mean as integer), 0)), 6) as busy_share from lr join m using (e) group by 1""",
)
register("order_selection", lambda df: rounded(linear.order_selection(df, H, 6)))
register("granger_significance", lambda df: linear.granger_significance(df, H, 6, ALPHA))
COAL = f"""{PHASES}, nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), pm as (select b, avg(c) as pc, avg(s) as ps from u group by 1),
ce as (select b // 24 as win, e, round(avg((c * pc + s * ps) / greatest(sqrt(pc * pc + ps * ps), 1e-12)), 9) >= 0.3 as member from u join pm using (b) where b // 24 < (select greatest(k // 24, 1) from nb) group by 1, 2),
cc as (select win, coalesce(sum(case when member then 1::bigint << e end), 0)::bigint as code, count(*) filter (member) as members from ce group by 1), co as (select code, members, count(*) as windows from cc group by 1, 2)"""
register("coalitions", lambda df: metastable.coalitions(df, H, 24, 0.3), f"{COAL} select * from co")
register(
    "coalition_entropy", lambda df: metastable.coalition_entropy(df, H, 24, 0.3),
    f"{COAL} select round(log2(sum(windows)) - sum(windows * log2(windows)) / sum(windows), 6) as entropy, count(*) as coalitions, cast(sum(windows) as bigint) as windows, round(sum(members * windows) / sum(windows), 6) as mean_members from co",
)
NET = f""", nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), mc as (select g.mea, x.b, coalesce(c.n, 0) as n from (select distinct mea from s) g cross join (select unnest(range(0, (select k from nb))) as b) x
left join (select mea, least(t // {H}, (select k from nb) - 1) as b, count(*) as n from s group by 1, 2) c on c.mea = g.mea and c.b = x.b), md as (select mea, quantile_cont(n, 0.5) as q from mc group by 1),
ns as (select b, sum(case when n > q then 1 << mea else 0 end)::integer as state from mc join md using (mea) group by 1), tr as (select a.state as s, z.state as f, count(*) as n from ns a join ns z on z.b = a.b + 1 group by 1, 2)"""
register("metastable_transitions", lambda df: metastable.metastable_transitions(df, H), f"{NET} select s, f, n, round(n / sum(n) over (partition by s), 6) as p from tr")
register(
    "metastable_dwell", lambda df: metastable.metastable_dwell(df, H),
    f"{NET}, en as (select *, coalesce(lag(state) over (order by b) <> state, true) as entered from ns) select state, count(*) as visits, count(*) filter (entered) as runs, round(count(*) / count(*) filter (entered), 6) as mean_dwell from en group by 1",
)
register(
    "metastable_summary", lambda df: metastable.metastable_summary(df, H),
    f"""{NET}, j as (select log2(sum(n)) - sum(n * log2(n)) / sum(n) as j, sum(n) filter (s <> f) as changes from tr), h as (select log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, count(*) as states from (select s, sum(n)::double as n from tr group by 1))
select states, coalesce(changes, 0)::bigint as changes, round(h, 6) as entropy, round(j - h, 6) as entropy_rate, round(2 * h - j, 6) as memory from j cross join h""",
)

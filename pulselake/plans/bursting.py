"""Queries on bursts, avalanches and states."""

from __future__ import annotations

from ..operators import bursts as op
from .registry import register

H = 3_600_000_000
M = 60_000_000

#: Pooled and per-channel parameters: intervals of the core and the rim, merge gap, events.
POOLED = dict(begin=M, end=2 * M, gap=5 * M, min_spikes=3, bucket=H)
CHANNEL = dict(begin=60 * M, end=120 * M, gap=10 * M, min_spikes=3, bucket=24 * H)
NETWORK = dict(width=H, min_electrodes=3, per_electrode=1, factor=1.5, gap=H)


def islands_sql(part: str, begin: int, end: int, gap: int, least: int) -> str:
    """CTE f: merged bursts (e, start_us, end_us); part is empty for pooled events."""
    by, key = (f"partition by {part}", f"{part}, ") if part else ("", "")
    return f""", i as (select *, t - lag(t) over ({by} order by t, spike_id) as isi from s),
r as (select *, sum(case when isi < {end} then 0 else 1 end) over ({by} order by t, spike_id rows unbounded preceding) as island, sum(case when isi < {begin} then 0 else 1 end) over ({by} order by t, spike_id rows unbounded preceding) as core from i),
k as (select distinct {key}island from (select {key}island, core from r group by all having count(*) >= {least})),
o as (select {key}island, min(t) as a, max(t) as b from r group by all),
h as (select o.* from o join k using ({key}island)),
m as (select *, sum(nw) over ({by} order by a rows unbounded preceding) as g from (select *, case when a - lag(b) over ({by} order by a) < {gap} then 0 else 1 end as nw from h)),
f as (select {key}min(a) as start_us, max(b) as end_us from m group by {key}g)"""


def network_sql() -> str:
    return f""", ac as (select t // {H} as b, count(distinct e) as k from s group by 1), nb as (select greatest(1, (dur + {H - 1}) // {H}) + 1 as bins from d),
th as (select greatest(sum(k) / any_value(bins) + 1.5 * sqrt(greatest(sum(k * k) / any_value(bins) - pow(sum(k) / any_value(bins), 2), 0)), 3) as bar from ac cross join nb),
hot as (select *, b - row_number() over (order by b) as run from ac where k >= (select bar from th)), ru as (select min(b) as a, max(b) + 1 as z from hot group by run),
mg as (select *, sum(nw) over (order by a rows unbounded preceding) as burst from (select *, case when (a - lag(z) over (order by a)) * {H} < {H} then 0 else 1 end as nw from ru)),
sp as (select cast(burst as bigint) as burst, min(a) * {H} as start_us, max(z) * {H} as end_us from mg group by 1),
nb_s as (select s.*, sp.* from s join sp on t >= start_us and t < end_us)"""


AV = f""", nb as (select greatest(1, (dur + {M * 10 - 1}) // {M * 10}) as k from d), c as (select least(t // {M * 10}, (select k from nb) - 1) as b, count(*) as n from s group by 1),
av as (select min(b) as start_bin, cast(sum(n) as bigint) as size, count(*) as duration from (select *, b - row_number() over (order by b) as run from c) group by run)"""
UD = f""", nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), p as (select x.b, coalesce(c.n, 0) as n from (select unnest(range(0, (select k from nb))) as b) x
left join (select least(t // {H}, (select k from nb) - 1) as b, count(*) as n from s group by 1) c on c.b = x.b), u as (select *, n > (select quantile_cont(n, 0.5) from p) as up from p)"""

register(
    "bursts_max_interval", lambda df: op.burst_table(df, **POOLED),
    f"""{islands_sql('', M, 2 * M, 5 * M, 3)}, x as (select f.*, case when i.t > f.start_us then i.isi end as isi from i join f on i.t between f.start_us and f.end_us)
select start_us, end_us, count(*) as n, round((end_us - start_us) / 1e6, 6) as duration_s, round(avg(isi) / 1e6, 3) as mean_isi_s, round(min(isi) / 1e6, 6) as peak_isi_s from x group by 1, 2 having count(*) >= 3""",
)
register(
    "bursts_per_electrode", lambda df: op.bursts_per_electrode(df, **CHANNEL),
    f"""{islands_sql('e', 60 * M, 120 * M, 10 * M, 3)}, x as (select s.e, count(*) as inside, count(distinct start_us) as nb from s join f on s.e = f.e and s.t between f.start_us and f.end_us group by 1)
select s.e as electrode, coalesce(any_value(nb), 0) as n_bursts, round(coalesce(any_value(inside), 0) / count(*), 6) as fraction from s left join x using (e) group by 1""",
)
register("network_bursts", lambda df: op.network_burst_table(df, **NETWORK), f"{network_sql()} select burst, start_us, end_us, count(distinct e) as n_electrodes, count(*) as n from nb_s group by 1, 2, 3")
REC = f"{network_sql()}, rec as (select burst, e, round((min(t) - start_us) / 1e6, 6) as latency_s, row_number() over (partition by burst order by min(t), e) as rank from nb_s group by burst, start_us, e)"
register("burst_recruitment", lambda df: op.burst_recruitment(df, **NETWORK), f"{REC} select burst, e as electrode, latency_s, cast(rank as integer) as rank from rec")
register(
    "burst_leaders", lambda df: op.burst_leaders(df, **NETWORK),
    f"{REC} select e as electrode, round(count(*) / (select count(distinct burst) from rec), 6) as participation, count(*) filter (rank = 1) as leads, round(avg(latency_s), 6) as mean_latency_s from rec group by 1",
)
register(
    "burst_similarity", lambda df: op.burst_similarity(df, **NETWORK),
    f"""{network_sql()}, v as (select burst, e, count(*) as n from nb_s group by 1, 2), nm as (select burst, sqrt(sum(n * n)) as norm from v group by 1)
select a.burst as i, b.burst as j, round(sum(a.n * b.n) / any_value(x.norm) / any_value(y.norm), 6) as cosine from v a join v b on a.e = b.e and a.burst < b.burst join nm x on x.burst = a.burst join nm y on y.burst = b.burst group by 1, 2""",
)
register("avalanches", lambda df: op.avalanches(df, 10 * M), f"{AV} select * from av")
register("avalanche_distribution", lambda df: op.avalanche_distribution(df, 10 * M), f"{AV} select size, count(*) as n from av group by 1")
register(
    "branching_ratio", lambda df: op.branching_ratio(df, 10 * M),
    f"""{AV}, r as (select coalesce(y.n, 0) / x.n as r from c x left join c y on y.b = x.b + 1 where x.b < (select k from nb) - 1)
select round(avg(r), 6) as mean, round(stddev_samp(r), 6) as std, round(quantile_cont(r, 0.5), 6) as median, count(*) as n from r""",
)
register(
    "avalanche_scaling", lambda df: op.avalanche_scaling(df, 10 * M),
    f"{AV}, g as (select ln(duration) as x, ln(avg(size)) as y from av group by duration having count(*) >= 3) select count(*) as points, round(regr_slope(y, x), 6) as gamma, round(pow(corr(y, x), 2), 6) as r2 from g",
)
register(
    "powerlaw_mle", lambda df: op.powerlaw_mle(df, 10 * M),
    f"""{AV}, z as (select size, count(*) as n from av group by 1), tl as (select a.size as xmin, b.size, b.n from z a join z b on b.size >= a.size),
ft as (select xmin, sum(n) as k, 1 + sum(n) / sum(n * ln(size / (xmin - 0.5))) as alpha from tl group by 1 having sum(n) >= 30),
w as (select tl.xmin, alpha, sum(n) over (partition by tl.xmin order by size) as u, n, k, 1 - pow(size / tl.xmin, 1 - alpha) as cdf from tl join ft on ft.xmin = tl.xmin),
ks as (select xmin, alpha, max(greatest(abs(u / k - cdf), abs((u - n + 1) / k - cdf))) as ks from w group by 1, 2)
select xmin, round(alpha, 6) as alpha, round(ks, 6) as ks from ks order by round(ks, 9), xmin limit 1""",
)
register(
    "updown_epochs", lambda df: op.updown_epochs(df, H),
    f"{UD}, q as (select *, row_number() over (order by b) - row_number() over (partition by up order by b) as run from u) select min(b) as start_bin, cast(up as integer) as up, count(*) as bins from q group by up, run",
)
register(
    "vigilance", lambda df: op.vigilance(df, H, 6),
    f"{UD}, w as (select b // 6 as win, stddev_pop(n) / avg(n) as cv from p group by 1 having count(*) = 6) select win, round(cv, 6) as cv, cast(cv > (select quantile_cont(cv, 0.5) + 0.5 * stddev_pop(cv) from w) as integer) as active from w",
)
register(
    "sleep_pressure", lambda df: op.sleep_pressure(df, H, 6),
    f"""{UD}, w as (select b // 6 as win, avg(cast(up as integer)) as f from u group by 1 having count(*) = 6), y as (select sum(f) over (order by win rows unbounded preceding) as run, 1 - lead(f) over (order by win) as down from w)
select count(*) as windows, round(corr(run, down), 6) as r from y where down is not null""",
)

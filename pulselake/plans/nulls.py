"""Queries on significance: surrogates of the same md5 seeds in SQL."""

from __future__ import annotations

from ..operators import surrogates as op
from .evolving import H
from .pairwise import ENT, M, L, LB, DG
from .registry import dense_sql, register
from .signals import PHASES

REPS, ALPHA = 20, 0.1
NB = f"nb as (select cast(greatest(1, (dur + {H - 1}) // {H}) as bigint) as k from d)"


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(58) || '.join(f'cast({p} as varchar)' for p in parts)}), 1, 8))::bigint"


REP = f"rp as (select unnest(range(0, {REPS + 1})) as rep)"
#: Rotation sh (e, rep, shift) of each channel; needs nb.
SHIFT = f"{REP}, sh as (select e, rep, case when rep = 0 then 0 else 1 + {draw_sql('rep', 'e')} % greatest(k - 1, 1) end as shift from (select distinct e from s) cross join rp cross join nb)"


def verdict_sql(keys: str, value: str) -> str:
    """From st (keys, rep, v)."""
    return f""", vr as (select {keys}, rep, round(v, 9) as v from st), vo as (select {keys}, v as obs from vr where rep = 0),
vk as (select {keys}, any_value(obs) as obs, coalesce(sum(v) filter (rep > 0), 0) / {REPS} as mean, coalesce(sum(v * v) filter (rep > 0), 0) / {REPS} as square,
count(*) filter (rep > 0 and v >= obs) + case when any_value(obs) <= 0 then {REPS} - count(*) filter (rep > 0) else 0 end as k from vr join vo using ({keys}) group by {keys}),
vs as (select *, sqrt(greatest(square - mean * mean, 0)) as sd, (k + 1) / {REPS + 1} as p1 from vk),
vb as (select *, p1 * count(*) over () / count(*) over (order by p1) as bound from vs), vq as (select *, least(1.0, min(bound) over (order by p1 desc)) as q from vb)
select {keys}, round(obs, 6) as {value}, round(mean, 6) as null_mean, round(sd, 6) as null_std, round(case when sd > 1e-9 then (obs - mean) / sd else 0 end, 4) as z, round(k / {REPS}, 6) as p, round(q, 6) as q,
cast(round(q, 9) <= {ALPHA} as integer) as significant from vq"""


register(
    "te_significance", lambda df: op.te_significance(df, H, 2, REPS, ALPHA),
    f""", {dense_sql(H)}, {NB}, {SHIFT}, bt as (select e, b, cast(n > 0 as integer) as bit from dn),
yy as (select e, b, bit as yf, lag(bit) over v + 2 * lag(bit, 2) over v as yh from bt window v as (partition by e order by b)),
xs as (select e, rep, (b + shift) % k as b, bit from bt join sh using (e) cross join nb), xx as (select e, rep, b, lag(bit) over v + 2 * lag(bit, 2) over v as xh from xs window v as (partition by e, rep order by b)),
c as (select rep, x.e as e1, y.e as e2, yf, yh, xh, count(*) as n from xx x join yy y on x.b = y.b and x.e <> y.e where xh is not null and yh is not null group by all),
t as (select *, sum(n) over (partition by rep, e1, e2) as al, sum(n) over (partition by rep, e1, e2, yh) as a, sum(n) over (partition by rep, e1, e2, yh, xh) as b, sum(n) over (partition by rep, e1, e2, yf, yh) as dd from c),
st as (select rep, e1, e2, sum(n / al * log2(n * a / (b * dd))) as v from t group by 1, 2, 3){verdict_sql('e1, e2', 'te')}""",
)
JIT = 15 * M
register(
    "ccg_significance", lambda df: op.ccg_significance(df, L, LB, JIT, REPS, ALPHA),
    f""", {REP}, lf as (select rep, e as e1, t + case when rep = 0 then 0 else {draw_sql('rep', 'spike_id')} % {2 * JIT + 1} - {JIT} end as t from s cross join rp),
lb as (select *, unnest([floor(t / {L})::bigint - 1, floor(t / {L})::bigint, floor(t / {L})::bigint + 1]) as k from lf), pr as (select rep, e1, s.e as e2, s.t - lb.t as dt from lb join s on s.t // {L} = lb.k and s.e > e1 where abs(s.t - lb.t) <= {L}),
pk as (select rep, e1, e2, least((dt + {L}) // {LB}, {2 * L // LB - 1}) as b, count(*) as n from pr group by all), n1 as (select e as e1, count(*) as n1 from s group by 1),
st as (select rep, e1, e2, max(n) / any_value(n1) / 120.0 as v from pk join n1 using (e1) group by 1, 2, 3){verdict_sql('e1, e2', 'peak')}""",
)
register(
    "plv_significance", lambda df: op.plv_significance(df, H, REPS, ALPHA),
    f"""{PHASES}, {NB}, {SHIFT}, st as (select rep, a.e as e1, x.e as e2, sqrt(pow(avg(a.c * x.c + a.s * x.s), 2) + pow(avg(a.s * x.c - a.c * x.s), 2)) as v
from u a join (select e, rep, (b + shift) % k as b, c, s from u join sh using (e) cross join nb) x on a.b = x.b and a.e < x.e group by 1, 2, 3){verdict_sql('e1, e2', 'plv')}""",
)
NB6 = f"nb as (select cast(greatest(1, (dur + {6 * H - 1}) // {6 * H}) as bigint) as k from d)"
register(
    "mi_significance", lambda df: op.mi_significance(df, 6 * H, REPS, ALPHA),
    f"""{DG}, {NB6}, {SHIFT}, c as (select rep, p.e as e1, q.e as e2, p.lv as x, q.lv as y, count(*) as n from dg p join (select e, rep, (b + shift) % k as b, lv from dg join sh using (e) cross join nb) q on p.b = q.b and p.e < q.e group by all),
hj as (select rep, e1, e2, {ENT} as h from c group by 1, 2, 3), hx as (select rep, e1, e2, {ENT} as h from (select rep, e1, e2, x, cast(sum(n) as double) as n from c group by all) group by 1, 2, 3),
hy as (select rep, e1, e2, {ENT} as h from (select rep, e1, e2, y, cast(sum(n) as double) as n from c group by all) group by 1, 2, 3),
st as (select rep, e1, e2, hx.h + hy.h - hj.h as v from hj join hx using (rep, e1, e2) join hy using (rep, e1, e2)){verdict_sql('e1, e2', 'mi')}""",
)
register(
    "order_null", lambda df: op.order_null(df, H, 24, REPS, ALPHA),
    f"""{PHASES}, {NB}, {SHIFT}, r as (select rep, (b + shift) % k as b, sqrt(pow(avg(c), 2) + pow(avg(s), 2)) as r from u join sh using (e) cross join nb group by 1, 2),
w as (select rep, b // 24 as win, avg(r) as r from r where b // 24 < (select greatest(k // 24, 1) from nb) group by 1, 2), st as (select 'variance_e3' as what, rep, var_pop(r) * 1000 as v from w group by rep){verdict_sql('what', 'metastability')}""",
)
register(
    "updown_null", lambda df: op.updown_null(df, H, REPS, ALPHA),
    f""", {NB}, {REP}, gb as (select unnest(range(0, (select k from nb))) as b), ob as (select 0 as rep, least(t // {H}, (select k from nb) - 1) as b from s union all select rep, cast(floor({draw_sql('rep', 'spike_id')} * (select k from nb) / 4294967296.0) as bigint) from s cross join rp where rep > 0),
c as (select rep, b, count(*) as n from ob group by 1, 2), x as (select rp.rep, gb.b, coalesce(n, 0) as n from rp cross join gb left join c on c.rep = rp.rep and c.b = gb.b),
m as (select rep, avg(n) as m, quantile_cont(n, 0.5) as med from x group by 1), y as (select rep, b, n - m as z, cast(n > med as integer) as up from x join m using (rep)),
tn as (select *, coalesce(cast(lag(up) over (partition by rep order by b) <> up as integer), 0) as turn from y), ep as (select *, sum(turn) over (partition by rep order by b rows unbounded preceding) as epoch from tn),
sp as (select rep, avg(z * z) as m2, avg(z * z * z) as m3, avg(z * z * z * z) as m4, sum(turn) as turns from ep group by 1), le as (select rep, stddev_pop(k) / avg(k) as cv from (select rep, epoch, count(*) as k from ep group by 1, 2) group by 1),
st as (select 'bimodality' as what, rep, case when m4 > 0 then (m3 * m3 / pow(m2, 3) + 1) / (m4 / (m2 * m2)) else 0 end as v from sp union all select 'changes', rep, turns from sp union all select 'epoch_cv', rep, cv from le){verdict_sql('what', 'value')}""",
)

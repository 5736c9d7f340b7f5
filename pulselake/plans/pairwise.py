"""Queries on pairs of channels, stimuli and information."""

from __future__ import annotations

from ..operators import pairs as op
from ..sources.events import spikes, stimuli
from .registry import BASE, dense_sql, register, register_raw

M = 60_000_000
H = 60 * M
L, LB = 30 * M, 2 * M

LAG = f", lg as (select a.e as e1, b.e as e2, b.t - a.t as dt from s a join s b on a.e <> b.e and b.t between a.t - {L} and a.t + {L})"
CCG = f"{LAG}, cc as (select e1, e2, least((dt + {L}) // {LB}, {2 * L // LB - 1}) as lag_bin, count(*) as n from lg where e1 < e2 group by all)"
register("ccg_counts", lambda df: op.ccg_counts(df, L, LB), f"{CCG} select * from cc")
register(
    "ccg_peak", lambda df: op.ccg_peak(df, L, LB),
    f"""{CCG}, n1 as (select e as e1, count(*) as n1 from s group by 1), pk as (select * from cc qualify row_number() over (partition by e1, e2 order by n desc, lag_bin) = 1)
select pk.e1, e2, round(n / n1 / 120.0, 6) as peak, round(cast((lag_bin + 0.5) * 120 - 1800 as double), 6) as lag_s from pk join n1 using (e1)""",
)
STDP = f"""{LAG}, bz as (select e from s group by 1 having count(*) >= 5), sp as (select e1, e2, count(*) filter (dt > 0) as ltp, count(*) filter (dt < 0) as ltd, avg(dt) filter (dt > 0) / 1e6 as ld, avg(dt) filter (dt < 0) / 1e6 as tr
from lg where e1 in (select e from bz) and e2 in (select e from bz) group by 1, 2 having count(*) >= 3),
st as (select e1, e2, ltp, ltd, round((ltp - ltd) / greatest(ltp + ltd, 1), 6) as asymmetry, round(ld, 3) as mean_lead_s, round(tr, 3) as mean_trail_s from sp)"""
register("stdp_pairs", lambda df: op.stdp_pairs(df, L), f"{STDP} select * from st")
register(
    "stdp_top", lambda df: op.stdp_top(df, L),
    f"""{STDP} select * from (select 'ltp' as kind, e1, e2, asymmetry from st where asymmetry > 0 order by asymmetry desc, e1, e2 limit 5)
union all select * from (select 'ltd' as kind, e1, e2, asymmetry from st where asymmetry < 0 order by asymmetry, e1, e2 limit 5)""",
)

STIM = f"""{BASE}, st as (select spike_id as stim_id, t as u, cast(floor(amp / 50.0) as integer) as dose from s where event_type = 'purchase'),
sp as (select stim_id, dose, s.e, s.t - u as dt from st join s on s.t >= u - {H} and s.t < u + {H} and s.spike_id <> stim_id),
tr as (select st.stim_id, st.dose, count(*) filter (dt < 0) as baseline, count(*) filter (dt >= 0) as response, min(dt) filter (dt >= 0) as latency_us from st left join sp using (stim_id) group by 1, 2)"""
register_raw("stim_trials", lambda spark, d: op.stim_trials(spikes(spark, d), stimuli(spark, d), H), f"{STIM} select * from tr")
register_raw(
    "stim_electrodes", lambda spark, d: op.stim_electrodes(spikes(spark, d), stimuli(spark, d), H),
    f"{STIM}, f as (select e, stim_id, min(dt) as lat from sp where dt >= 0 group by 1, 2) select e as electrode, count(*) as answers, round(count(*) / (select count(*) from st), 6) as reliability, round(avg(lat) / 1e6, 3) as mean_latency_s from f group by 1",
)
register_raw(
    "dose_response", lambda spark, d: op.dose_response(spikes(spark, d), stimuli(spark, d), H),
    f"{STIM}, g as (select dose, response - baseline as gain from tr) select dose, count(*) as trials, round(avg(gain), 6) as mean, round(stddev_pop(gain), 6) as std, round(stddev_pop(gain) / sqrt(count(*)), 6) as sem from g group by 1",
)


def contingency_sql(width: int) -> str:
    nb = f"(select greatest(1, (dur + {width - 1}) // {width}) from d)"
    return f""", oc as (select distinct e, least(t // {width}, {nb} - 1) as b from s), k as (select e, count(*) as k from oc group by 1),
bo as (select x.e as e1, y.e as e2, count(*) as n11 from oc x join oc y on x.b = y.b and x.e < y.e group by 1, 2),
ct as (select p.e as e1, q.e as e2, cast(coalesce(n11, 0) as double) as x, coalesce(n11, 0) as n11, cast(p.k as double) as a, cast(q.k as double) as b, cast({nb} as double) as n from k p join k q on p.e < q.e left join bo on bo.e1 = p.e and bo.e2 = q.e)"""


register(
    "cofiring_phi", lambda df: op.cofiring_phi(df, 10 * M, 3.29),
    f"""{contingency_sql(10 * M)}, z as (select *, (x - a * b / n) / sqrt(a * b / n * (1 - a / n) * (1 - b / n)) as z from ct)
select e1, e2, n11 as co, round((n * x - a * b) / sqrt(a * (n - a) * b * (n - b)), 6) as phi, round(z, 6) as z, cast(round(abs(z), 6) > 3.29 as integer) as significant from z""",
)


def plog(p: str) -> str:
    return f"(case when {p} > 0 then ({p}) * log2({p}) else 0 end)"


register(
    "mi_pairs", lambda df: op.mi_pairs(df, 10 * M),
    f"""{contingency_sql(10 * M)} select e1, e2, round(-{plog('a / n')} - {plog('1 - a / n')} - {plog('b / n')} - {plog('1 - b / n')} + {plog('x / n')} + {plog('(a - x) / n')} + {plog('(b - x) / n')} + {plog('(n - a - b + x) / n')}, 6) as mi from ct""",
)
register(
    "entropy_binary", lambda df: op.entropy_binary(df, 10 * M),
    f"{contingency_sql(10 * M)}, p as (select e, k / greatest(1, ((select dur from d) + {10 * M - 1}) // {10 * M}) as p from k) select e as electrode, round(-{plog('p')} - {plog('1 - p')}, 6) as h from p",
)


def corr_sql(reach: int) -> str:
    return f""", {dense_sql(H)}, m as (select e, avg(n) as mean, stddev_pop(n) as sd from dn group by 1), lags as (select unnest(range({-reach}, {reach + 1})) as lag),
cr as (select x.e as e1, y.e as e2, cast(lag as integer) as lag, sum((x.n - p.mean) * (y.n - q.mean)) / count(*) / (any_value(p.sd) * any_value(q.sd)) as r
from dn x cross join lags join dn y on y.b = x.b + lag and y.e <> x.e join m p on p.e = x.e join m q on q.e = y.e where p.sd > 0 and q.sd > 0 group by 1, 2, 3)"""


register("connectome_edges", lambda df: op.connectome_edges(df, H, 0.05), f"{corr_sql(0)} select e1, e2, round(r, 6) as r from cr where e1 < e2 and abs(r) >= 0.05")
register("lagged_corr", lambda df: op.lagged_corr(df, H, 2), f"{corr_sql(2)} select e1, e2, lag, round(r, 6) as r from cr")
register(
    "causal_hierarchy", lambda df: op.causal_hierarchy(df, H, 2),
    f"""{corr_sql(2)}, w as (select e1, e2, max(abs(r)) as w from cr where lag > 0 group by 1, 2), o as (select e1 as e, sum(w) as o from w group by 1), i as (select e2 as e, sum(w) as i from w group by 1), x as (select e, o / greatest(o + i, 1e-10) as ratio from o join i using (e))
select e as electrode, round(ratio, 6) as ratio, cast(row_number() over (order by round(ratio, 9) desc, e) as integer) as level from x""",
)
BITS = f", {dense_sql(H)}, bt as (select e, b, cast(n > 0 as integer) as bit from dn)"
ENT = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"
register(
    "entropy_words", lambda df: op.entropy_words(df, H),
    f"""{BITS}, w as (select e, bit + 2 * lag(bit) over v + 4 * lag(bit, 2) over v + 8 * lag(bit, 3) over v as word from bt window v as (partition by e order by b)), c as (select e, word, count(*) as n from w where word is not null group by 1, 2)
select e as electrode, round({ENT}, 6) as h_words, count(*) as n_words from c group by 1""",
)


def states_sql(width: int, name: str = "stt") -> str:
    nb = f"(select greatest(1, (dur + {width - 1}) // {width}) from d)"
    return f"""{name} as (select x.b, coalesce(p.st, 0) as st from (select unnest(range(0, {nb})) as b) x left join (select b, cast(sum(1::bigint << e) as bigint) as st from (select distinct e, least(t // {width}, {nb} - 1) as b from s) group by 1) p on p.b = x.b)"""


register("joint_entropy", lambda df: op.joint_entropy(df, H), f", {states_sql(H)}, c as (select st, count(*) as n from stt group by 1) select round({ENT}, 6) as h, count(*) as n_states from c")


def transition_sql(widths: list[int]) -> str:
    parts, selects = [], []
    for w in widths:
        k = w // 1_000_000
        parts += [states_sql(w, f"s{k}"), f"t{k} as (select a.st as x, b.st as f, count(*) as n from s{k} a join s{k} b on b.b = a.b + 1 group by 1, 2)"]
        h = lambda g, k=k: f"(select {ENT} from (select cast(sum(n) as double) as n from t{k} group by {g}))"
        selects.append(f"select cast({k} as integer) as width_s, round({h('x')} + {h('f')} - {h('x, f')}, 6) as mi, round({h('f')}, 6) as h_effect, round({h('x, f')} - {h('x')}, 6) as h_conditional, (select count(distinct x) from t{k}) as n_states")
    return ", " + ", ".join(parts) + " " + " union all ".join(selects)


register("transition_mi", lambda df: op.transition_mi(df, [H]), transition_sql([H]))
register("transition_scales", lambda df: op.transition_mi(df, [H, 2 * H, 4 * H]), transition_sql([H, 2 * H, 4 * H]))
register("ais_multiscale", lambda df: op.transition_mi(df, [10 * M, 30 * M, H, 6 * H]), transition_sql([10 * M, 30 * M, H, 6 * H]))
TE = f"""{BITS}, hx as (select e, b, bit, lag(bit) over v + 2 * lag(bit, 2) over v as h from bt window v as (partition by e order by b)),
c as (select x.e as e1, y.e as e2, y.bit as yf, y.h as yh, x.h as xh, count(*) as n from hx x join hx y on x.b = y.b and x.e <> y.e where x.h is not null and y.h is not null group by all),
t as (select *, sum(n) over (partition by e1, e2) as al, sum(n) over (partition by e1, e2, yh) as a, sum(n) over (partition by e1, e2, yh, xh) as b, sum(n) over (partition by e1, e2, yf, yh) as dd from c),
te as (select e1, e2, round(sum(n / al * log2(n * a / (b * dd))), 6) as te from t group by 1, 2)"""
register("transfer_entropy", lambda df: op.transfer_entropy(df, H, 2), f"{TE} select * from te")
register("net_te", lambda df: op.net_te(df, H, 2), f"{TE} select x.e1, x.e2, round(x.te - y.te, 6) as net from te x join te y on x.e1 = y.e2 and x.e2 = y.e1 where x.e1 < x.e2")
DG = f""", {dense_sql(6 * H)}, q as (select e, quantile_cont(n, 0.25) as q1, quantile_cont(n, 0.5) as q2, quantile_cont(n, 0.75) as q3 from dn group by 1),
dg as (select e, b, cast(n > q1 as integer) + cast(n > q2 as integer) + cast(n > q3 as integer) as lv from dn join q using (e))"""
register(
    "mi_quantile", lambda df: op.mi_quantile(df, 6 * H),
    f"""{DG}, c as (select x.e as e1, y.e as e2, x.lv as x, y.lv as y, count(*) as n from dg x join dg y on x.b = y.b and x.e < y.e group by all),
hj as (select e1, e2, {ENT} as h from c group by 1, 2), hx as (select e1, e2, {ENT} as h from (select e1, e2, x, cast(sum(n) as double) as n from c group by all) group by 1, 2), hy as (select e1, e2, {ENT} as h from (select e1, e2, y, cast(sum(n) as double) as n from c group by all) group by 1, 2)
select e1, e2, round(hx.h + hy.h - hj.h, 6) as mi, round(case when least(hx.h, hy.h) > 1e-12 then (hx.h + hy.h - hj.h) / least(hx.h, hy.h) else 0 end, 6) as nmi from hj join hx using (e1, e2) join hy using (e1, e2)""",
)
CODE = f"{DG}, lb as (select b, string_agg(cast(lv as varchar), '' order by e) as label from dg group by 1), lc as (select label, count(*) as n from lb group by 1)"
register("population_codes", lambda df: op.population_codes(df, 6 * H), f"{CODE} select label, n from lc")
register("channel_capacity", lambda df: op.channel_capacity(df, 6 * H), f"{CODE} select round({ENT}, 6) as bits, count(*) as n_labels, round(({ENT}) / greatest(log2(count(*)), 1e-10), 6) as efficiency from lc")

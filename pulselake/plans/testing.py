"""Queries on rank tests, p-values and bootstraps; SQL takes the special functions from lgamma."""

from __future__ import annotations

from ..operators import significance as op
from .bursting import AV, H, M
from .nulls import draw_sql
from .registry import ORACLE_SQL, dense_sql, register
from .structure import PL

BOOT = 40


def normal_p_sql(z: str) -> str:
    x = f"(least(abs({z}), 8.0) / sqrt(2.0))"
    return f"greatest(0, 1 - list_sum(list_transform(range(0, 161), lambda k: case when {x} > 0 then exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5) - {x} * {x}) else 0 end)))"


def beta_sql(x: str, a: str, b: str) -> str:
    side = lambda x, a, b: f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} * list_sum(list_transform(range(0, 501), lambda i: exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x}))))"
    return f"case when {x} <= 0 then 0 when {x} >= 1 then 1 when {x} > ({a} + 1) / ({a} + {b} + 2) then 1 - {side(f'(1 - {x})', b, a)} else {side(x, a, b)} end"


ERR = f""", {dense_sql(H)}, tp as (select e, row_number() over (order by count(*) desc, e) - 1 as place from s group by e qualify place < 5),
stt as (select b, sum(case when n > 0 then 1 << place else 0 end)::integer as st from dn join tp using (e) group by b),
vt as (select x.b + k as b, st, count(*) as k from stt x cross join (select unnest(range(1, 7)) as k) group by 1, 2), gs as (select b, arg_min(st, (-k, st)) as guess from (select b, st, k from vt) group by b),
er as (select b, bit_count(xor(st, guess))::integer as err from stt join gs using (b) where b >= 6),
pc as (select e, corr(n, err) as r, count(*) as k from dn join er using (b) group by e having stddev_pop(n) > 1e-10 and stddev_pop(err) > 1e-10 and count(*) > 2),
pp as (select e, r, k, {beta_sql('(1 - r * r)', '((k - 2) / 2)', '0.5::double')} as p from pc)"""
register(
    "prediction_error_electrodes", lambda df: op.prediction_error_electrodes(df, H, 6),
    f"""{ERR} select e as electrode, round(r, 6) as r, round(p, 6) as p, round(case when r > 0 then least(1, p * (select count(*) from pp where r > 0)) end, 6) as p_corrected,
coalesce(cast(round(case when r > 0 then least(1, p * (select count(*) from pp where r > 0)) end, 9) < 0.05 as integer), 0) as significant from pp""",
)
register(
    "prediction_error_summary", lambda df: op.prediction_error_summary(df, H, 6),
    f"""{ERR}, m as (select count(*) as n, avg(r) as mean, stddev_samp(r) as sd, stddev_pop(r) as pd from pp), t as (select *, mean / (sd / sqrt(n)) as t from m where n >= 3 and sd > 1e-12),
h as (select *, ({beta_sql('((n - 1) / (n - 1 + t * t))', '((n - 1) / 2)', '0.5::double')}) / 2 as half from t), q as (select *, case when mean < 0 then 1 - half else half end as p, mean / greatest(pd, 1e-10) as effect from h)
select n as tested, round(mean, 6) as mean_r, round(t, 4) as t, round(p, 6) as p, round(effect, 6) as effect, cast(round(p, 9) < 0.01 and effect > 0.3 as integer) as detected from q""",
)
register(
    "deviant_response", lambda df: op.deviant_response(df, H, 6),
    f"""{ERR}, x as (select e, n, cast(err > 0 as integer) as g from dn join er using (b)), r as (select *, avg(rn) over (partition by e, n) as rank, count(*) over (partition by e, n) as t from (select *, row_number() over (partition by e order by n) as rn from x)),
a as (select e, sum(g) as n1, count(*) - sum(g) as n0, sum(rank) filter (g = 1) as r1, sum(t * t - 1.0) as ties from r group by e having sum(g) > 0 and sum(g) < count(*)),
v as (select *, r1 - n1 * (n1 + 1) / 2 as u, n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1))) as var from a), z as (select *, case when var > 1e-12 then (u - n1 * n0 / 2) / sqrt(var) else 0 end as z from v)
select e as electrode, cast(n1 as bigint) as deviants, cast(n0 as bigint) as standards, u, round(z, 4) as z, round({normal_p_sql('z')}, 6) as p from z""",
)
_tests = ORACLE_SQL["powerlaw_tests"]
_cut = _tests.index("select 'exponential'")
register("powerlaw_pvalues", lambda df: op.powerlaw_pvalues(df, 10 * M))
ORACLE_SQL["powerlaw_pvalues"] = f"{_tests[:_cut]} select *, round({normal_p_sql('z')}, 6) as p from ({_tests[_cut:]})"
register(
    "powerlaw_bootstrap", lambda df: op.powerlaw_bootstrap(df, 10 * M, BOOT),
    f"""{PL}, best as (select xmin, round(alpha, 6) as alpha, round(ks, 6) as ks from ks order by round(ks, 9), xmin limit 1),
tl2 as (select rep, start_bin, size, xmin, alpha, ks, ({draw_sql("'w'", 'rep', 'start_bin')} + 0.5) / 4294967296.0::double as uw, ({draw_sql("'g'", 'rep', 'start_bin')} + 0.5) / 4294967296.0::double as ug
from av cross join best cross join (select unnest(range(1, {BOOT + 1})) as rep) where size >= xmin),
ws as (select *, list_count(list_filter({op._POISSON}, lambda c: uw > c)) as w from tl2), al as (select rep, 1 + sum(w) / sum(w * ln(size / (xmin - 0.5))) as a from ws group by 1),
dr as (select rep, xmin, ks, greatest(xmin, cast(floor(xmin * pow(1 - ug, -1 / (alpha - 1))) as bigint)) as x, count(*) as n from tl2 group by all), da as (select rep, 1 + sum(n) / sum(n * ln(x / (xmin - 0.5))) as a, sum(n) as k from dr group by 1),
dc as (select rep, ks, sum(n) over (partition by rep order by x) as u, n, k, 1 - pow(x / xmin, 1 - a) as cdf from dr join da using (rep)), fr as (select rep, any_value(ks) as ks, max(greatest(abs(u / k - cdf), abs((u - n + 1) / k - cdf))) as far from dc group by 1)
select xmin, alpha, round((select quantile_cont(a, 0.025) from al), 6) as alpha_low, round((select quantile_cont(a, 0.975) from al), 6) as alpha_high, ks, round((select avg(cast(round(far, 6) >= ks as integer)) from fr), 6) as fit_p from best""",
)

"""Queries on composite scores and reports."""

from __future__ import annotations

from ..operators import scores
from ..sources.events import spikes
from .bursting import AV
from .evolving import DAY, W24, H
from .pairwise import ENT, M, contingency_sql, states_sql
from . import basic  # noqa: F401  its SQL is part of some here
from .registry import BASE, ORACLE_SQL, dense_sql, register, register_raw

register("swarm_coupling", scores.swarm, f", c as (select mea, count(*) as n from s group by 1) select mea, n, round((select avg(n) from c) + (n - (select avg(n) from c)) * {repr(0.7**10)}, 6) as coupled from c")
SPREAD = "(select -sum(p * log2(p)) / log2(count(*)) from (select count(*) / (select n from d) as p from s group by e))"
register(
    "composite_score", lambda df: scores.composite(df, H, 10 * M),
    f"""{AV}, rr as (select coalesce(y.n, 0) / x.n as r from c x left join c y on y.b = x.b + 1 where x.b < (select k from nb) - 1), {dense_sql(H)}, pp as (select b, cast(sum(n) as double) as n from dn group by 1)
{contingency_sql(H).replace(', k as', ', kk as').replace('from k p join k q', 'from kk p join kk q').replace('bo as', 'bq as').replace('left join bo on bo.e1 = p.e and bo.e2', 'left join bq on bq.e1 = p.e and bq.e2')},
v as (select round({SPREAD}, 6) as spread, exp(-pow((select round(stddev_pop(n / 3600) / avg(n / 3600), 6) from pp) - 1, 2) / 0.5) as variability, exp(-pow((select round(avg(r), 6) from rr) - 1, 2) / 0.18) as criticality,
1 / (1 + exp(-greatest(least(10 * ((select avg(abs(round((n * x - a * b) / sqrt(a * (n - a) * b * (n - b)), 6))) from ct) - 0.05), 30), -30))) as coupling)
select round(spread, 6) as spread, round(variability, 6) as variability, round(criticality, 6) as criticality, round(coupling, 6) as coupling, round(100 * (spread + variability + criticality + coupling) / 4, 4) as score from v""",
)
register(
    "welfare_report", lambda df: scores.welfare(df, DAY),
    f""", hf as ({ORACLE_SQL['health_flags']}), sf as ({ORACLE_SQL['suffering_flags']}), w as (select any_value(hf.score) as score, least(1.0, avg(n_flags / 4)) as risk from sf cross join hf)
select score, round(risk, 6) as risk, round(score * (1 - risk), 6) as welfare, case when score * (1 - risk) >= 70 then 'continue' when score * (1 - risk) >= 40 then 'monitor' else 'rest' end as advice from w""",
)
register(
    "report", lambda df: scores.report(df, H),
    f""", c as (select count(*) / ((select dur from d) / 1e6) as rate from s group by e), {dense_sql(H)}, pp as (select b, cast(sum(n) as double) as n from dn group by 1), {states_sql(H)}, sc as (select st, count(*) as n from stt group by 1),
ac as (select avg(cast(n / ((select dur from d) / 1e6) > 0.0001 as integer)) from (select count(*) as n from s group by e)),
x as (select n / 3600 as y, cos(b * {W24}) as c, sin(b * {W24}) as s from pp), a as (select covar_pop(c, c) as cc, covar_pop(s, s) as ss, covar_pop(c, s) as cs, covar_pop(c, y) as cy, covar_pop(s, y) as sy, avg(y) as my, avg(c) as mc, avg(s) as ms from x),
b as (select *, (cy * ss - sy * cs) / (cc * ss - cs * cs) as b, (sy * cc - cy * cs) / (cc * ss - cs * cs) as g from a), ent as (select count(*) / (select n from d) as p from s group by e)
select 'population' as section, 'n_spikes' as metric, cast((select n from d) as double) as value union all select 'population', 'mean_rate', (select round(avg(rate), 6) from c) union all select 'population', 'std_rate', (select round(stddev_pop(rate), 6) from c)
union all select 'temporal', 'cv', (select round(stddev_pop(n / 3600) / avg(n / 3600), 6) from pp) union all select 'temporal', 'r2', (select round(pow(corr(n / 3600, (b + 0.5) * 3600), 2), 6) from pp)
union all select 'spatial', 'entropy', (select round(-sum(p * log2(p)), 6) from ent) union all select 'spatial', 'uniformity', (select round(-sum(p * log2(p)) / log2(count(*)), 6) from ent)
union all select 'information', 'joint_entropy', (select round({ENT}, 6) from sc) union all select 'rhythm', 'mesor', (select round(my - b * mc - g * ms, 6) from b) union all select 'rhythm', 'amplitude', (select round(sqrt(b * b + g * g), 6) from b)""",
)

#: Reference profiles (system, feature, value, weight) for the comparison query.
PROFILES = [
    ("regular", "cv", 0.2, 1.0), ("regular", "branching", 0.5, 1.5), ("regular", "uniformity", 0.95, 0.5),
    ("critical", "cv", 1.0, 1.0), ("critical", "branching", 1.0, 1.5), ("critical", "uniformity", 0.8, 0.5),
    ("bursty", "cv", 2.5, 1.0), ("bursty", "branching", 1.6, 1.5), ("bursty", "uniformity", 0.6, 0.5),
]


def _profiles(spark, sf_dir):
    return scores.similarity_to_profiles(spikes(spark, sf_dir), spark.createDataFrame(PROFILES, "system string, feature string, value double, weight double"), H)


PROFILE_ROWS = ", ".join(f"('{system}', '{feature}', {value}, {weight})" for system, feature, value, weight in PROFILES)
register_raw(
    "similarity_to_profiles", _profiles,
    f"""{BASE}, {dense_sql(H)}, pp as (select b, cast(sum(n) as double) as n from dn group by 1), pf(system, feature, value, weight) as (values {PROFILE_ROWS}),
ow as (select 'cv' as feature, round(stddev_pop(n / 3600) / avg(n / 3600), 6) as x from pp union all select 'branching', round(avg(coalesce(y.n, 0) / x.n), 6) from pp x left join pp y on y.b = x.b + 1 where x.n > 0 and x.b < (select max(b) from pp)
union all select 'uniformity', round(-sum(p * log2(p)) / greatest(log2(count(*)), 1e-10), 6) from (select count(*) / (select n from d) as p from s group by e)),
sp as (select feature, min(value) - (max(value) - min(value)) * 0.2 as lo, max(value) + (max(value) - min(value)) * 0.2 as hi from pf group by 1),
ab as (select system, cast(weight as double) as w, greatest(0, least(1, (x - lo) / greatest(hi - lo, 1e-12))) as a, greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-12))) as b from pf join sp using (feature) join ow using (feature))
select system, round(sum(a * b * w * w) / sqrt(sum(a * a * w * w) * sum(b * b * w * w)), 6) as cosine, round(sqrt(sum(w * pow(a - b, 2))), 6) as distance from ab group by 1""",
)

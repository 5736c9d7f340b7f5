"""Queries on learning, consolidation, block states, replay and retention."""

from __future__ import annotations

from ..operators import plasticity as op
from .evolving import DAY, H
from .pairwise import L
from .registry import dense_sql, register

POP = f", {dense_sql(H)}, pp as (select b, cast(sum(n) as bigint) as n from dn group by 1)"
register(
    "learning_episodes", lambda df: op.learning_episodes(df, DAY, DAY // 2, L, 0.02),
    f""", lg as (select a.e as e1, b.e as e2, a.t as t1, b.t as t2 from s a join s b on a.e < b.e and b.t between a.t - {L} and a.t + {L}), lw as (select (dur - {DAY}) // {DAY // 2} as k from d), wd as (select unnest(range(0, (select k + 1 from lw))) as w),
p as (select w, e1, e2, count(*) filter (t2 > t1) as ld, count(*) filter (t2 < t1) as tr from lg join wd on least(t1, t2) >= w * {DAY // 2} and greatest(t1, t2) <= w * {DAY // 2} + {DAY} group by 1, 2, 3),
q as (select w, count(*) as pairs, avg(abs((ld - tr) / greatest(ld + tr, 1))) as a from p group by 1), c as (select *, a - lag(a) over (order by w) as ch from q)
select w as win, pairs, round(a, 6) as asymmetry, round(ch, 6) as change, cast(round(abs(coalesce(ch, 0)), 9) > 0.02 as integer) as episode from c""",
)
register(
    "consolidation_events", lambda df: op.consolidation_events(df, H),
    f"""{POP}, th as (select quantile_cont(n, 0.25) as lo, quantile_cont(n, 0.9) as hi from pp), qu as (select b, b - row_number() over (order by b) as run from pp where n <= (select lo from th)), ru as (select max(b) as z, count(*) as quiet_bins from qu group by run having count(*) >= 2)
select b as bin, n, quiet_bins from pp join ru on b = z + 1 where n >= (select hi from th)""",
)
register(
    "mea_states", lambda df: op.mea_states(df, H),
    f""", nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), c as (select mea, least(t // {H}, (select k from nb) - 1) as b, count(*) as n from s group by all),
x as (select m.mea, y.b, coalesce(c.n, 0) as n from (select distinct mea from s) m cross join (select unnest(range(0, (select k from nb))) as b) y left join c on c.mea = m.mea and c.b = y.b),
u as (select *, cast(n > quantile_cont(n, 0.5) over (partition by mea) as integer) as up from x), v as (select *, lag(up) over (partition by mea order by b) as was from u)
select mea, round(avg(up), 6) as up_fraction, count(*) filter (up <> was) as changes, round(avg(n), 6) as mean_n from v group by 1""",
)
register(
    "pattern_replay", lambda df: op.pattern_replay(df, H, 0.3),
    f""", c as (select t // {H} as b, e, count(*) as n from s group by 1, 2), z as (select b, sum(n) as total, sqrt(sum(n * n)) as norm from c group by 1), bz as (select * from z where total >= (select quantile_cont(total, 0.9) from z)),
x as (select p.b as template, q.b as bin, round(sum(p.n * q.n) / (any_value(y.norm) * any_value(bz.norm)), 6) as similarity from c p join bz on bz.b = p.b join c q on q.e = p.e and q.b > p.b join z y on y.b = q.b group by 1, 2)
select template, bin, similarity from x where similarity >= 0.3 order by similarity desc, template, bin limit 20""",
)
register(
    "retention_curve", lambda df: op.retention_curve(df, 10, H),
    f""", {dense_sql(H)}, nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), x as (select *, (b * 10) // (select k from nb) as w from dn), r as (select p.w, p.e as e1, q.e as e2, coalesce(abs(corr(p.n, q.n)), 0) as r from x p join x q on p.b = q.b and p.e < q.e group by 1, 2, 3)
select a.w as win, round(sum(a.r * z.r) / sqrt(sum(a.r * a.r) * sum(z.r * z.r)), 6) as retention from r a join r z on z.w = 0 and a.e1 = z.e1 and a.e2 = z.e2 group by 1""",
)
register("weight_changes", lambda df: op.weight_changes(df, H, 6))

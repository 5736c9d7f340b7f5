"""Queries on integrated information; SQL tries every cut of each group of eight channels."""

from __future__ import annotations

from ..operators import partition as op
from .evolving import H
from .nulls import ALPHA, REPS
from .registry import dense_sql, register


def cuts_sql(states: str, keys: str) -> str:
    """CTEs of the information of each subset and of the cuts, from ``states`` (keys, mea, b, st)."""
    return f"""tr as (select {keys}, a.mea, a.st as s, b.st as f, count(*) as n from {states} a join {states} b using ({keys}, mea) where b.b = a.b + 1 group by all),
mk as (select unnest(range(1, 256))::integer as mask), wh as (select mea, bit_or(1 << (e % 8))::integer as whole from s group by 1),
g as (select {keys}, tr.mea, mask, s & mask as x, f & mask as y, sum(n) as n from tr join wh on wh.mea = tr.mea join mk on (mask & whole) = mask group by all),
gn as (select *, sum(n) over (partition by {keys}, mea, mask, x) as nx, sum(n) over (partition by {keys}, mea, mask, y) as ny, sum(n) over (partition by {keys}, mea, mask) as al from g),
inf as (select {keys}, mea, mask, sum(n / al * log2(n * al / (nx * ny))) as mi from gn group by all),
cu as (select a.{keys}, a.mea, a.mask, whole, w.mi as whole_mi, a.mi + b.mi as part_mi from inf a join wh on wh.mea = a.mea join inf b on b.{keys} = a.{keys} and b.mea = a.mea and b.mask = whole - a.mask join inf w on w.{keys} = a.{keys} and w.mea = a.mea and w.mask = whole where (a.mask & (whole & -whole)) > 0)"""


STATES = f""", {dense_sql(H)}, ml as (select distinct e, mea from s), gs as (select 0 as rep, mea, b, sum(case when n > 0 then 1 << (e % 8) else 0 end)::integer as st from dn join ml using (e) group by mea, b)"""
register(
    "phi_exact", lambda df: op.phi_exact(df, H),
    f"""{STATES}, {cuts_sql('gs', 'rep')} select mea, mask as part, whole - mask as rest, round(whole_mi, 6) as whole_mi, round(part_mi, 6) as part_mi, round(greatest(0, whole_mi - part_mi), 6) as phi
from cu qualify row_number() over (partition by mea order by round(greatest(0, whole_mi - part_mi), 9), mask) = 1""",
)
register(
    "phi_mip", lambda df: op.phi_mip(df, H),
    f"""{STATES}, {cuts_sql('gs', 'rep')}, pw as (select p.mea, a.mask as a, b.mask as b, greatest(0, p.mi - a.mi - b.mi) as w from inf p join inf a on a.mea = p.mea join inf b on b.mea = p.mea where a.mask < b.mask and bit_count(a.mask) = 1 and bit_count(b.mask) = 1 and p.mask = a.mask + b.mask),
cw as (select cu.mea, mask, whole, whole_mi, part_mi, round(sum(case when ((a & mask) > 0) <> ((b & mask) > 0) then w else 0 end), 9) as weight from cu join pw on pw.mea = cu.mea group by 1, 2, 3, 4, 5)
select mea, mask as part, whole - mask as rest, round(weight, 6) as weight, round(whole_mi, 6) as whole_mi, round(part_mi, 6) as part_mi, round(greatest(0, whole_mi - part_mi), 6) as phi
from cw qualify row_number() over (partition by mea order by weight, mask) = 1""",
)
register("phi_null", lambda df: op.phi_null(df, H, REPS, ALPHA))  # its SQL takes minutes; a test tries every cut of every replicate
register("phi_network", lambda df: op.phi_network(df, H))

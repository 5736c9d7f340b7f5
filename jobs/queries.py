"""The jobs as registered queries: run twice into one new shared folder; the output as it stands, and the SQL for it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import recording_digest, stimulus_trains
from jobs.common import settings
from pulselake.plans.bursting import islands_sql
from pulselake.plans.registry import BASE
from pulselake.session import shared_dir, ship


def _folder(spark: SparkSession, name: str) -> str:
    ship(spark)
    return f"{shared_dir(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def job1_recording_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, p = _folder(spark, "job1"), settings(recording_digest.NAME)
    for _ in range(2):
        recording_digest.run(spark, f"{sf_dir}/events.parquet", out, p)
    return recording_digest.read(spark, out)


def job2_stimulus_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, p = _folder(spark, "job2"), settings(stimulus_trains.NAME)
    for _ in range(2):
        stimulus_trains.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint", p)
    return stimulus_trains.read(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_recording_digest": job1_recording_digest, "job2_stimulus_trains": job2_stimulus_trains}

H, DAY = 3_600_000_000, 86_400_000_000
ORACLE_SQL: dict[str, str] = {
    "job1_recording_digest": f"""{BASE}{islands_sql('e', H, 2 * H, 600_000_000, 3)},
v as (select *, t - lag(t) over (partition by e order by t, spike_id) as gap from s),
own as (select t // {DAY} as day, e, count(*) as n, count(distinct t // {H}) as active_hours, avg(gap) as m, stddev_pop(gap) as sd, avg(amp) as a, stddev_pop(amp) as asd from v group by 1, 2),
slot as (select t // 60000000 as b, count(distinct e) as n_e, count(distinct mea) as n_g from s group by 1),
art as (select t // {DAY} as day, e, count(*) filter (n_g - 1 >= 1 or n_e >= greatest(2, ceil(0.5 * (select count(distinct e) from s)))) as artifacts from s join slot on slot.b = s.t // 60000000 group by 1, 2),
ins as (select t // {DAY} as day, s.e, count(*) as in_bursts from s join f on s.e = f.e and s.t between f.start_us and f.end_us group by 1, 2),
cnt as (select start_us // {DAY} as day, e, count(*) as bursts from f group by 1, 2),
g as (select d.day, c.e from (select distinct e from s) c cross join (select unnest(range(0, (select dur // {DAY} + 1 from d))) as day) d),
x as (select g.day, g.e, coalesce(n, 0) as n, active_hours, m, sd, a, asd, bursts, in_bursts, artifacts from g left join own on own.day = g.day and own.e = g.e
left join art on art.day = g.day and art.e = g.e left join ins on ins.day = g.day and ins.e = g.e left join cnt on cnt.day = g.day and cnt.e = g.e),
md as (select day, quantile_cont(n, 0.5) as middle from x group by 1)
select x.e as electrode, n, coalesce(active_hours, 0) as active_hours, round(n / 86400.0, 6) as rate_hz, round(m / 1e6, 6) as isi_mean_s, round(case when m > 0 then sd / m end, 6) as isi_cv,
round(a, 6) as amp_mean, round(asd, 6) as amp_std, coalesce(bursts, 0) as bursts, coalesce(in_bursts, 0) as in_bursts, coalesce(artifacts, 0) as artifacts,
case when n = 0 then 'silent' when artifacts > 0.5 * n then 'artifact' when n > 2.0 * middle then 'noisy' else 'ok' end as status, cast(x.day as integer) as day
from x join md on md.day = x.day""",
    "job2_stimulus_trains": """with r as (select row_number() over () as i, doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+') as runs from documents),
a as (select *, len(runs) as pulses, list_transform(runs, lambda w: length(w)) as amp from r),
u as (select i, unnest(runs) as w from r), c as (select i, unicode(w) % 32 as c, count(*) as k from u group by 1, 2), h as (select i, count(*) as used, sum(k) as n, log2(sum(k)) - sum(k * log2(k)) / sum(k) as bits from c group by 1),
b as (select a.*, cast(coalesce(list_sum(amp), 0) + pulses as bigint) * 50 as duration_ms, list_transform(amp[1:pulses - 1], lambda v: v + 1) as gap, coalesce(used, 0) as used, round(bits / 5, 6) as evenness from a left join h using (i)),
m as (select *, list_sum(amp) / pulses as am, list_sum(list_transform(amp, lambda v: v * v)) / pulses as aq,
case when pulses > 1 then list_sum(gap) / (pulses - 1) end as gm, case when pulses > 1 then list_sum(list_transform(gap, lambda v: v * v)) / (pulses - 1) end as gq from b)
select doc_id, lang, cast(pulses as integer) as pulses, duration_ms,
case when duration_ms < 1000 then duration_ms || 'ms' when duration_ms < 60000 then duration_ms // 1000 || 's' else duration_ms // 60000 || 'min' end as timescale,
round(case when duration_ms > 0 then pulses * 1000.0 / duration_ms end, 6) as rate_hz, round(gm * 50, 6) as isi_mean_ms, round(sqrt(greatest(0, gq - gm * gm)) / gm, 6) as isi_cv,
round(case when pulses > 0 then am end, 6) as amp_mean, round(case when pulses > 0 then sqrt(greatest(0, aq - am * am)) end, 6) as amp_std, cast(used as integer) as channels_used, evenness,
case when evenness is null then null when 100 * evenness >= 85 then 'A+' when 100 * evenness >= 75 then 'A' when 100 * evenness >= 60 then 'B' when 100 * evenness >= 40 then 'C' when 100 * evenness >= 20 then 'D' else 'F' end as grade,
source from m""",
}

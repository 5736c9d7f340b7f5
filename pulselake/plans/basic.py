"""Queries on scans, rates, intervals, amplitudes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rates as op
from ..operators.grid import running_sum, span
from .registry import dense_sql, register, register_raw

H = 3_600_000_000
DAY = 24 * H


def _scan(df: DataFrame) -> DataFrame:
    return df.select("spike_id", "t_us", "electrode", "mea", F.round("amplitude", 6).alias("amplitude"))


def _filter(df: DataFrame) -> DataFrame:
    return df.where(F.col("t_us").between(10 * DAY, 20 * DAY) & F.col("electrode").isin(1, 3, 5, 7)).select("spike_id", "t_us", "electrode")


def _downsample(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Evenly spaced events by position in time order: floor(i (n - 1) / (limit - 1))."""
    placed = running_sum(df, F.lit(1), "pos").select("spike_id", (F.col("pos") - 1).alias("pos"))
    picks = df.sparkSession.range(limit).join(F.broadcast(span(df).select("n_all"))).where("n_all > 0")
    picks = picks.select(F.col("id").alias("idx"), F.expr(f"(id * (n_all - 1)) div {limit - 1}").alias("pos"))
    return placed.join(F.broadcast(picks), "pos").select("spike_id", "idx")


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


register("scan_spikes", _scan, "select spike_id, t as t_us, e as electrode, mea, round(amp, 6) as amplitude from s")
register("filter_time_electrode", _filter, f"select spike_id, t as t_us, e as electrode from s where t between {10 * DAY} and {20 * DAY} and e in (1, 3, 5, 7)")
register(
    "downsample_even", _downsample,
    """, r as (select spike_id, row_number() over (order by t, spike_id) - 1 as pos from s),
p as (select i as idx, (i * ((select n from d) - 1)) // 999 as pos from (select unnest(range(0, 1000)) as i))
select r.spike_id, p.idx from p join r on r.pos = p.pos""",
)
register("prefix_sample", lambda df: df.orderBy("t_us", "spike_id").limit(2000).select("spike_id"), "select spike_id from s order by t, spike_id limit 2000")
register_raw("json_props", _props, "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
register_raw("event_type_counts", _type_counts, "select event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1")
register("firing_rates", lambda df: op.firing_rates(df, H), f", {dense_sql(H)} select e as electrode, b as bin, n, round(n / 3600.0, 6) as rate_hz from dn")
register("mean_rates", lambda df: op.mean_rates(df, H), f"select e as electrode, count(*) as n, round(count(*) / greatest(1, ((select dur from d) + {H - 1}) // {H}) / 3600.0, 6) as mean_rate_hz from s group by 1")

ISI = """, i as (select *, t - lag(t) over (partition by e order by t, spike_id) as isi from s), p as (select *, isi / 1e6 as x from i where isi > 0)"""
register(
    "isi_stats", lambda df: op.isi_stats(df, 2_000_000),
    f"""{ISI} select e as electrode, count(*) as n_intervals, round(avg(x), 6) as mean_s, round(quantile_cont(x, 0.5), 6) as median_s, round(stddev_pop(x), 6) as std_s,
round(stddev_pop(x) / avg(x), 6) as cv, round(min(x), 6) as min_s, round(max(x), 6) as max_s, round(quantile_cont(x, 0.05), 6) as p5_s, round(quantile_cont(x, 0.95), 6) as p95_s,
count(*) filter (isi < 2000000) as violations from p group by 1""",
)
register("isi_histogram", op.isi_histogram, f"{ISI} select e as electrode, cast(floor(round(log10(cast(isi as double)), 9) * 10) as integer) as bucket, count(*) as n from p group by 1, 2")
register(
    "amplitude_stats", op.amplitude_stats,
    """, m as (select e, quantile_cont(amp, 0.5) as med from s group by 1), x as (select s.*, abs(amp - med) as dev from s join m using (e))
select e as electrode, count(*) as n, round(avg(amp), 6) as mean, round(stddev_pop(amp), 6) as std, round(quantile_cont(amp, 0.5), 6) as median, round(quantile_cont(dev, 0.5), 6) as mad,
round(min(amp), 6) as min, round(max(amp), 6) as max, round(quantile_cont(amp, 0.1), 6) as p10, round(quantile_cont(amp, 0.9), 6) as p90 from x group by 1""",
)
register(
    "amplitude_histogram", op.amplitude_histogram,
    """, m as (select e, min(amp) as lo, max(amp) as hi from s group by 1)
select e as electrode, cast(least(floor((amp - lo) / (hi - lo) * 50) + 1, 50) as integer) as bucket, count(*) as n from s join m using (e) where hi > lo group by 1, 2""",
)
register(
    "summary_electrodes", op.summary_electrodes,
    f"""{ISI}, q as (select e, avg(x) as im, stddev_pop(x) as isd from p group by 1)
select s.e as electrode, count(*) as n, round(count(*) / ((select dur from d) / 1e6), 6) as rate_hz, round(avg(amp), 6) as amp_mean, round(stddev_pop(amp), 6) as amp_std,
round(any_value(im), 6) as isi_mean_s, round(any_value(isd) / any_value(im), 6) as isi_cv, min(t) as first_us, max(t) as last_us from s left join q using (e) group by 1""",
)
register(
    "summary_population", op.summary_population,
    """, c as (select e, count(*) as n, count(*) / ((select dur from d) / 1e6) as rate from s group by 1)
select cast(sum(n) as bigint) as n_spikes, count(*) as n_electrodes, round(avg(rate), 6) as mean_rate, round(stddev_pop(rate), 6) as std_rate, round(min(rate), 6) as min_rate, round(max(rate), 6) as max_rate,
(select e from c order by n desc, e limit 1) as most_active, (select e from c order by n, e limit 1) as least_active from c""",
)
register(
    "stability_halves", op.stability_halves,
    """, c as (select e, count(*) filter (t < dur / 2) / (dur / 2e6) as a, count(*) filter (t >= dur / 2) / (dur / 2e6) as b from s cross join d group by e, dur)
select e as electrode, round(a, 6) as first_hz, round(b, 6) as second_hz, round(case when a > 0 then (b - a) / a * 100 else 0 end, 6) as change_pct from c""",
)
register("quality_snr", op.quality_snr, "select e as electrode, round(quantile_cont(abs(amp), 0.9) / quantile_cont(abs(amp), 0.1), 6) as snr from s group by 1 having count(*) > 10 and quantile_cont(abs(amp), 0.1) > 0")
register("quality_gaps", lambda df: op.quality_gaps(df, H), f", g as (select t - lag(t) over (order by t, spike_id) as gap from s) select count(*) filter (gap > {H}) as n_gaps, round(max(gap / 1e6), 6) as longest_s from g")
register("silent_electrodes", op.silent_electrodes, "select cast(x as integer) as electrode from (select unnest(range(0, (select max(e) + 1 from s))) as x) where x not in (select e from s)")
POP = f""", nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), pop as (select x.b, coalesce(c.n, 0) as n from (select unnest(range(0, (select k from nb))) as b) x
left join (select least(t // {H}, (select k from nb) - 1) as b, count(*) as n from s group by 1) c on c.b = x.b)"""
register(
    "temporal_trend", lambda df: op.temporal_trend(df, H),
    f"""{POP}, r as (select n, n / 3600.0 as rate, (b + 0.5) * 3600.0 as mid from pop)
select round(regr_slope(rate, mid) * 1e6, 6) as slope_per_ms, round(pow(corr(rate, mid), 2), 6) as r2, round(stddev_pop(rate) / avg(rate), 6) as cv, round(avg(n), 6) as mean_n from r""",
)
register("fano_factors", lambda df: op.fano_factors(df, H), f", {dense_sql(H)} select e as electrode, round(var_pop(n) / avg(n), 6) as fano from dn group by 1")
WIN = f""", k as (select (dur + {DAY - 1}) // {DAY} - 1 as k from d), w as (select g.e, x.b, coalesce(c.n, 0) / 86400.0 as rate from (select distinct e from s) g cross join (select unnest(range(0, (select k from k))) as b) x
left join (select e, t // {DAY} as b, count(*) as n from s group by all) c on c.e = g.e and c.b = x.b)"""
register(
    "homeostasis", lambda df: op.homeostasis(df, DAY),
    f"""{WIN}, y as (select *, avg(rate) over (partition by e) as mean, lag(rate) over (partition by e order by b) as back from w)
select e as electrode, round(stddev_pop(rate) / greatest(avg(rate), 0.01), 6) as cv, round(regr_slope(rate, b) * 1e6, 4) as slope_e6, count(*) filter (back < 0.5 * mean and rate > 1.3 * mean) as compensations from y group by 1""",
)
register(
    "suffering_flags", lambda df: op.suffering_flags(df, DAY),
    f"""{WIN}, y as (select *, avg(rate) over (partition by e) as mean, b >= (select k from k) // 2 as late from w),
z as (select e, count(*) filter (rate > 5 * mean) as high, count(*) filter (rate < 0.1 * mean) as low, stddev_pop(rate) / avg(rate) as cv, avg(rate) filter (not late) as a, avg(rate) filter (late) as b from y group by 1),
f as (select e, cast(high >= 3 as integer) as excited, cast(low >= 2 as integer) as silenced, cast(cv > 2 as integer) as unstable, cast(b < 0.3 * a as integer) as declining from z)
select e as electrode, excited, silenced, unstable, declining, excited + silenced + unstable + declining as n_flags from f""",
)
register(
    "health_flags", op.health_flags,
    """, c as (select e, count(*) / ((select dur from d) / 1e6) as rate from s group by 1),
p as (select round(avg(rate), 6) as m, round(stddev_pop(rate), 6) as sd, max(e) + 1 - count(*) as silent from c),
f as (select cast(m < 0.001 as integer) as low_activity, cast(sd / m > 1 as integer) as uneven, cast(silent > 0 as integer) as has_silent from p)
select *, greatest(0, 100 - 30 * low_activity - 20 * uneven - 15 * has_silent) as score from f""",
)
register(
    "rate_forecast", lambda df: op.rate_forecast(df, DAY, 5),
    f""", {dense_sql(DAY)}, r as (select e, n / 86400.0 as rate, (b + 0.5) * 86400.0 as x from dn),
f as (select e, count(*) as k, regr_slope(rate, x) as slope, regr_intercept(rate, x) as icept, regr_sxx(rate, x) as sxx, regr_syy(rate, x) as syy, regr_sxy(rate, x) as sxy, avg(x) as mx from r group by 1 having count(*) >= 3),
g as (select f.*, cast(st as integer) as step, (select dur from d) / 1e6 + st * 86400.0 as fx from f cross join (select unnest(range(0, 5)) as st)),
h as (select e, step, greatest(0, slope * fx + icept) as v, 1.96 * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (k - 2) / sxx) * sqrt(1 + 1 / k + (fx - mx) * (fx - mx) / sxx) as band from g)
select e as electrode, step, round(v, 6) as forecast, round(greatest(0, v - band), 6) as lo, round(v + band, 6) as hi from h""",
)
register(
    "spatial_entropy", lambda df: op.spatial_entropy(df, 0.0001),
    """, c as (select count(*) as n, count(*) / (select n from d) as p from s group by e), h as (select -sum(p * log2(p)) as h, count(*) as k, avg(cast(n / ((select dur from d) / 1e6) > 0.0001 as integer)) as active from c)
select round(h, 6) as entropy, round(h / greatest(log2(k), 1e-10), 6) as uniformity, round(active, 6) as active_fraction from h""",
)
register(
    "organoid_blocks", lambda df: op.organoid_blocks(df, 60_000_000),
    """, i as (select *, t - lag(t) over (partition by mea order by t, spike_id) as isi from s), j as (select *, isi < 60000000 and coalesce(lag(isi) over (partition by mea order by t, spike_id), 1::bigint << 60) >= 60000000 as onset from i),
x as (select mea, count(*) as n, count(*) filter (onset) as bursts, stddev_pop(isi) / avg(isi) as cv, count(*) / ((select dur from d) / 1e6) as rate from j group by 1),
y as (select *, 0.4 * rate / (select max(rate) from x) + 0.3 * least(bursts / 10, 1.0) + 0.3 * least(coalesce(cv, 0), 2.0) / 2 as score from x)
select mea, n, round(rate, 6) as rate_hz, bursts, round(cv, 6) as cv, round(score, 6) as score, cast(row_number() over (order by round(score, 9) desc, mea) as integer) as rank from y""",
)
register(
    "block_correlation", lambda df: op.block_correlation(df, H),
    f""", nb as (select greatest(1, (dur + {H - 1}) // {H}) as k from d), c as (select mea, least(t // {H}, (select k from nb) - 1) as b, count(*) as n from s group by all),
x as (select m.mea, y.b, coalesce(c.n, 0) as n from (select distinct mea from s) m cross join (select unnest(range(0, (select k from nb))) as b) y left join c on c.mea = m.mea and c.b = y.b)
select p.mea as a, q.mea as b, round(corr(p.n, q.n), 6) as r from x p join x q on p.b = q.b and p.mea < q.mea group by 1, 2""",
)
register(
    "tracker_delta", op.tracker_delta,
    """, c as (select e, count(*) filter (t * 2 < dur) as pre, count(*) filter (t * 2 >= dur) as post from s cross join d group by e)
select e as electrode, pre, post, post - pre as change, round(case when pre > 0 then (post - pre) / pre * 100 when post > 0 then 100 else 0 end, 6) as pct from c""",
)
register(
    "center_of_activity", op.center_of_activity,
    """, c as (select e % 8 as site, count(*) as n from s group by 1), p as (select *, cast(site % 4 as double) as x, cast(site // 4 as double) as y from c), m as (select sum(n * x) / sum(n) as cx, sum(n * y) / sum(n) as cy from p)
select site, n, round(cx, 6) as cx, round(cy, 6) as cy, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6) as distance from p cross join m""",
)
register(
    "fingerprint_rates", op.fingerprint_rates,
    """, c as (select count(*) / (select n from d) as share, row_number() over (order by count(*) desc, e) as rank from s group by e)
select cast(r as integer) as rank, round(coalesce(share, 0), 6) as share from (select unnest(range(1, 9)) as r) left join c on c.rank = r""",
)

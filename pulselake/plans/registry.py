"""Named operators: each is a function of the recording with fixed query parameters and, where SQL can say it, a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.events import spikes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The recording as SQL: s (spike_id, t, e, mea, amp, event_type), d (dur, n).
BASE = """with ev as (select event_id as spike_id, epoch_us(ts) as u, cast(user_id % 32 as integer) as e, value as amp, event_type from events),
s as (select spike_id, u - (select min(u) from ev) as t, e, cast(e // 8 as integer) as mea, amp, event_type from ev),
d as (select max(t) as dur, count(*) as n from s)"""


def dense_sql(width: int, name: str = "dn") -> str:
    """CTEs of the dense counts (e, b, n) on the grid of ``width``."""
    nb = f"(select greatest(1, (dur + {width - 1}) // {width}) from d)"
    return f"""{name}_b as (select unnest(range(0, {nb})) as b),
{name}_c as (select e, least(t // {width}, {nb} - 1) as b, count(*) as n from s group by all),
{name} as (select g.e, x.b, coalesce(c.n, 0) as n from (select distinct e from s) g cross join {name}_b x left join {name}_c c on c.e = g.e and c.b = x.b)"""


def waves_sql(counts: str, key: str, low: float, high: float, name: str) -> str:
    """CTEs of the analytic signal (key, b, zr, zi), up to a factor, of the band of ``counts`` (key, b, n), by its Fourier sums."""
    return f"""{name}_n as (select max(b) + 1 as w from {counts}), {name}_k as (select k from (select unnest(range(1, (select (w + 1) // 2 from {name}_n))) as k) where 2.0 * k / (select w from {name}_n) between {low} and {high}),
{name}_f as (select {key}, k, sum(n * cos(2 * pi() * k * b / w)) as re, -sum(n * sin(2 * pi() * k * b / w)) as im from {counts} cross join {name}_k cross join {name}_n group by 1, 2),
{name} as (select {key}, b, sum(re * cos(2 * pi() * k * b / w) - im * sin(2 * pi() * k * b / w)) as zr, sum(re * sin(2 * pi() * k * b / w) + im * cos(2 * pi() * k * b / w)) as zi
from {name}_f cross join (select unnest(range(0, (select w from {name}_n))) as b) cross join {name}_n group by 1, 2)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double to a fixed number of digits."""
    return df.select([F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def register(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query on the canonical recording; ``sql`` follows BASE."""
    register_raw(name, lambda spark, sf_dir: op(spikes(spark, sf_dir)), sql and f"{BASE}\n{sql}")


def register_raw(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a registered operator by its name."""
    if name not in QUERIES:
        raise KeyError(f"unknown operator {name}; known: {', '.join(sorted(QUERIES))}")
    return QUERIES[name](spark, sf_dir)

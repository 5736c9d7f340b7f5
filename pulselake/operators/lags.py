"""Pairs of events within a reach, counted without being made.

Both sides are dealt by blocks of time as long as the reach, the right side also to
the blocks beside its own, and each task streams through its blocks in order. Within
a block the right side is sorted once and counted up by channel, so what a left event
sees between two lags is a difference of two counts: the work grows with the events,
not with their pairs, and a task holds one block and sums of channels squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Left events that look up their counts at once.
SLICE = 1 << 14
#: Looking up by instants instead of by events pays while there are so many cells an event at most.
DENSE = 30
#: A channel that is null.
NONE = -(1 << 31)

_COLUMNS = ["grp", "block", "side", "id", "mark", "t_us"]


def _dealt(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Both sides (grp, id, mark, t_us) by block, in order within each partition."""
    own = F.expr(f"(t_us - pmod(t_us, {reach})) div {reach}")
    a = left.select("grp", own.alias("block"), F.lit(0).alias("side"), "id", "mark", "t_us")
    b = right.select("grp", F.explode(F.array(*[own + k for k in (-1, 0, 1)])).alias("block"), F.lit(1).alias("side"), "id", "mark", "t_us")
    return a.unionByName(b).repartition("grp", "block").sortWithinPartitions("grp", "block")


def _side(df: DataFrame, mark: str, id: Column | None = None, grp: Column | None = None) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select((zero if grp is None else grp).alias("grp"), (zero if id is None else id.cast("long")).alias("id"), F.col(mark).cast("int").alias("mark"), "t_us").where("t_us is not null")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(grp, left, right) of every block, each side as the arrays id, mark, t_us."""

    def split(parts: list[list[np.ndarray]]) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
        grp, _, side, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        return int(grp[0]), [x[side == 0] for x in rest], [x[side == 1] for x in rest]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS]
        grp, block = cols[0], cols[1]
        cuts = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(grp)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (held[0][0][0], held[0][1][0]) != (grp[a], block[a]):
                yield split(held)
                held = []
            held.append([x[a:b] for x in cols])
    if held:
        yield split(held)


def _block_sums(left: list[np.ndarray], right: list[np.ndarray], edges: np.ndarray, waits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, e1, e2, n, s): the pairs of each left (id, channel) and right channel between each two edges, and with ``waits`` their lags' sums."""
    ids, e1, t = left
    _, mark, u = right
    zero, parts = u.min(), len(edges) - 1
    times, at = np.unique(u - zero, return_inverse=True)
    e2, place = np.unique(mark, return_inverse=True)
    count = np.bincount((at + 1) * len(e2) + place, minlength=(len(times) + 1) * len(e2)).reshape(-1, len(e2)).cumsum(0)
    order = np.lexsort((t, e1, ids))
    ids, e1, t = ids[order], e1[order], t[order] - zero
    new, same = np.ones(len(t), bool), np.zeros(len(t), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (e1[1:] != e1[:-1])
    same[1:] = ~new[1:] & (t[1:] == t[:-1])
    weight = np.diff(np.append(np.flatnonzero(~same), len(t)))  # events of one instant look up once
    ids, e1, t, new = ids[~same], e1[~same], t[~same], new[~same]
    group, keys = np.cumsum(new) - 1, np.flatnonzero(new)
    n, s = np.zeros((len(keys), len(e2), parts), np.int64), np.zeros((len(keys), len(e2), parts if waits else 0), np.int64)
    if not waits and len(keys) * len(count) <= DENSE * len(t):
        # many events see few instants: how often each group looks up each instant, times the counts there
        full, upto = count.astype(float), None
        for k, edge in enumerate(edges):
            looks = np.bincount(group * len(count) + np.searchsorted(times, t + edge), weights=weight, minlength=len(keys) * len(count))
            below, upto = upto, looks.reshape(len(keys), -1) @ full
            if k:
                n[:, :, k - 1] = np.rint(upto - below)
        return ids[keys], e1[keys], e2, n, s
    total = np.zeros_like(count)
    total[1:] = np.diff(count, axis=0) * times[:, None]
    total = total.cumsum(0)
    for a in range(0, len(t), SLICE):
        own, when, w = group[a : a + SLICE], t[a : a + SLICE, None], weight[a : a + SLICE, None]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        seen = np.searchsorted(times, when + edges)
        for k in range(parts):
            lo, hi = seen[:, k], seen[:, k + 1]
            d = count[hi] - count[lo]
            n[own[starts], :, k] += np.add.reduceat(w * d, starts, axis=0)
            if waits:
                s[own[starts], :, k] += np.add.reduceat(w * (total[hi] - total[lo] - when * d), starts, axis=0)
    return ids[keys], e1[keys], e2, n, s


def _placed(values: np.ndarray, known: dict[int, int]) -> np.ndarray:
    """Place of each value among those known, which grow."""
    return np.array([known.setdefault(v, len(known)) for v in values.tolist()])


def _counter(edges: list[int], waits: bool):
    """Sums of every block of a task, by (grp, id, e1, e2, part)."""
    bounds = np.array(edges, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, int] = {}  # channels and ids in the order in which they come
        reps: dict[int, int] = {}
        empty = lambda: [np.zeros((0, 0, 0, len(bounds) - 1), np.int64), np.zeros((0, 0, 0, len(bounds) - 1 if waits else 0))]
        sums, current = empty(), None

        def result() -> Iterator[pa.RecordBatch]:
            known = np.array(list(names), np.int32)
            for id, i in reps.items():
                if i >= len(sums[0]):
                    continue
                x, y, k = np.nonzero(sums[0][i])
                full = [np.full(len(x), v, np.int64) for v in (current, id)]
                wait = sums[1][i][x, y, k] if waits else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*full, known[x], known[y], k.astype(np.int32), sums[0][i][x, y, k], wait)], ["grp", "id", "e1", "e2", "part", "n", "s"])

        for grp, left, right in _blocks(batches):
            if grp != current:
                yield from result()
                sums, current = empty(), grp
            if not len(left[0]) or not len(right[0]):
                continue
            ids, e1, e2, n, s = _block_sums(left, right, bounds, waits)
            i, x, y = _placed(ids, reps), _placed(e1, names), _placed(e2, names)
            more = [(0, max(0, k - have)) for k, have in zip((len(reps), len(names), len(names)), sums[0].shape, strict=False)]
            if any(m for _, m in more):
                sums = [np.pad(v, [*more, (0, 0)]) for v in sums]
            for v, w in zip(sums, (n, s), strict=True):
                v[i[:, None], x[:, None], y[None, :]] += w
        yield from result()

    return run


def lag_sums(left: DataFrame, right: DataFrame, reach: int, edges: list[int], id: Column | None = None, grp: Column | None = None, waits: bool = False) -> DataFrame:
    """(grp, id, e1, e2, part, n, s): pairs of a left and a right event of other channels whose lag lies from edge ``part`` to below the next, and with ``waits`` the sum of their lags.

    Lags are at most ``reach`` on either side. ``id`` tells left events apart (replicates); both sides meet within one ``grp`` only.
    """
    a, b = (_side(x, "electrode", i, grp).where("mark is not null") for x, i in ((left, id), (right, None)))
    x = _dealt(a, b, reach).mapInArrow(_counter(edges, waits), "grp long, id long, e1 int, e2 int, part int, n long, s double")
    return x.where("e1 <> e2").groupBy("grp", "id", "e1", "e2", "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _first_other(ids: np.ndarray, times: np.ndarray, own: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Place of the first of the ordered times at or after u whose id is another than ``own``; their number if there is none."""
    at = np.searchsorted(times, u)
    while (same := (at < len(times)) & (ids[np.minimum(at, len(ids) - 1)] == own)).any() if len(times) else False:
        at = at + same
    return at


def _ordered(right: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(right[2], kind="stable")
    return [x[order] for x in right]


def _trials(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right in _blocks(batches):
            own, dose, u = left
            if not len(own):
                continue
            ids, _, t = _ordered(right)
            before, now, after = (np.searchsorted(t, u + k) for k in (-window, 0, window))
            baseline, response = now - before, after - now
            # an event that is the stimulus itself counts on neither side
            by = np.argsort(ids, kind="stable")
            lo, hi = np.searchsorted(ids[by], own), np.searchsorted(ids[by], own, "right")
            for k in range(int((hi - lo).max())):
                some = np.flatnonzero(lo + k < hi)
                dt = t[by[lo[some] + k]] - u[some]
                baseline[some] -= (dt >= -window) & (dt < 0)
                response[some] -= (dt >= 0) & (dt < window)
            at = _first_other(ids, t, own, u)
            latency = np.append(t, np.iinfo(np.int64).max)[at] - u
            none = (at >= len(t)) | (latency >= window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(dose, mask=dose == NONE), pa.array(baseline.astype(np.int64)), pa.array(response.astype(np.int64)), pa.array(latency, mask=none)], ["stim_id", "dose", "baseline", "response", "latency_us"]
            )

    return run


def _answers(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for _, left, right in _blocks(batches):
            own, _, u = left
            if not len(own):
                continue
            ids, mark, t = _ordered(right)
            for e in np.unique(mark).tolist():
                mine, when = ids[mark == e], t[mark == e]
                at = _first_other(mine, when, own, u)
                has = at < len(when)
                wait = when[at[has]] - u[has]
                wait = wait[wait < window]
                if len(wait):
                    sums = found.setdefault(e, [0, 0])
                    sums[0] += len(wait)
                    sums[1] += int(wait.sum())
        yield pa.RecordBatch.from_arrays([pa.array([None if e == NONE else e for e in found], pa.int32()), pa.array([float(x[0]) for x in found.values()]), pa.array([float(x[1]) for x in found.values()])], ["electrode", "n", "wait"])

    return run


def _stimuli(df: DataFrame, stims: DataFrame, window: int, run: Callable, schema: str) -> DataFrame:
    mark = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(NONE)).alias(c)
    left = _side(stims.select(mark("dose"), "stim_id", "t_us"), "dose", F.col("stim_id"))
    right = _side(df.where("spike_id is not null").select(mark("electrode"), "spike_id", "t_us"), "electrode", F.col("spike_id"))
    return _dealt(left.where("id is not null"), right, window).mapInArrow(run(window), schema)


def trials(df: DataFrame, stims: DataFrame, window: int) -> DataFrame:
    """(stim_id, dose, baseline, response, latency_us) of every stimulus with a time."""
    return _stimuli(df, stims, window, _trials, "stim_id long, dose int, baseline long, response long, latency_us long")


def answers(df: DataFrame, stims: DataFrame, window: int) -> DataFrame:
    """(electrode, n, wait): stimuli that a channel answers and the sum of its first latencies."""
    x = _stimuli(df, stims, window, _answers, "electrode int, n double, wait double")
    return x.groupBy("electrode").agg(F.sum("n").cast("long").alias("n"), F.sum("wait").alias("wait"))

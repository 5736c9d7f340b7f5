"""Sharding by longest-processing-time scheduling.

Rows that must stay together (by default rows of equal texts) form a group. Groups
are taken from the largest to the smallest, and each goes to the shard with the
smallest load so far, kept in a heap (ties: the smaller shard number). A row's size
is the UTF-8 bytes of its text plus ``OVERHEAD``; the law kept is ``bytes``: the sums
of sizes are near equal, up to what a single group forces.

Plan: rows are hashed once and written narrow. Groups are summed with map-side
combine and get a class, their size cut to its nine leading bits. The driver sees
only the classes (256 for each doubling of size, whatever the number of rows),
largest first, and runs the heap over them; a class of many groups of one size
moves the heap forward in one step to the loads that single steps would reach.
Its answer per class is how many groups each shard takes. Groups are numbered
within their class by a range partition and sorted runs, and take their shard by
number. Groups with at least a thousandth of all rows (a thousand at most) reach
their rows by a broadcast, all others by a shuffle on the group, so no hot group
meets in one task. Slots come from a range partition on (shard, doc_id), so a
shard of any size is numbered by many tasks.

A null text counts as an empty one: 0 bytes, crc32 0, in the group of empty texts.
A null doc_id is a row like others and comes first in its shard. Repeated rows are
all placed, each with a slot of its own. An empty table gives an empty result.
Very long texts are hashed where they lie and are never shuffled by ``assign``.
Other columns do not matter to ``assign``, whatever their names; ``write`` keeps them
but for one named like the shard column. Groups are told apart by 128 bits of hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mark, partitions, release, settled, stored

OVERHEAD = 8
#: Leading bits of a size that make its class.
CLASS_BITS = 9
#: A group with at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def _together(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def _advance(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard takes when each goes to the least loaded: all heap steps but the last few at once.

    A shard's steps happen at loads L, L + size, L + 2 size, ...; the heap takes the
    ``count`` smallest of all shards' steps. The level below which all steps fit is
    found by halving; the rest is at most one step a shard.
    """
    low, high = min(loads), max(loads) + size * (count + 1)

    def steps(level: int) -> list[int]:
        return [max(0, -((x - level) // size)) for x in loads]

    while high - low > 1:
        level = (low + high) // 2
        if sum(steps(level)) <= count:
            low = level
        else:
            high = level
    return steps(low)


def schedule(classes: Iterable[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each class (label, groups, bytes of them all), largest label first: the groups that each shard takes."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for label, groups, total in sorted(classes, reverse=True):
        size = max(1, total // groups)
        loads = [0] * shards
        for load, i in heap:
            loads[i] = load
        taken = _advance(loads, size, groups) if groups > shards else [0] * shards
        heap = [(load + n * size, i) for i, (load, n) in enumerate(zip(loads, taken, strict=True))]
        heapq.heapify(heap)
        for _ in range(groups - sum(taken)):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            taken[i] += 1
        over = total - size * groups  # what the mean's division left
        heap = [(load + (over * taken[i] // groups), i) for load, i in heap]
        heapq.heapify(heap)
        out.append((label, taken))
    return out


def _numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``number``: gapless from 0 within each value of ``by``, in the order of the other columns.

    Sorted ranges of (by, order) are written once; a range's rows of one value are
    consecutive, and a table of (range, value) pairs, no more than ranges and values
    together, says where each goes on.
    """
    spark = rows.sparkSession
    at = F.monotonically_increasing_id()  # partition in the upper bits, place within it in the lower 33
    ranged = rows.repartitionByRange(partitions(spark), by, *order).sortWithinPartitions(by, *order).withColumn("at", at)
    run = stored(ranged.withColumn("part", F.shiftright("at", 33)), "numbered")
    per = run.groupBy("part", by).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy(by, "part").collect()
    starts, before = [], {}
    for part, value, n, first in per:
        starts.append((part, value, before.get(value, 0) - first))
        before[value] = before.get(value, 0) + n
    kind = dict(rows.dtypes)[by]
    shift = spark.createDataFrame(starts, f"part long, {by} {kind}, shift long")
    return run.join(F.broadcast(shift), ["part", by]).withColumn("number", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def groups_of(rows: DataFrame, shards: int) -> DataFrame:
    """(a, b, n, shard): the shard of each group of ``rows`` (a, b, size)."""
    spark = rows.sparkSession
    sums = rows.groupBy("a", "b").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    below = F.greatest(F.lit(0), F.length(F.bin("bytes")) - CLASS_BITS)
    groups = stored(sums.withColumn("below", below).withColumn("class", F.expr("shiftleft(shiftright(bytes, below), below)")).drop("below"), "groups")
    classes = groups.groupBy("class").agg(F.count(F.lit(1)), F.sum("bytes")).collect()  # 256 rows a doubling at most
    plan = []
    for label, taken in schedule([tuple(r) for r in classes], shards):
        ends, at = [], 0
        for n in taken:
            at += n
            ends.append(at)
        plan.append((label, ends))
    ends = spark.createDataFrame(plan, "class long, ends array<long>")
    placed = _numbered(groups, "class", "a", "b").join(F.broadcast(ends), "class")  # the order of hashes mixes a class's sizes
    return placed.select("a", "b", "n", F.size(F.filter("ends", lambda e: e <= F.col("number"))).alias("shard"))


def with_shard(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (a, b, ...) with the shard of their group; hot groups come by broadcast, the others by a shuffle."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") >= max(2, total * HOT_SHARE)
    few = F.broadcast(groups.where(hot).select("a", "b", "shard"))  # 1 / HOT_SHARE groups at most
    rest = rows.join(few, ["a", "b"], "left_anti").join(groups.where(~hot).select("a", "b", "shard").hint("merge"), ["a", "b"])
    return rows.join(few, ["a", "b"]).select(*rows.columns, "shard").unionByName(rest.select(*rows.columns, "shard"))


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``."""
    since = mark()
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", *_together(F.col("text")), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "rows")
    groups = stored(groups_of(rows, shards), "shards")
    placed = _numbered(with_shard(rows, groups), "shard", "doc_id", "a", "b")
    return settled(placed.select("doc_id", "size", "text_crc32", "shard", F.col("number").alias("slot")), "placed", since)


def write(docs: DataFrame, shards: int, path: str, column: str = "shard") -> None:
    """Write all rows and columns of ``docs`` below ``path``, a directory per shard, its files in doc_id order."""
    since = mark()
    keys = _together(F.col("text"))
    text = F.coalesce("text", F.lit(""))
    groups = stored(groups_of(docs.select(*keys, (F.octet_length(text).cast("long") + OVERHEAD).alias("size")), shards), "shards")
    own = [c for c in docs.columns if c != column]
    packed = docs.select(*keys, F.struct(*own).alias("row"))  # the columns' names cannot clash with those of the groups
    out = with_shard(packed, groups).select(F.col("shard").alias(column), "row.*")
    out.repartitionByRange(partitions(docs.sparkSession), column, "doc_id").sortWithinPartitions(column, "doc_id").write.partitionBy(column).parquet(path)
    release(since)

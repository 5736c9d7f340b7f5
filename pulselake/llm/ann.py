"""Nearest neighbours by inverted lists with an adaptive dimension scan.

A bounded sample fixes the centroids of the lists; every vector goes to the list
of its nearest centroid, and a query probes the lists whose centroids are
nearest. Within a list the vectors, turned by a random rotation, are scanned in
blocks of columns. After d of D columns the partial distance of a candidate is
tested against the query's current k-th best distance r: under the hypothesis
that the distance is at most r, sqrt(D / d) times the partial distance exceeds
r (1 + EPSILON / sqrt(d)) only with small probability; such candidates are
abandoned. Those that stay get their exact distance on the original vectors.

The nearest lists come first: their k-th best distance goes along to all other
lists, so that there most candidates fall at their first block of columns. Lists
are split into parts of bounded size, so a vector that a third of all rows share is
no hot spot, and a part meets the queries that probe its list in runs of bounded
size. A query that finds fewer than k candidates in its lists probes all of them.

Vectors that are null or zero, hold null or non-finite components, or have
another dimension than most, take no part, nor do rows with a null id. Rows that
repeat an id are candidates each; as a query, a repeated id asks with the smallest
of its vectors in byte order. Ties go to the smaller id. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import mark, settled, stored
from .sparse import draw, fitted

#: Vectors that the centroids are fitted on, at most about.
FIT_ROWS = 20_000
#: Vectors of a list, about; lists at most; probed lists at least, and as a share of all.
LIST_ROWS, LISTS, PROBES, PROBE_SHARE = 256, 1024, 24, 0.55
#: Nearest lists that a query probes before it knows a bound.
FIRST_PROBES = 8
#: Members of one part of a list and queries of one run, about, and members tested at once.
PART_ROWS, RUN_ROWS, STEP_ROWS = 8192, 4096, 256
COLUMNS = 16
EPSILON = 2.1


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0].as_py()) // 8 if len(column) else 1
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, max(width, 1))


def valid_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector binary of doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = table.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    usual = whole.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d = usual["d"] if usual else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["v"].flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, d) if d else np.zeros((batch.num_rows, 0))
            good = np.isfinite(x).all(1) & x.any(1)
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(good)), pa.array([r.tobytes() for r in x[good]], pa.binary())], ["id", "v"])

    return whole.where(F.size("v") == d).mapInArrow(run, "id long, v binary")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]


class ListModel:
    """Centroids and the rotation."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 10):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        different = np.unique(sample, axis=0)  # copies of one vector would take many centroids
        c = different[rng.choice(len(different), min(lists, len(different)), replace=False)]
        for _ in range(rounds):
            at = np.concatenate([_distances(different[i : i + 4096], c).argmin(1) for i in range(0, len(different), 4096)])
            n = np.bincount(at, minlength=len(c))
            total = np.stack([np.bincount(at, weights=different[:, j], minlength=len(c)) for j in range(d)], 1)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        self.centroids = c


def _scan(k: int, rotation: np.ndarray):
    schema = ["query", "id", "score"]

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = members["id"].to_numpy(), _matrix(members["v"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        turned, d = x @ rotation, x.shape[1]
        asks, y, bounds = queries["query"].to_numpy(), _matrix(queries["qv"].combine_chunks()), queries["bound"].to_numpy()
        turned_y = y @ rotation
        edges = [*range(0, d, COLUMNS), d]
        out = []
        for q, point, spun, bar in zip(asks.tolist(), y, turned_y, bounds.tolist(), strict=True):
            best, best_ids, known = np.zeros(0), np.zeros(0, np.int64), bar
            for at in range(0, len(ids), STEP_ROWS):
                live = np.arange(at, min(at + STEP_ROWS, len(ids)))
                live = live[ids[live] != q]
                part = np.zeros(len(live))
                if np.isfinite(bar):
                    for a, b in zip(edges, edges[1:], strict=False):
                        part = part + ((turned[live, a:b] - spun[a:b]) ** 2).sum(1)
                        reach = bar * bar * b / d * (1 + EPSILON / np.sqrt(b)) ** 2 if b < d else bar * bar * (1 + 1e-9)
                        stay = part <= reach
                        live, part = live[stay], part[stay]
                        if not len(live):
                            break
                if len(live):
                    near = np.sqrt(((x[live] - point) ** 2).sum(1))
                    best, best_ids = np.concatenate([best, near]), np.concatenate([best_ids, ids[live]])
                    top = np.lexsort((best_ids, best))[:k]
                    best, best_ids = best[top], best_ids[top]
                    bar = min(known, best[-1]) if len(best) == k else known
            out.append((np.full(len(best), q), best_ids, best))
        arrays = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(schema, arrays, strict=True)))

    return run


def search(table: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", probes: int = PROBES, share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark, since = table.sparkSession, mark()
    vectors = stored(valid_vectors(table, id_column, vector), "vectors")
    n = vectors.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    # different vectors by their own hash: neither a repeated id nor a repeated vector weighs more
    drawn = vectors.select("v", draw(F.col("v"), 41).alias("draw"))
    kinds = drawn.agg(F.approx_count_distinct("draw")).first()[0]
    sample = drawn.where(F.col("draw") <= int(min(1.0, FIT_ROWS / kinds) * (1 << 40))).groupBy("draw").agg(F.min("v").alias("v")).orderBy("draw").limit(FIT_ROWS)
    lists = max(1, min(LISTS, n // LIST_ROWS))
    model = fitted(sample, lambda rows: ListModel(np.stack([np.frombuffer(v, np.float64) for v in rows.v]), lists))
    lists = len(model.centroids)
    shared = spark.sparkContext.broadcast(model.centroids)  # at most LISTS vectors

    def near(first: int, last: int):
        """The lists from the first to the last nearest of each vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    d = _distances(_matrix(part["v"]), shared.value)
                    top = np.argsort(d, axis=1, kind="stable")[:, first:last].astype(np.int32)
                    rows = pa.array(np.repeat(np.arange(part.num_rows), top.shape[1]))
                    rest = [c for c in part.schema.names if c not in ("id", "v")]
                    yield pa.RecordBatch.from_arrays([pa.array(top.ravel()), *(part[c].take(rows) for c in ["id", "v", *rest])], ["list", "id", "v", *rest])

        return run

    placed = stored(vectors.mapInArrow(near(0, 1), "list int, id long, v binary"), "lists")
    parts = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))

    def probe(queries: DataFrame, first: int, last: int) -> DataFrame:
        """(query, id, score): candidates of queries (id, v, bound) in their lists from the first to the last nearest."""
        reach = stored(queries.mapInArrow(near(first, last), "list int, id long, v binary, bound double"), "probes")
        size = F.broadcast(reach.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / RUN_ROWS).cast("int").alias("runs")).join(parts, "list"))  # a row a list
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        members = placed.join(size, "list").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).withColumn("run", every("runs"))
        sent = reach.join(size, "list").withColumn("run", F.pmod(F.xxhash64("id"), F.col("runs")).cast("int")).withColumn("part", every("parts"))
        sent = sent.select(F.col("list").alias("to"), F.col("part").alias("at"), F.col("run").alias("with"), F.col("id").alias("query"), F.col("v").alias("qv"), "bound")
        return members.groupBy("list", "part", "run").cogroup(sent.groupBy("to", "at", "with")).applyInArrow(_scan(k, model.rotation), "query long, id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy("score", "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def bounds(found: DataFrame) -> DataFrame:
        return found.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("bound"))

    def go(queries: DataFrame, found: DataFrame, first: int, last: int) -> DataFrame:
        """The best of found and of the further lists, which get the k-th best distance along."""
        known = queries.join(bounds(found), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        return stored(ranked(found.select("query", "id", "score").unionByName(probe(known, first, last))), "found")

    width = min(lists, max(probes, int(np.ceil(share * lists))))
    asked = stored(vectors.where(F.pmod(F.col("id"), F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")), "asked")
    start = min(FIRST_PROBES, width)
    found = stored(ranked(probe(asked.withColumn("bound", F.lit(float("inf"))), 0, start)), "found")
    if start < width:
        found = go(asked, found, start, width)
    if width < lists:
        short = stored(asked.join(bounds(found), "id", "left_anti"), "short")
        if not short.isEmpty():
            own = found.join(short.select(F.col("id").alias("query")), "query", "left_semi")
            found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(go(short, own, width, lists).select(*found.columns))
    return settled(found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "nearest", since)

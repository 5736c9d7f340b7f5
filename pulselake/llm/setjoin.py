"""Exact Jaccard self-join of word-shingle sets with a token-group matrix.

Words are runs without ASCII white space, A-Z in lower case; a document's set
holds its distinct ``width``-word shingles (64-bit hashes), with fewer words the
whole sequence. Two documents link if |A and B| * 100 >= percent * |A or B|.

1. Documents with equal sets are one class; only classes are compared.
2. Similar classes go to one group (equal minimum of a second hash), split by a
   salt into blocks of bounded size.
3. Matrix: which block holds which token, kept for the rarest tokens of each set
   only. Of two linked sets of n tokens at most, the n - ceil(t n) + l rarest of
   either share l at least, in any common order; so a class whose rarest tokens
   meet a block's union in fewer than l tokens has no link there. Tokens of many
   documents come last in that order.
4. A query that may link is sent to the block, first as a sketch alone: the parities
   of its tokens by hash, a bit a token or more. Two sketches differ in no more bits
   than the sets in tokens, so one that differs from all members by more than a link
   allows has no link there. For the others the texts follow; |query and union| is
   bound over the whole sets, and only a qualifying block is opened: exact overlaps
   with all its members by an inverted index.
5. Links only matter between components, so a first round compares within blocks
   and between neighbours of one group. In the second round a large component has
   blocks of its own and only smaller ones query them; small components of a
   group share blocks, which small components query. A group that the first round
   compared whole is not asked by its own classes again.

Nothing is capped: a block that many queries reach is copied for runs of them.
Null and empty texts, and those without a word, have an empty set and no link. A
null doc_id is a document of its own row. Rows that repeat a doc_id are compared
each, and each has the component of its own text; ``keep_one`` decides per text too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import even_labels, mark, settled, stored
from .text import Words, mix, shingle_sets, slices

#: Members of a block and queries that meet one copy of it, about; and the shingles of either, which bound their texts' bytes.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
QUERIES, QUERY_SHINGLES = 2048, 4 << 20
#: Bits of a sketch at least.
SKETCH_BITS = 64
#: Classes of a component that shares its blocks with others, at most.
SMALL = 8
#: One text in COUNTED, by its hash, counts for the list of frequent tokens: those of FREQUENT of these classes at least, the most frequent ones.
COUNTED = 16
FREQUENT = 4
FREQUENT_TOKENS = 1 << 16

_ALT = np.uint64(0xA0761D6478BD642F)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _class_of(s: np.ndarray) -> int:
    """64-bit identity of a set, from two independent sums and the size."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _ALT).sum(dtype=np.uint64)
    both = np.array([a], np.uint64) ^ (np.array([b], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))
    return int(_signed(mix(both))[0])


def _lead(n: int, percent: int) -> tuple[int, int]:
    """Length of the prefix and tokens that linked prefixes share at least."""
    share = 1 + n // 32
    return min(n, n - -(-percent * n // 100) + share), share


def _describe(width: int):
    """One row per document, with its ``row`` where it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(Words(part["text"]), width)
                rows = [part["doc_id"], [len(s) for s in sets], [_class_of(s) for s in sets], [int(_signed(mix(s ^ _ALT).min(keepdims=True))[0]) if len(s) else 0 for s in sets]]
                tag = [part["row"]] if "row" in part.schema.names else []
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows), *tag], ["doc_id", "n", "cid", "g"] + ["row"] * len(tag))

    return run


def _prefixes(width: int, percent: int, labels: list[int], shared):
    """Rarest tokens of each set with the set's class, sorted into hash ranges with the given labels; bucket null holds frequent tokens."""
    buckets = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = shared.value
        for batch in batches:
            for part in slices(batch):
                tokens, classes, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], set()
                heavy_tokens, heavy_classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for s in shingle_sets(Words(part["text"]), width):
                    if not len(s) or (cid := _class_of(s)) in seen:
                        continue
                    seen.add(cid)
                    size, _ = _lead(len(s), percent)
                    at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
                    heavy = often[at] == s if len(often) else np.zeros(len(s), bool)
                    light = s[~heavy][:size]
                    tokens.append(light)
                    classes.append(np.full(len(light), cid))
                    if len(light) < size:
                        rest = np.flatnonzero(heavy)
                        rest = rest[np.argsort(rank[at[rest]], kind="stable")][: size - len(light)]
                        heavy_tokens.append(s[rest])
                        heavy_classes.append(np.full(len(rest), cid))
                t, c = np.concatenate(tokens), np.concatenate(classes)
                order = np.argsort(t, kind="stable")
                t, c = t[order], c[order]
                place = (t >> np.uint64(32)).astype(np.int64) * buckets >> 32
                edges = np.searchsorted(place, np.arange(buckets + 1))
                out = [(labels[b], t[x:y].tobytes(), c[x:y].tobytes()) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
                t, c = np.concatenate(heavy_tokens), np.concatenate(heavy_classes)
                if len(t):
                    out.append((None, t.tobytes(), c.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "tokens", "classes"])

    return run


def _pairs(part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    token = np.frombuffer(b"".join(part["tokens"].to_pylist()), np.int64)
    return token, np.frombuffer(b"".join(part["classes"].to_pylist()), np.int64)


def _shared_tokens(table: pa.Table) -> pa.Table:
    """(token, cid) of the tokens of one hash range that two classes hold at least."""
    token, cid = _pairs(table)
    order = np.lexsort((cid, token))
    token, cid = token[order], cid[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
    token, cid = token[new], cid[new]
    same = token[1:] == token[:-1]
    keep = np.zeros(len(token), bool)
    keep[1:] |= same
    keep[:-1] |= same
    return pa.table({"token": token[keep], "cid": cid[keep]})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        token, cid = _pairs(part)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(cid)], ["token", "cid"])


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the set's tokens by their low bits; a power of two of bits, as many as tokens at least."""
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches of ``size`` bytes of the same sets; rows are sketches of one larger size or the same."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, size), axis=1)


def _own(width: int):
    """Rows whose text has the class they are joined with, and its sketch; a repeated doc_id brings others too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(Words(part["text"]), width)
                part = part.append_column("sketch", pa.array([_sketch(s) for s in sets], pa.binary()))
                yield part.filter(pa.array(np.array([_class_of(s) for s in sets], np.int64) == part["cid"].to_numpy()))

    return run


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _sets_of(table: pa.Table, width: int) -> list[np.ndarray]:
    out = []
    for batch in table.select(["text"]).combine_chunks().to_batches():
        for part in slices(batch):
            out += shingle_sets(Words(part["text"]), width)
    return out


def _open_groups(width: int, percent: int):
    """Exact links between the queries and the members of one block; a spanning set of them is enough."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        sets, own = _sets_of(members, width), members["cid"].to_numpy()
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        owner = owner[order]
        union, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        forest, found = _Forest(), []
        for cid, q in zip(queries["asks"].to_pylist(), _sets_of(queries, width), strict=True):
            n = len(q)
            at = np.minimum(np.searchsorted(union, q), max(len(union) - 1, 0))
            at = at[union[at] == q] if len(union) else at[:0]
            if not n or 100 * len(at) < percent * n:  # the union's overlap bounds that of each member
                continue
            reach = np.arange(int(count[at].sum())) + np.repeat(first[at] - (np.cumsum(count[at]) - count[at]), count[at])
            common = np.bincount(owner[reach], minlength=len(sets))
            for i in np.flatnonzero(100 * common >= percent * (n + size - common)):
                if own[i] != cid and forest.tie(cid, int(own[i])):
                    found.append((cid, int(own[i])))
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return run


def _may_link(percent: int):
    """The queries whose sketch allows a link with a member of one block."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        held, sizes = [np.frombuffer(x, np.uint8) for x in members["sketch"].to_pylist()], members["n"].to_numpy()
        lengths = np.array([len(x) for x in held], np.int64)
        of = {int(k): (np.stack([held[i] for i in np.flatnonzero(lengths == k)]), sizes[lengths == k]) for k in np.unique(lengths)}
        found = {}
        for cid, sketch, n in zip(*(queries[c].to_pylist() for c in ("asks", "sketch", "n")), strict=True):
            q = np.frombuffer(sketch, np.uint8)[None]
            for k, (x, m) in of.items():
                size = min(k, q.shape[1])
                apart = np.bitwise_count(_folded(x, size) ^ _folded(q, size)).sum(axis=1, dtype=np.int64)
                # |A and B| * 100 >= percent * |A or B| with |A| + |B| = n + m
                if np.any(apart * (100 + percent) <= (m + n) * (100 - percent)):
                    found[cid] = n
                    break
        return pa.table({"cid": pa.array(list(found), pa.int64()), "block": pa.array(queries["to"].to_pylist()[:1] * len(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    return run


def _met(asked: DataFrame, members: DataFrame, of: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the members (cid, block) of each block and what asks it (cid, block, n), both with the columns of ``of`` (cid, ...)."""
    of = of.hint("merge")  # the same plan at every size
    runs = asked.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / QUERIES, F.sum("n") / QUERY_SHINGLES)).cast("int").alias("runs"))
    told = [F.col(x).alias(x) for x in of.columns if x != "cid"]
    queries = asked.select("cid", "block").join(runs, "block").withColumn("run", F.pmod(F.xxhash64("cid"), F.col("runs")).cast("int")).join(of, "cid").select(F.col("block").alias("to"), F.col("run").alias("part"), F.col("cid").alias("asks"), *told)
    held = members.join(runs, "block").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs").join(of, "cid")
    return held.groupBy("block", "run").cogroup(queries.groupBy("to", "part")).applyInArrow(run, schema)


def _links(asked: DataFrame, members: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of asked (cid, block, n) in members (cid, block)."""
    return _met(asked, members, held.select("cid", "text"), _open_groups(width, percent), "u long, v long")


def _blocks(classes: DataFrame, *keys: str) -> DataFrame:
    """(cid, n, keys, block, salt, salts): blocks of about BLOCK classes and BLOCK_SHINGLES shingles of one group."""
    groups = classes.groupBy(*keys).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("salts"))
    salted = classes.join(groups, list(keys)).withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("salts")).cast("int"))
    return salted.withColumn("block", F.xxhash64(*keys, "salt"))


def _assigned(docs: DataFrame, width: int, percent: int, *tag: str) -> DataFrame:
    """(doc_id, n, cid, component) of every row; with the tag "row" also the hash of its text."""
    spark, since = docs.sparkSession, mark()
    texts = docs.select("doc_id", "text")
    tagged = texts.select("*", *[F.xxhash64("text").alias(x) for x in tag])
    rows = stored(tagged.mapInArrow(_describe(width), ", ".join(["doc_id long, n long, cid long, g long", *[f"{x} long" for x in tag]])), "sets")

    labels, packs = even_labels(spark), "bucket int, tokens binary, classes binary"
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    counted = texts.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).mapInArrow(_prefixes(width, 0, labels, none), packs)  # of percent 0 the prefix is the set
    often = counted.groupBy("bucket").applyInArrow(_shared_tokens, "token long, cid long").groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= FREQUENT)
    top = often.orderBy(F.desc("docs"), "token").limit(FREQUENT_TOKENS).toPandas()
    often, rank = top.token.to_numpy(np.int64).view(np.uint64), top.docs.to_numpy(np.int64)
    order = np.argsort(often)
    shared = spark.sparkContext.broadcast((often[order], rank[order]))  # at most FREQUENT_TOKENS pairs of longs

    here = mark()
    packed = stored(texts.mapInArrow(_prefixes(width, percent, labels, shared), packs), "prefixes")
    light = packed.where("bucket is not null").groupBy("bucket").applyInArrow(_shared_tokens, "token long, cid long")
    heavy = packed.where("bucket is null").mapInArrow(_unpack, "token long, cid long").distinct()
    matrix = settled(light.unionByName(heavy), "matrix", here)  # the prefixes go

    sized = rows.where("n > 0").groupBy("cid", "n", "g").agg(F.min("doc_id").alias("doc_id"))
    # a set with a link shares so many of its rarest tokens with the other, which has percent of its size at least
    met = matrix.groupBy("cid").agg(F.count(F.lit(1)).alias("met"))
    classes = stored(sized.join(met, "cid").where(F.col("met") >= 1 + F.floor(F.col("n") * percent / 100 / 32)).drop("met"), "classes")
    one = texts.where("text is not null").join(classes.select("cid", "doc_id", "n").hint("merge"), "doc_id")
    held = stored(one.select("cid", "n", "text").mapInArrow(_own(width), "cid long, n long, text string, sketch binary"), "texts")

    # first round: within blocks, and the next block of the same group
    blocks = stored(_blocks(classes, "g"), "blocks")
    whole = F.when(F.col("salts") <= 3, F.col("g")).alias("whole")  # every block of the group meets every other
    several = blocks.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g")
    inside = blocks.join(several, "g", "left_semi")
    after = F.xxhash64("g", F.pmod(F.col("salt") + 1, F.col("salts")).cast("int"))
    asked = inside.select("cid", "block", "n").unionByName(inside.where("salts > 1").select("cid", after.alias("block"), "n"))
    first = stored(_links(asked, inside.select("cid", "block"), held, width, percent), "first")

    # second round: between components
    known = components(first)
    named = blocks.select("cid", "n", "g", whole).join(known.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    weight = named.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    # a large component has blocks of its own; small ones of one group share blocks, so that many of them are few blocks
    named = named.join(weight, "component").withColumn("at", F.when(F.col("weight") > SMALL, F.col("component")))
    again = stored(_blocks(named.withColumn("at", F.coalesce("at", F.lit(0))).withColumn("large", F.col("weight") > SMALL), "g", "at", "large"), "blocks")
    lead = F.lit(1) + F.floor(F.col("n") / 32)
    about = again.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min(lead).alias("lead"), F.first("at").alias("at"), F.first("large").alias("large"), F.max("weight").alias("at_weight"), F.first("whole").alias("there"))
    rare = matrix.join(again.select("cid", "n", "block", "component", "weight", "whole"), "cid")
    rows_of = rare.select("token", "block").distinct().join(about, "block")
    smaller = (F.col("weight") < F.col("at_weight")) | ((F.col("weight") == F.col("at_weight")) & (F.col("component") < F.col("at")))
    asks = F.when(F.col("large"), smaller).otherwise(F.col("weight") <= SMALL)
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100)
    new = F.coalesce(F.col("whole") != F.col("there"), F.lit(True))
    met = rare.drop("block").join(rows_of, "token").where(asks & fits & new).groupBy("cid", "block", "n", "lead").agg(F.count(F.lit(1)).alias("common"))
    asked = stored(met.where(F.col("common") >= F.least(lead, F.col("lead"))).select("cid", "block", "n"), "asked")
    close = stored(_met(asked, again.select("cid", "block"), held.select("cid", "n", "sketch"), _may_link(percent), "cid long, block long, n long"), "close")
    second = stored(_links(close, again.select("cid", "block"), held, width, percent), "second")

    final = components(first.unionByName(second)).withColumnRenamed("node", "cid")
    named = rows.select("doc_id", "n", "cid", *tag).join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    return settled(named, "assigned", since)


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the smallest doc_id names a component."""
    of = _assigned(docs, width, percent)
    name = of.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = of.join(name, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without those that another row of their component stands for.

    The row with the smallest doc_id stands for a component, of several the one with
    the smallest hash of the text, of equal ones any. Rows without a word or a doc_id stay.
    """
    of = _assigned(docs, width, percent, "row").where("n > 0 and doc_id is not null")
    stands = of.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    lost = of.join(stands, "component").where(F.struct("doc_id", "row") != F.col("first")).select("doc_id", "row").distinct()
    twice = stored(of.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "row"), "twice")

    def at(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.withColumnsRenamed({"doc_id": "__doc", "row": "__row"})
        return docs.join(keys, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__row")), how).select(*docs.columns)

    if twice.isEmpty():
        return at(lost, "left_anti")
    once = at(twice.join(lost, ["doc_id", "row"], "left_anti"), "left_semi").dropDuplicates(["doc_id", "text"])
    return at(lost.unionByName(twice).distinct(), "left_anti").unionByName(once)

"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits in lower case. A document's window for a
benchmark item has as many words as the item; a document with fewer words is one
window, the whole of it. The weighted shingles of a window
or item are its distinct 5-word shingles with their counts (with fewer than five
words, the whole sequence is the one shingle). The similarity of the two is
sum(min of counts) / sum(max of counts); ``min_similarity`` or more is a leak.

Plan, all in DataFrame functions:

1. Windows. Every start counts, wherever the shared shingles stand in the item.
   Similarity t of a window of w shingles and an item of p needs t (w + p) / (1 + t)
   shared ones, so a window is laid at each start that covers so many positions
   with a shingle of the items of that size; all others are below t. The item
   shingles reach the scan as a broadcast only below ``BROADCAST_ITEMS`` rows, by
   a shuffled join beyond.
   Only documents with a window are read for their texts again: their ids are
   sent to the scan below ``BROADCAST_ITEMS`` (a shuffled join beyond), so the
   texts of the others are neither shuffled nor sorted. ``clean`` drops the
   leaked documents the same way.
2. Fingerprints. Each window and item gets the 64-bit SimHash of its weighted
   shingles, with the 64 vote counters packed into the lanes of longs.
   Fingerprints of all windows of all item sizes would be 64 counters at each word
   and size; and at this similarity no block is selective (two random fingerprints
   agree in some block of two or three bits almost always), so every window would
   meet every item. Step 1 leaves out only windows below t, by an exact bound.
3. Multi-index blocks. Fingerprints are cut into RADIUS + 1 blocks; two that
   differ in RADIUS bits at most agree in one block, so joining on (size, block
   number, block bits) finds every window and item within the radius.
4. Exact weighted-shingle similarity decides.

Null and empty texts, documents and items alike, take part in nothing, nor does
a null doc_id or item_id. Repeated rows give one result row. Ties between
windows go to the first. With an empty table on either side nothing leaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, stored

WIDTH = 5
MIN_SIMILARITY = 0.8
#: Hamming radius. At similarity 0.8 the two share 8/9 of their weight, so a bit differs with chance acos(8/9) / pi = 0.15:
#: 9.7 of 64 bits, with a deviation of 2.9, and more than 24 in less than one of 100,000 such windows.
RADIUS = 24
#: Shingle rows of the benchmark, and ids of documents, that may be broadcast (16 bytes each).
BROADCAST_ITEMS = 2_000_000

#: Two vote counters of 32 bits in a long.
_LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of shingle hashes, each occurrence with weight 1.

    Counter j of lane word k counts hashes with bit 32 j + k set; a counter holds
    more than the longest array can have.
    """
    n = F.size(hashes)
    bits = []

    def votes(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)))

    for k in range(32):
        lanes = votes(k)
        for j in range(2):
            count = F.shiftrightunsigned(lanes, 32 * j).bitwiseAND(F.lit(0xFFFFFFFF))
            bits.append(F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("long"), 32 * j + k)).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def numbered(hashes: Column) -> Column:
    """The hashes, with each repetition as a hash of its own: what two arrays share by weight are then their common elements."""
    before = lambda h, i: F.size(F.filter(F.slice(hashes, 1, i), lambda y: y == h))
    apart = F.transform(hashes, lambda h, i: F.when(before(h, i) == 0, h).otherwise(F.xxhash64(h, before(h, i))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(apart)


def weighted_similarity(a: Column, b: Column) -> Column:
    """sum(min of counts) / sum(max of counts) of two arrays of shingle hashes that are ``numbered``.

    A join evaluates it for every pair that agrees in a block, before the radius decides, so it has to be cheap.
    """
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def least_shared(a: Column, b: Column, min_similarity: float) -> Column:
    """Shingles that two sets of a and b shingles share at least, at that similarity; rounding errors go down."""
    return F.greatest(F.lit(1), F.ceil((a + b) * F.lit(min_similarity / (1 + min_similarity)) - F.lit(1e-6))).cast("int")


def _starts() -> Column:
    """Starts of all windows that cover ``need`` of the sorted positions ``hits`` at least."""
    last = F.col("length") - F.col("k")
    end = lambda i: F.get("hits", i + F.col("need") - 1)
    runs = F.transform(F.sequence(F.lit(0), F.size("hits") - F.col("need")), lambda i: F.struct(F.greatest(F.lit(0), end(i) - last).alias("a"), F.least(F.get("hits", i), F.col("n") - F.col("length")).alias("b")))
    return F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: r["a"] <= r["b"]), lambda r: F.sequence(r["a"], r["b"]))))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of each of radius + 1 blocks of a 64-bit fingerprint."""
    n = min(radius + 1, 64)
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block_keys(fingerprint: Column, radius: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, shift).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")) for i, (shift, width) in enumerate(blocks(radius))])


def items_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, n_words, k, shingles, fingerprint) of each benchmark item with words."""
    words = benchmark.where("item_id is not null and text is not null").select("item_id", words_of(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0).groupBy("item_id", "words").agg(F.count(F.lit(1)).alias("copies"))
    n = F.size("words")
    sized = words.select("item_id", n.alias("n_words"), F.least(n, F.lit(width)).alias("k"), "words")
    shingles = F.transform(F.sequence(F.lit(1), F.col("n_words") - F.col("k") + 1), lambda i: F.xxhash64(F.slice(F.col("words"), i, F.col("k"))))
    return sized.select("item_id", "n_words", "k", shingles.alias("shingles")).withColumn("fingerprint", simhash(F.col("shingles")))


def shingle_rows(texts: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, n, k, pos, h): each shingle of k words, for each k in ``widths``, of texts (doc_id, words) of n words."""
    # n is taken before the explosion: taken in it, each shingle's row would carry all words of its document
    sized = texts.withColumn("n", F.size("words"))
    return reduce(DataFrame.unionByName, [sized.select("doc_id", "n", F.lit(k).alias("k"), F.posexplode(_shingles(F.col("words"), k)).alias("pos", "h")) for k in widths])


def _ids(rows: DataFrame) -> DataFrame:
    """The doc_ids of a stored table with one row of each, broadcast up to the bound."""
    ids = rows.select("doc_id")
    return F.broadcast(ids) if rows.count() <= BROADCAST_ITEMS else ids


def leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window of each leaked item in each document, and its words."""
    items = stored(items_of(benchmark, width), "items")
    size = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("rows"), F.collect_set("k").alias("ks")).first()  # ks: 1 to width
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", words_of(F.col("text")).alias("words"))

    # 1. starts of the windows that hold enough shingles of the items of one size
    rows = shingle_rows(texts, sorted(size["ks"]) or [width])
    probes = items.select("k", "n_words", F.explode("shingles").alias("h")).distinct()
    probes = F.broadcast(probes) if size["rows"] <= BROADCAST_ITEMS else probes
    hits = rows.join(probes, ["k", "h"]).groupBy("doc_id", "n", "k", "n_words").agg(F.sort_array(F.collect_set("pos")).alias("hits")).withColumn("length", F.least("n", "n_words"))
    bound = hits.withColumn("need", least_shared(F.col("length") - F.col("k") + 1, F.col("n_words") - F.col("k") + 1, min_similarity)).where(F.size("hits") >= F.col("need"))
    laid = bound.select("doc_id", F.transform(_starts(), lambda s: F.struct("n", "k", "n_words", "length", s.alias("start"))).alias("laid"))
    spots = stored(laid.groupBy("doc_id").agg(F.flatten(F.collect_list("laid")).alias("spots")), "spots")

    # 2. those windows, and their fingerprints; rows that repeat a doc_id are told apart by their size
    some = docs.where("text is not null").select("doc_id", "text").join(_ids(spots), "doc_id", "left_semi").repartition(partitions(docs.sparkSession), "doc_id")
    held = some.join(spots.hint("shuffle_hash"), "doc_id").select("doc_id", words_of(F.col("text")).alias("words"), "spots")
    fit = F.filter("spots", lambda s: s["n"] == F.size("words"))
    one = held.select("doc_id", F.explode(F.transform(fit, lambda s: s.withField("words", F.slice("words", s["start"] + 1, s["length"])))).alias("s"))
    count = F.col("s.length") - F.col("s.k") + 1
    shingles = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(F.col("s.words"), i, F.col("s.k"))))
    windows = one.select("doc_id", F.col("s.start").alias("start"), F.col("s.n_words").alias("n_words"), F.col("s.length").alias("length"), shingles.alias("window"))
    windows = windows.withColumn("print", simhash(F.col("window"))).withColumn("window", numbered(F.col("window")))

    # 3. candidates within the radius, by blocks; 4. the exact similarity of those
    left = windows.withColumn("key", F.explode(_block_keys(F.col("print"), radius)))
    right = items.withColumn("shingles", numbered(F.col("shingles"))).withColumn("key", F.explode(_block_keys(F.col("fingerprint"), radius)))
    right = F.broadcast(right) if size["rows"] * (radius + 1) <= BROADCAST_ITEMS else right
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint")))
    first = F.array_min(F.array(*[F.when(F.shiftrightunsigned(F.col("print").bitwiseXOR(F.col("fingerprint")), s).bitwiseAND(F.lit((1 << w) - 1)) == 0, F.lit(i)) for i, (s, w) in enumerate(blocks(radius))]))
    near = left.join(right, ["n_words", "key"]).where((apart <= radius) & (F.col("key.block") == first))
    scored = near.select("doc_id", "item_id", "start", F.col("length").alias("n_words"), weighted_similarity(F.col("window"), F.col("shingles")).alias("similarity"))
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start")))
    found = scored.where(F.col("similarity") >= min_similarity).groupBy("doc_id", "item_id").agg(best.alias("b"))
    found = found.repartition("item_id", "doc_id")  # few rows, which few tasks write, not those that hold the windows
    return found.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    found = stored(leaks(docs, benchmark, **parameters).select("doc_id").distinct(), "leaked")
    return docs.join(_ids(found), "doc_id", "left_anti").select(*docs.columns)

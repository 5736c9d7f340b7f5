"""Line deduplication by range-partitioned line hashes.

A line's key is the line without the ASCII white space at both ends, A-Z in lower
case. A key of at least ``min_chars`` code points that occurs in at least
``min_docs`` documents loses all its lines, but for those in the document with
the largest doc_id that holds it.

Plan: each long line yields a row (128-bit hash of its key, document, position).
The rows are dealt by range of (hash, document), so a key of a third of all
documents spreads over many tasks, and sorted within each range by hash,
document and position. One pass over the sorted run streams the first occurrence
of each key in each document; the first occurrences are counted per range before
the ranges of one key meet. The verdict on a key goes back to the ranges that hold
it, so that a hot key's rows are joined range by range, never all in one task.
What is returned per document is a compressed keep bitmap: the lengths of the runs
of kept lines before each dropped one. The text never enters those shuffles;
``deduplicate`` applies the bitmaps in one pass over a document's lines.

Only DataFrame functions are used. A null or empty text is one empty line. A null
doc_id takes part in no count and keeps all its lines. Rows that repeat a doc_id
count as one document. An empty table gives an empty result. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import mark, partitions, settled, stored

MIN_CHARS = 20
MIN_DOCS = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, doc_id, row, pos): hash of each long line's key and where it stands; row tells rows of one doc_id apart."""

    def of(line: Column, pos: Column) -> Column:
        return F.struct(key_of(line).alias("key"), pos.alias("pos"))

    long = F.filter(F.transform(lines_of(F.col("text")), of), lambda x: F.length(x["key"]) >= min_chars)
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")  # hashed once, not once a line
    rows = texts.select("doc_id", "row", F.explode(long).alias("x"))
    return rows.select(F.xxhash64("x.key").alias("a"), F.xxhash64(F.lit(1), "x.key").alias("b"), "doc_id", "row", "x.pos")


def sorted_runs(occ: DataFrame) -> DataFrame:
    """The occurrences in sorted ranges: with the number of the range, and whether it is the key's first in its document."""
    run = occ.repartitionByRange(partitions(occ.sparkSession), "a", "b", "doc_id").sortWithinPartitions("a", "b", "doc_id", "pos")
    before = F.lag("pos").over(Window.partitionBy("a", "b", "doc_id").orderBy("pos"))  # the ranges keep each document's lines of a key together
    return run.withColumn("first", before.isNull()).withColumn("range", F.spark_partition_id())


def repeated_keys(runs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(range, a, b, keeper): keys in at least ``min_docs`` documents, for each range that holds them, and the last document that does."""
    per_range = runs.where("first").groupBy("range", "a", "b").agg(F.count("pos").alias("n"), F.max("doc_id").alias("keeper"))
    per_key = per_range.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return per_range.select("range", "a", "b").join(per_key.where(F.col("n") >= min_docs).select("a", "b", "keeper"), ["a", "b"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, n_dropped, keep_runs): the lengths of the runs of kept lines before each dropped one.

    ``row`` is the hash of the text, which tells rows of one doc_id apart. Documents
    that lose no line have no row; after the last dropped line all others stay.
    """
    since = mark()
    occ = stored(occurrences(docs, min_chars), "lines")
    runs = settled(sorted_runs(occ), "runs", since)
    hit = runs.join(repeated_keys(runs, min_docs).hint("merge"), ["range", "a", "b"]).where("doc_id <> keeper")
    held = hit.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    # no array is named within a lambda, where it would be made again for each element
    gaps = F.zip_with("dropped", F.slice(F.concat(F.array(F.lit(-1)), "dropped"), 1, F.size("dropped")), lambda p, before: p - before - 1)
    return settled(held.select("doc_id", "row", F.size("dropped").alias("n_dropped"), gaps.alias("keep_runs")), "bitmaps", since)


def kept_text(lines: Column, keep_runs: Column) -> Column:
    """The kept lines joined by newlines, in one pass: the runs become one mark a line, and marked lines go."""
    marks = F.flatten(F.transform(keep_runs, lambda r: F.concat(F.array_repeat(F.lit(False), r), F.array(F.lit(True)))))
    return F.array_join(F.zip_with(lines, marks, lambda x, gone: F.when(~F.coalesce(gone, F.lit(False)), x)), "\n")


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with all their columns; text without the dropped lines, and n_lines, n_dropped, keep_runs.

    A text that loses no line, null included, stays as it is.
    """
    bits = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "__doc", "row": "__row", "n_dropped": "__dropped", "keep_runs": "__runs"})
    at = (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__row"))
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "keep_runs")]
    return docs.join(bits.hint("merge"), at, "left").select(  # the same plan at every size
        *own,
        F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(kept_text(lines_of(F.col("text")), F.col("__runs"))).alias("text"),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("__runs", F.array().cast("array<int>")).alias("keep_runs"),
    )

"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mark, settled, stored


def _small_star(e: DataFrame) -> DataFrame:
    """Rows (u, v) with v < u: everything smaller beside u is tied to the smallest of it."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Everything larger beside u is tied to the smallest of u and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link (u, v) to another; the smallest node names a component.

    The number of rounds grows with the logarithm of the longest path. Each round
    is written to the shared folder, so nothing is computed twice and no link
    comes to the driver. Null ends and links of a node to itself count for nothing.
    """
    since = mark()
    e = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    before = e.agg(digest.alias("m")).first()["m"]
    while before["n"]:
        e = settled(_small_star(_large_star(e)), "links", since)  # the round before is not read again
        now = e.agg(digest.alias("m")).first()["m"]
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

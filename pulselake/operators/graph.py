"""Graph metrics of the channel network, from an edge table (e1, e2, r) with e1 < e2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import over, r6


def _both(edges: DataFrame) -> DataFrame:
    w = F.abs("r").alias("w")
    return edges.select(F.col("e1").alias("u"), F.col("e2").alias("v"), w).unionByName(edges.select(F.col("e2").alias("u"), F.col("e1").alias("v"), w))


def node_degree(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy(F.col("u").alias("electrode")).agg(F.count(F.lit(1)).alias("degree"), r6(F.sum("w")).alias("strength"))


def mea_density(edges: DataFrame, nodes: DataFrame, per_mea: int = 8) -> DataFrame:
    """Edges within and across blocks over the possible ones."""
    same = F.expr(f"e1 div {per_mea} = e2 div {per_mea}")
    n = edges.agg(F.count_if(same).alias("within"), F.count_if(~same).alias("across"))
    m = nodes.select("electrode").distinct().groupBy(F.expr(f"electrode div {per_mea}").alias("g")).agg(F.count(F.lit(1)).alias("k"))
    p = m.agg(F.sum(F.expr("k * (k - 1) div 2")).alias("pw"), F.expr("sum(k) * (sum(k) - 1) div 2").alias("all"))
    return n.join(p).select("within", "across", r6(over("within", "pw")).alias("density_within"), r6(over("across", F.col("all") - F.col("pw"))).alias("density_across"))


def triad_census(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triads with three, two (middle node smallest: star, else chain) and one edge; from degrees and wedges, not all triples.

    The edge table, channels squared at most, is computed once and becomes one row;
    each edge then looks up the neighbours of its ends in it.
    """
    every = edges.agg(F.collect_list(F.struct("e1", "e2")).alias("all"))
    x = every.select("all", F.explode("all").alias("e"))
    others = lambda end: F.transform(F.filter("all", lambda y: (y["e1"] == F.col(end)) | (y["e2"] == F.col(end))), lambda y: y["e1"] + y["e2"] - F.col(end))
    x = x.withColumn("a", others("e.e1")).withColumn("b", others("e.e2"))
    rising = F.size(F.filter("all", lambda y: y["e1"] == F.col("e.e1")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    # a triangle is met by its three edges, a wedge by its two
    t = x.agg(
        (zero(F.size(F.array_intersect("a", "b"))) / 3).cast("long").alias("triangle"), (zero(rising - 1) / 2).cast("long").alias("open_low"), (zero(F.size("a") + F.size("b") - 2) / 2).cast("long").alias("wedges"),
        F.count(F.lit(1)).alias("m"),
    )
    x = t.join(nodes.select("electrode").distinct().agg(F.count(F.lit(1)).alias("n")))
    star, chain = F.col("open_low") - F.col("triangle"), F.col("wedges") - F.col("open_low") - 2 * F.col("triangle")
    single = F.col("m") * (F.col("n") - 2) - 2 * (star + chain) - 3 * F.col("triangle")
    return x.select("triangle", chain.alias("chain"), star.alias("star"), single.alias("single_edge"), r6(over(F.col("m") * 2, F.col("n") * (F.col("n") - 1))).alias("density"))


def rich_club(edges: DataFrame) -> DataFrame:
    """Density among the nodes of degree k or more, for each degree that occurs."""
    d = node_degree(edges).select("electrode", "degree")
    k = d.select(F.col("degree").alias("k")).distinct()
    n = k.join(d, F.col("degree") >= F.col("k")).groupBy("k").agg(F.count(F.lit(1)).alias("nodes")).where("nodes >= 2")
    e = edges.join(d.select(F.col("electrode").alias("e1"), F.col("degree").alias("d1")), "e1").join(d.select(F.col("electrode").alias("e2"), F.col("degree").alias("d2")), "e2")
    m = k.join(e, F.least("d1", "d2") >= F.col("k")).groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, "k", "left").select("k", "nodes", r6(F.coalesce("m", F.lit(0)) * 2 / (F.col("nodes") * (F.col("nodes") - 1))).alias("phi"))


def clustering(edges: DataFrame) -> DataFrame:
    """Binary clustering coefficient of the nodes with two neighbours or more."""
    b = _both(edges).select("u", "v")
    pairs = b.join(b.select(F.col("u").alias("u"), F.col("v").alias("w")), "u").where("v < w")
    closed = pairs.join(edges.select(F.col("e1").alias("v"), F.col("e2").alias("w"), F.lit(1).alias("hit")), ["v", "w"], "left")
    return closed.groupBy(F.col("u").alias("electrode")).agg(r6(F.avg(F.coalesce("hit", F.lit(0)))).alias("clustering"))

"""Connected components of a graph in a table, by alternating large-star and small-star steps.

Each step is a minimum by node (partial aggregates first) and a plain equi-join of two written tables, so a node with very many edges is
pre-aggregated in one and split by AQE in the other. The edges shrink to stars within a number of rounds that grows with the logarithm of
the largest component; every step is written, so a lost executor repeats one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", slim=True)
    out = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large", slim=True)
    drop(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node u to the smaller one v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least", slim=True)
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", slim=True)
    drop(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (x, y: long); the component is its least node. Loops and repeated links don't matter."""
    high, low = F.greatest("x", "y"), F.least("x", "y")
    edges = written(links.where("x <> y").select(high.alias("u"), low.alias("v")).distinct(), "edges", slim=True)
    mark = _mark(edges)
    while mark[0]:
        large = _large(edges)
        drop(edges)
        edges = _small(large)
        drop(large)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

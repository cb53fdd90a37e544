"""Connected components of undirected links, by alternating large and small stars.

Each round links the larger neighbours of every node to its smallest one, then its smaller neighbours, until nothing
changes: every component is then a star around its smallest node. Smallest neighbours are aggregates, joined back to
the links, so a node with very many links is summed up before the shuffle and split by the adaptive join. Every round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = ordered.groupBy("a").agg(F.min("b").alias("m"))
    onwards = ordered.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return onwards.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is its smallest node. Loops and repeats are harmless."""
    links = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = _state(links)
    while before[0]:
        links = written(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """Members and the smallest member of their component, from links (a, b).

    A large star ties every larger neighbour of a node to the node's smallest neighbour,
    a small star does the same with the smaller ones; links become stars around the
    smallest member in a number of rounds that grows with the logarithm of the size.
    Each round is written to the shared folder. Minima are pre-aggregated and the joins
    back to the links may be split, so a hub needs no task of its own.

    Result: (node, component), for nodes with at least one link to another node.
    Links of a node to itself and links with a null end are ignored.
    """
    edges = _distinct(links.filter("a is not null and b is not null and a <> b")
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    edges, before = _state(edges)
    while True:
        edges, after = _state(_small_star(_large_star(edges)))
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("low"))
    lowest = lowest.select("centre", F.least("centre", "low").alias("low"))
    # of a link, the larger end goes to the smallest neighbour of the smaller end
    return edges.join(lowest, edges.b == lowest.centre).select("a", F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = _distinct(edges)
    lowest = edges.groupBy(F.col("a").alias("centre")).agg(F.min("b").alias("low"))
    moved = edges.join(lowest, edges.a == lowest.centre)
    return _distinct(moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                                                    F.struct("a", F.col("low").alias("b")))).alias("e"))
                     .select("e.*").filter("a <> b"))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").distinct()


def _state(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written links, and their number and checksum."""
    edges = written(edges)
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, tuple(row)

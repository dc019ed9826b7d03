"""Connected components of an undirected edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, join_by_key, materialize


def _with_least(neighbours: DataFrame, total: int) -> DataFrame:
    """(a, b, m): m is the least of a and its neighbours b. A hub's neighbours stay in their tasks."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_by_key(neighbours, least, ["a"], total).withColumn("m", F.least("a", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = _with_least(down, total)
    out = linked.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(linked.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); a component is its least node.

    Each round is written to shared storage, which also cuts the lineage, and
    the one before it is deleted; the driver sees a count and a checksum only. Self-links and repeated links do
    no harm. A graph that has not settled after ``rounds`` raises.
    """
    facts = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = materialize(edges.filter("a != b").distinct(), "edges")
    mark = facts(edges)
    for _ in range(rounds):
        large = materialize(_large_star(edges, mark[0]), "large-star")
        before, edges = edges, materialize(_small_star(large, 2 * mark[0]), "edges")
        discard(before)
        discard(large)
        now = facts(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components have not settled")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

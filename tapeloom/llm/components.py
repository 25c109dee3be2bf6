"""Connected components by alternating large and small stars, each round a few joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shared


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """For each a the least of a and its neighbours b."""
    return shared.materialize(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node. Self-links count as nodes."""
    edges = shared.materialize(links.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.filter("a = b").select("a")
    edges_now, state = edges.filter("a > b"), None
    for _ in range(rounds):
        before = edges_now
        both = edges_now.unionByName(edges_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = shared.materialize(both.join(shared.small(least), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least)
        least = _least(large)
        small = large.join(shared.small(least), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges_now = shared.materialize(small.filter("a > b").distinct(), large, least, before)
        now = _state(edges_now)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    stars = edges_now.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges_now.select(F.col("b").alias("a")).unionByName(nodes).distinct().join(edges_now.select("a").distinct(), "a", "left_anti")
    return shared.materialize(stars.unionByName(roots.withColumn("component", F.col("a"))).select(F.col("a").alias("node"), "component"), edges, edges_now)

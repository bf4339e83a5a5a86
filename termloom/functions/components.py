"""Connected components by alternating star contraction over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termloom.functions.shared import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: ``root`` is the smallest node that links reach.

    Each round replaces every node's links by links to its smallest neighbour, once for larger neighbours (large star)
    and once for smaller ones (small star); the edge count never grows and rounds grow with the logarithm of the
    longest chain. Minima are pre-aggregated before the shuffle, written, and joined back from there: as neither side is
    an aggregate then, AQE splits a hub's rows over tasks. Nulls, self links and repeated edges are ignored.
    """
    current = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc",
    )
    before = _signature(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = _both_ways(current)
        low = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-low")
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        large = staged(large, "cc")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a")
        current = staged(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "cc",
        )
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = current.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import remove, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): each id of the edges (a, b) with the smallest id that it reaches.

    Every step is a grouped minimum joined back to the edges, so a node of many neighbours is spread over tasks (the
    join is one that adaptive execution splits). Each round's edges are written to the shared folder; rounds grow with
    the logarithm of a component's diameter. Null ends and loops are left out; no edge gives no row.
    """
    spark = edges.sparkSession
    current, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        # Large star: each larger neighbour moves to the smallest of the neighbourhood.
        around = _both(current)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: each smaller neighbour, and the node itself, moves to the smallest of the smaller ones.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        following, next_path = written(small, "edges")
        remove(spark, path)
        current, path = following, next_path
        # Stars stay as they are; so do the number of edges and the sum over them.
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (row["n"], row["h"]):
            break
        state = (row["n"], row["h"])
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(current.select(F.col("b"), F.col("b")).distinct())

"""Connected components of edge tables by alternating large and small stars.

Each step looks at a node's smallest neighbour only, which is a partial
aggregate, and joins it back, which Spark splits where a node has very many
edges.  The edges of each round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import written


def _least(edges: DataFrame) -> DataFrame:
    """u with m, the smallest of u and its neighbours v; written, so that a join with it is a plain shuffle, which Spark splits at hot nodes."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): root is the smallest node that can be reached.  Only nodes with an edge to another are listed.

    Edges with a null end are ignored, repeated ones count once.
    """
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "edges")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least(down)
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a != b").distinct(), "edges")
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

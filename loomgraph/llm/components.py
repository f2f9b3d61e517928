"""Connected components by hooking to the smallest neighbour, jumping, and contracting the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written


def _looked_up(rows: DataFrame, key: str, up: DataFrame) -> DataFrame:
    """rows with found, what up has for the key.

    Many rows share a key where it is the hub of a large component. The join goes by the key's
    complement, so that both sides are shuffled for it and the skewed partition can be split, whatever
    partitioning up comes with.
    """
    table = up.select(F.bitwise_not("id").alias("complement"), F.col("up").alias("found"))
    return rows.withColumn("complement", F.bitwise_not(key)).join(table, "complement", "left").drop("complement")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id on an edge; root is the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour, jumps two parents up, and maps the
    edges through that, so at least half the vertices of each component leave. Null ends and loops
    are ignored. All work is joins and minima with map-side combining; only a count reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    root = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        for _ in range(2):
            up = _looked_up(up, "up", up).select("id", F.coalesce("found", "up").alias("up"))
        up = written(up)
        if root is None:
            root = up.select("id", F.col("up").alias("root"))
        else:
            root = _looked_up(root, "root", up).select("id", F.coalesce("found", "root").alias("root"))
        root = written(root)
        moved = _looked_up(_looked_up(pairs, "a", up).withColumnRenamed("found", "x"), "b", up).withColumnRenamed("found", "y").where("x <> y")
        pairs = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if root is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return root

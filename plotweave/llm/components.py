"""Connected components of an edge table by alternating large and small stars.

Each round maps every node to the smallest node it knows, through map-side combined minima and joins that AQE can
split, so a node with a third of all edges is no bottleneck. Edges never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import discard, store

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has an edge. edges: a, b of one orderable type.

    The result can be discarded like a stored table. Self-loops and repeated edges are allowed; rows with a null end are no edges; an empty table gives an empty one.
    """
    now = store(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )  # null ends fail the filter
    last = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, store(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    found.stored_at = now.stored_at
    return found

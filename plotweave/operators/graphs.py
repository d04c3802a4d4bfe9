"""Graph operators over all layouts at once: reachability, components and monotone fixpoints, one join a round for all of them.

Each round joins only what the last round found. Lineage is cut by tables in the folder that the cluster shares. Rounds go on until nothing is
new; where a caller limits them, an operator raises rather than return a part.
"""

from __future__ import annotations

import functools
import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir or the context's; only a local session without either gets a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plotweave-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared folder and read again, with nothing of the plan that made it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(rounds: int | None) -> Iterator[int]:
    """1, 2 and on; raises after so many rounds, if there is a limit."""
    for k in itertools.count(1):
        if rounds is not None and k > rounds:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
        yield k


#: Rounds whose finds are kept apart before they are put together.
APART = 16


class Found:
    """What the rounds have found: each round's rows are written once, and put together from time to time only."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def every(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self.parts)

    def add(self, new: DataFrame) -> None:
        self.parts.append(new)
        if len(self.parts) > APART:
            self.parts = [cut(self.every())]


def reachable(starts: DataFrame, edges: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """keys and node with depth: all nodes reached from the starts (keys, node) along edges (keys, src, dst), and in how many steps."""
    last = cut(starts.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen = Found(last)
    for depth in counted(rounds):
        step = last.select(*keys, F.col("node").alias("src")).join(edges, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        last = cut(step.join(seen.every().select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        seen.add(last)
    return seen.every()


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """keys, node, root (the smallest node of the component). nodes: keys, node; edges: keys, a, b."""
    both = cut(edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select(*keys, "node").distinct().withColumn("root", F.col("node")))
    for _ in counted(rounds):
        near = both.join(labels.select(*keys, F.col("node").alias("b"), "root"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, [*keys, "node"], "left").withColumn("new", F.least("root", F.coalesce("near", "root")))
        # pointer jumping: a root that got a smaller root passes it on
        jump = hooked.select(*keys, F.col("node").alias("new"), F.col("new").alias("jumped"))
        new = cut(hooked.join(jump, [*keys, "new"], "left").select(*keys, "node", "root", F.least("new", F.coalesce("jumped", "new")).alias("next")))
        changed = not new.filter("next < root").isEmpty()
        labels = new.select(*keys, "node", F.col("next").alias("root"))
        if not changed:
            break
    return labels


def spread(facts: DataFrame, edges: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """The least fixpoint of item sets on a graph: facts (keys, node, item) flow along edges (keys, src, dst, rule, rule_item).

    rule null lets every item pass, 'only' the rule's item, 'except' all others. Semi-naive: a round joins the last round's new facts only.
    """
    last = cut(facts.select(*keys, "node", "item").distinct())
    known = Found(last)
    passes = F.col("rule").isNull() | ((F.col("rule") == "only") == (F.col("item") == F.col("rule_item")))
    for _ in counted(rounds):
        step = last.select(*keys, F.col("node").alias("src"), "item").join(edges, [*keys, "src"]).filter(passes).select(*keys, F.col("dst").alias("node"), "item").distinct()
        last = cut(step.join(known.every(), [*keys, "node", "item"], "left_anti"))
        if last.isEmpty():
            break
        known.add(last)
    return known.every()


def pruned(edges: DataFrame, keep: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """Undirected edges (a, b) left after leaves that aren't kept (keys, node) are removed until none is left."""
    now = cut(edges)
    for _ in counted(rounds):
        ends = now.select(*keys, F.col("a").alias("node")).union(now.select(*keys, F.col("b").alias("node")))
        leaves = ends.groupBy(*keys, "node").count().filter("count <= 1").join(keep, [*keys, "node"], "left_anti").select(*keys, "node")
        leaves = cut(leaves)
        if leaves.isEmpty():
            break
        for end in ("a", "b"):
            now = now.join(leaves.withColumnRenamed("node", end), [*keys, end], "left_anti")
        now = cut(now)
    return now

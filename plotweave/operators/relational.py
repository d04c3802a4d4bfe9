"""Relational operators of the record pipeline and the catalog ranking.

All of them are plain DataFrame plans: map-side combined aggregates, equi joins that AQE may split, windows over keys of bounded groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work without a row in done: what is left after a restart."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str], kept: list[str]) -> DataFrame:
    """Rows of both by key: updated columns come from new where it has the key, kept ones stay as first stored."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.col(f"n.{key}").isNotNull()
    columns = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    columns += [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in updated]
    columns += [F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in kept]
    return both.select(columns)


def latest(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order: a full-row upsert, as an aggregate that combines on the map side."""
    rest = [c for c in versions.columns if c not in keys]
    rank = F.struct(*order, *[c for c in rest if c not in order])
    return versions.groupBy(*keys).agg(F.max(rank).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_wins(rows: DataFrame, hashed: str, order: str, eligible: Column) -> DataFrame:
    """rows with winner: the smallest order among the eligible rows of a hash."""
    winners = rows.filter(eligible).groupBy(hashed).agg(F.min(order).alias("winner"))
    return rows.join(winners, hashed, "left")


def in_other_group(rows: DataFrame, hashed: str, group: str) -> DataFrame:
    """Rows whose hash another group has too."""
    groups = rows.groupBy(hashed).agg(F.min(group).alias("low"), F.max(group).alias("high")).filter(F.col("low") < F.col("high"))
    return rows.join(groups.select(hashed), hashed, "left_semi")


def one_of_each(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group by order, by an aggregate instead of a window, so that a large group is combined on the map side."""
    named = [o.alias(f"_{k}") for k, o in enumerate(order)]
    rest = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*named, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def top_by_hash(rows: DataFrame, text: str, n: int, tie: str) -> DataFrame:
    """A pseudo-random sample that any run repeats: the first n by the hash of a text."""
    return rows.withColumn("h", F.sha2(text, 256)).orderBy("h", tie).limit(n)


def first_most_common(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Of each group, the most common value (the one seen first among equals) and its count; not mode(), whose ties are open."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def capped_top(rows: DataFrame, category: str, variant: str, score: str, tie: str, *, per_variant: int, per_category: int) -> DataFrame:
    """The best per_variant rows of each variant, then the first per_category rows of each category over its variants, by score."""
    best = Window.partitionBy(category, variant).orderBy(F.desc(score), F.asc(tie))
    capped = rows.withColumn("rank_in_variant", F.row_number().over(best)).filter(F.col("rank_in_variant") <= per_variant)
    over = Window.partitionBy(category).orderBy(F.desc(score), F.asc(tie))
    return capped.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= per_category)


def cascade(rows: DataFrame, group: str, preferences: list[Column], density: str, score: str, tie: str, slack: float) -> DataFrame:
    """One row of each group: preferences apply in turn, each only if it leaves a row; then within the slack of the densest, the best score."""
    for k, wanted in enumerate(preferences):
        rows = rows.withColumn("_p", F.coalesce(wanted, F.lit(False)))
        any_left = rows.groupBy(group).agg(F.max("_p").alias("_any"))
        rows = rows.join(any_left, group).filter(F.col("_p") | ~F.col("_any")).drop("_p", "_any")
    densest = rows.groupBy(group).agg((F.min(density) * slack).alias("_limit"))
    near = rows.join(densest, group).filter(F.col(density) <= F.col("_limit")).drop("_limit")
    rest = [c for c in near.columns if c != group]
    return near.groupBy(group).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("r")).select(group, "r.*")


def prefix_minimum(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value is below that of every row before them in their group."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_low", F.min(value).over(before)).filter(F.col("_low").isNull() | (F.col(value) < F.col("_low"))).drop("_low")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that two summaries share, and how much they differ, to three places."""
    joined = a.withColumnRenamed(value, "before").join(b.withColumnRenamed(value, "after"), keys)
    return joined.select(*keys, "before", "after", F.round(F.col("after") - F.col("before"), 3).alias("delta"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of both with both values, 0 where a side has none."""
    joined = before.withColumnRenamed(value, "before").join(after.withColumnRenamed(value, "after"), key, "full_outer")
    return joined.select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Values at floor(n * share) of each group in order, without interpolation.

    Equal values are counted first, so a group is as long as its distinct values.
    """
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value)
    placed = counted.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col(value))).alias(k) for k, s in shares.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks, F.max(value).alias("largest"))

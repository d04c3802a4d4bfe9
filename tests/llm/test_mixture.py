"""Poisson replication: the distribution at any mean, null ids and sources, clashing names, empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from plotweave.llm import mixture


@pytest.mark.parametrize("mean", [0.3, 1.0, 8.0, 9.0, 40.0, 400.0])
def test_draws_have_the_mean_and_the_variance(spark, mean):
    rows = 4000
    big = max(int(rows * mean), 1)
    # one source of 4,000 rows at the mean, one that takes what is left
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("t").alias("text"))
    df = df.union(spark.range(rows, 2 * rows).select(F.col("id"), F.lit("b"), F.lit("t")))
    weight = mean / 2
    found, copy = mixture.replicate(df, weights={"a": weight, "b": max(1 - weight, 0)} if weight < 1 else {"a": 1.0}, cap_rate=None)
    if weight > 1:  # the rate of a lone weighted source is what the others give up
        extra = spark.range(2 * rows, 2 * rows + int(rows * (mean - 2))).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("t").alias("text"))
        found, copy = mixture.replicate(df.union(extra), weights={"a": 1.0})
    n = found.filter("source = 'a'").groupBy("doc_id").count().select("count")
    x = n.agg(F.count("*").alias("k"), F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q")).first()
    m = x.s / rows
    v = x.q / rows - m * m
    assert abs(m - mean) < 5 * math.sqrt(mean / rows), (m, mean)
    assert abs(v / mean - 1) < 5 * math.sqrt((2 + 1 / mean) / rows), (v, mean)
    assert big and copy == "copy"


def test_tables_are_the_distribution(spark):
    means = spark.createDataFrame([("a", 0.001), ("b", 3.7), ("c", 123.4), ("d", 5000.0)], "source string, mean double")
    for r, mean in ((r, {"a": 0.001, "b": 3.7, "c": 123.4, "d": 5000.0}[r.source]) for r in mixture.tabulated(means).collect()):
        total = math.fsum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(r.low))
        for k, below in enumerate(r.below, start=r.low):
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            assert abs(total - below) < 1e-9


def test_null_ids_draw_by_text_and_names_may_clash(spark):
    rows = [(None, None if i % 3 == 0 else "s", f"text {i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_u long").withColumn("copy", F.lit("c"))
    found, copy = mixture.replicate(df)
    n = found.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("t")).collect()
    assert copy == "copy_" and found.columns == [*df.columns, "copy_"]
    assert {r.source for r in n} == {None, "s"} and all(abs(r.n - 1500) < 250 and r.t > 500 for r in n)
    assert mixture.replicate(df.limit(0))[0].count() == 0
    named = {r.source: r["count"] for r in mixture.replicate(df, weights={"zzz": 5.0}, other=1.0)[0].groupBy("source").count().collect()}
    assert set(named) == {None, "s"}  # other sources have the weight of other, a null one too
    assert mixture.replicate(df, weights={"zzz": 5.0})[0].count() == 0


def test_copies_are_spread_over_partitions(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t" * 50).alias("text"))
    order = [r.doc_id for r in mixture.replicate(df)[0].collect()]
    assert sum(a + 1 == b for a, b in zip(order, order[1:], strict=False)) < 20
    assert order == [r.doc_id for r in mixture.replicate(df.repartition(7))[0].collect()]

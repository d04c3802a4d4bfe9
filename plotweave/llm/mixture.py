"""Mixing sources to target weights by Poisson replication.

A source with n rows and weight w of the corpus's N rows in the mixture has the mean repetition rate w * N / n. Each row draws its number
of copies from the Poisson distribution of that mean, by inverting the distribution at a uniform number hashed from a seed and the row,
so that the draw is the same in every run, on every executor and at every partitioning. The distribution function is tabulated once a source,
as far as it differs from 0 and 1 in 52 bits: about 24 standard deviations of places, at any mean. Copies are dealt to partitions by one hash and sorted
by another, which is a global shuffle without a sampling pass. Only the counts by source are gathered; a source with a third of all rows is
added up before the shuffle, and its rows meet their table by broadcast where all tables have ENTRIES places at most, else by a join that may
shuffle.

Defined cases: a null source is a source of its own; sources that aren't named have the weight other; equal ids draw equal numbers, a null
id draws by its text; sources of weight 0 have no copies; an empty table gives an empty one; columns of other names pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import fresh, store

#: Places of the tabulated distribution functions that are broadcast at most.
ENTRIES = 1_000_000
#: Standard deviations and places beyond the mean that a table covers on either side.
SPREAD, MORE = 12.0, 40.0
#: Below this, logarithms of factorials come from a list; from it on, from Stirling's series.
STIRLING = 16


def uniform(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the SHA-256 of the seed and the columns, joined by '|'."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def log_factorial(k: Column) -> Column:
    x = F.greatest(k, F.lit(STIRLING)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5.0)) - 1 / (1680 * F.pow(x, 7.0))
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(STIRLING)))
    return F.when(k < STIRLING, F.element_at(small, F.least(k, F.lit(STIRLING - 1)).cast("int") + 1)).otherwise(series)


def tabulated(means: DataFrame) -> DataFrame:
    """source, low, below: the Poisson distribution function of each source's mean at low, low + 1 and on, as far as a number in [0, 1) reaches it."""
    mean = F.col("mean")
    low = F.greatest(F.floor(mean - SPREAD * F.sqrt(mean) - MORE), F.lit(0)).cast("long")
    high = F.ceil(mean + SPREAD * F.sqrt(mean) + MORE).cast("long")
    places = means.withColumn("low", low).withColumn("k", F.explode(F.sequence("low", high)))
    log_p = F.col("k") * F.log("mean") - mean - log_factorial(F.col("k"))
    rows = places.withColumn("below", F.sum(F.exp(log_p)).over(Window.partitionBy("source").orderBy("k")))
    held = F.sort_array(F.collect_list(F.when(F.col("below") < 1 - 2.0**-53, F.col("below"))))  # it never falls
    return rows.groupBy("source").agg(F.min("low").alias("low"), held.alias("below"))


def rates(docs: DataFrame, weights: dict[str, float] | None, other: float, source: str) -> DataFrame:
    """source, mean: the target repetition rate of each source that is to have rows. Without weights all sources have the same."""
    counts = store(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")), "sources")  # a row a source; counted once
    weight = F.lit(1.0 if weights is None else float(other))
    for k, v in (weights or {}).items():
        weight = F.when(F.col("source") == k, float(v)).otherwise(weight)
    every, total = counts.agg(F.sum("n"), F.sum(weight)).first()
    return counts.select("source", (weight / float(total or 1) * float(every or 0) / F.col("n")).alias("mean")).filter("mean > 0")


def replicate(
    docs: DataFrame, *, weights: dict[str, float] | None = None, other: float = 0.0, source: str = "source", doc: str = "doc_id", text: str = "text", seed: str = "mix", cap_rate: float | None = None, shuffle: bool = True
) -> tuple[DataFrame, str]:
    """docs with each row as often as it draws, in an order that the seed fixes, and the name of the column that numbers a row's copies.

    weights are relative to one another and to other, the weight of each source that they don't name. cap_rate bounds the rate of a small
    source, where the recipe wants it; None means that there is no bound.
    """
    names = {k: fresh(docs, k) for k in ("mix_source", "mix_low", "mix_below", "mix_key", "mix_u", "copy")}
    mean = rates(docs, weights, other, source)
    if cap_rate is not None:
        mean = mean.withColumn("mean", F.least("mean", F.lit(cap_rate)))
    table = store(tabulated(mean), "distributions").toDF(names["mix_source"], names["mix_low"], names["mix_below"])
    if (table.agg(F.sum(F.size(names["mix_below"]) + 1)).first()[0] or 0) <= ENTRIES:
        table = F.broadcast(table)
    of_text = F.concat(F.lit("text "), F.coalesce(F.col(text).cast("string"), F.lit(""))) if text in docs.columns else F.lit("")
    keyed = docs.withColumn(names["mix_key"], F.coalesce(F.col(doc).cast("string"), of_text))
    joined = keyed.join(table, keyed[source].eqNullSafe(F.col(names["mix_source"]))).withColumn(names["mix_u"], uniform(seed, F.col(names["mix_key"])))
    copies = (F.col(names["mix_low"]) + F.size(F.filter(names["mix_below"], lambda x: x <= F.col(names["mix_u"])))).cast("int")
    drawn = joined.withColumn(names["copy"], F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    order = [F.xxhash64(F.lit(k), F.lit(seed), F.col(names["mix_key"]), F.col(names["copy"])) for k in (1, 2)]
    drawn = drawn.select(*docs.columns, names["copy"], *(o.alias(n) for o, n in zip(order, (names["mix_low"], names["mix_u"]), strict=True)))
    if shuffle:
        drawn = drawn.repartition(names["mix_low"]).sortWithinPartitions(names["mix_u"])
    return drawn.select(*docs.columns, names["copy"]), names["copy"]

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.session import table

__all__ = ["annotate", "bit_table", "discard", "fresh", "perhaps_in", "remainder", "scratch", "small_batches", "store", "table"]


def fresh(df: DataFrame, base: str) -> str:
    """base, or base with underscores added until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the whole cluster shares.

    The folder is spark.checkpoint.dir or the context's checkpoint folder. Only a local session, as in tests, may have neither and gets a
    temporary folder; anywhere else executors would write to disks of their own, so that is an error.
    """
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plotweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Where rows are large, Arrow batches of so many at most, for what runs inside: a batch is held by Spark and by Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Spark removes the shuffle files of a query at its end where this is set, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a cut in the lineage that outlives any executor.

    The shuffle files of the write go with it, as nothing reads them afterwards. discard() removes the table.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*stored: DataFrame) -> None:
    """Removes tables that store() has made and that nothing reads any more."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits in a bit table: what a broadcast of one can be at most, whatever the input.
WORDS = 1 << 20


def bit_table(ids: DataFrame) -> DataFrame:
    """word, bits: a bit for each 64-bit id, in WORDS words at most. ids: id."""
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(id, 20), 64) as int))")
    return ids.filter("id is not null").groupBy(F.expr(f"cast(id & {WORDS - 1} as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))


def perhaps_in(df: DataFrame, key: Column, table: DataFrame) -> tuple[DataFrame, str]:
    """df with a boolean column, and its name: false where the key (a 64-bit number) is surely not in the table; a null key is in none."""
    word, bits, flag = (fresh(df, c) for c in ("bit_word", "bit_bits", "perhaps"))
    keyed = df.withColumns({word: key.bitwiseAND(F.lit(WORDS - 1)).cast("int"), flag: F.pmod(F.shiftright(key, 20), F.lit(64)).cast("int")})
    joined = keyed.join(F.broadcast(table.toDF(word, bits)), word, "left")  # WORDS rows at most
    hit = F.coalesce(F.call_function("getbit", F.col(bits), F.col(flag)) == 1, F.lit(False))
    return joined.withColumn(flag, hit).drop(word, bits), flag


def annotate(
    df: DataFrame, read: list[str], base: str, kind: T.DataType, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, pa.Array]]]
) -> tuple[DataFrame, str]:
    """df with one more column that work makes in Arrow batches; all other columns pass through unchanged.

    work takes batches of all columns and yields slices of them with the new column's values. read is only a check that the columns exist.
    """
    for c in read:
        df[c]  # noqa: B018  raises where it is missing
    name = fresh(df, base)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in work(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    return df.mapInArrow(run, schema), name


def split_words(pattern: str, text: str) -> list[str]:
    """The plain form of the vectorised words, for tests."""
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

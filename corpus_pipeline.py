"""The corpus pipeline: raw documents to a clean, deduplicated and weighted training set.

Each stage takes all rows that its predecessor kept. Every stage but the last returns the columns of documents:
toxicity drops the documents that the model rejects, near duplicates keep one document of each group (five words, 0.8),
decontamination drops documents with benchmark windows, secrets are masked in the text (which keeps the document), and the
mixture repeats or drops documents so that all sources weigh the same.

Defined cases: documents without an id or a text take part like others (an empty text is nobody's copy and has no secret); repeated rows are copies; rows that
share an id are told apart by their texts; other columns pass through every stage, whatever they are called; a stage of no rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import decontaminate, mixture, ngram_join, secrets, toxicity
from plotweave.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.replicate(docs)[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
]
ORACLE_SQL = None  # the first stage is a trained model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns; what each stage returns is written to the shared folder first."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import decontaminate, hmm_lm, html_text, images, mixture, ngram_join, pii, secrets, toxicity, warc
from plotweave.llm.common import table

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op4_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.groups(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.toDF("doc_id", "n_shingles", "component_id")


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.digest(table(spark, sf_dir, "documents"))


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op8_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(table(spark, sf_dir, "pages"))


#: Target weights of the mixture, relative to 1 for each other source: the first source is held down, the third one is favoured.
WEIGHTS = {"src0": 0.4, "src2": 2.5}


def op5_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, copy = mixture.replicate(docs, weights=WEIGHTS, other=1.0)
    return found.withColumnRenamed(copy, "copy").select("doc_id", "source", "copy", "text")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each vector of embeddings is rendered as one."""
    return images.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op4_suffix_decontamination": op4_suffix_decontamination,
    "op7_markov_secrets": op7_markov_secrets,
    "op9_hmm_scoring": op9_hmm_scoring,
    "op6_boosted_toxicity": op6_boosted_toxicity,
    "op2_warc_segments": op2_warc_segments,
    "op8_disclosure_pii": op8_disclosure_pii,
    "op10_crf_main_text": op10_crf_main_text,
    "op3_image_copies": op3_image_copies,
    "op5_poisson_mixture": op5_poisson_mixture,
}
ORACLES = {
    "op5_poisson_mixture": f"""
WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v!r}::DOUBLE)" for k, v in WEIGHTS.items())}) AS t(source, weight)),
c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT c.source, n, coalesce(weight, 1.0) AS weight, sum(coalesce(weight, 1.0)) OVER () AS weights, sum(n) OVER () AS total FROM c LEFT JOIN w ON c.source = w.source),
m AS (SELECT source, weight / weights * total / n AS mean FROM r),
k AS (SELECT source, mean, unnest(generate_series(0, CAST(ceil(mean + 12 * sqrt(mean) + 40) AS BIGINT))) AS k FROM m),
f AS (SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM k),
t AS (SELECT source, list(below ORDER BY k) AS below FROM f GROUP BY source),
d AS (SELECT d.doc_id, d.source, d.text, t.below,
             concat('0x', substr(sha256(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), concat('text ', coalesce(text, ''))))), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, CAST(unnest(generate_series(1, len(list_filter(below, lambda s: s <= u)))) AS INTEGER) AS copy, text FROM d""",
    "op4_suffix_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS line, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item, line, least(10, len(w)) AS n, j, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, line, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bp),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.n, dw.i, bp.item, bp.line, bp.j FROM dw JOIN bp USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1),
runs AS (SELECT doc_id, n, i, line, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, line, i - j ORDER BY i) AS island FROM m),
spans AS (SELECT doc_id, min(i) - 1 AS first_word, min(n) + count(*) - 1 AS words FROM runs GROUP BY doc_id, line, diagonal, island),
best AS (SELECT doc_id, max(words) AS longest, arg_max(first_word, words * 1000000000 - first_word) AS longest_at FROM spans GROUP BY doc_id)
SELECT doc_id, len(coalesce(w, [])) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest, longest_at
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN best USING (doc_id)""",
}

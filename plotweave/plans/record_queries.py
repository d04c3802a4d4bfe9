"""Queries of the candidate chain, the export and the catalog's ranks on the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.functions import text as X
from plotweave.operators import catalog as C
from plotweave.operators import records as R
from plotweave.session import table


def _candidates(spark, sf):
    docs = table(spark, sf, "documents")
    reject = F.when(F.col("doc_id") % 37 == 0, "off_grid")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("key"), F.lit(0).alias("book_pos"), F.struct((-F.col("n_chars")).alias("less"), "doc_id").alias("rank"), (F.col("doc_id") % 3).cast("int").alias("major"),
        (F.col("doc_id") % 20).cast("int").alias("minor"), (F.col("n_chars") % 600).alias("n_entities"), reject.alias("reject"), F.when(F.col("doc_id") % 41 != 0, F.col("text")).alias("code"),
    )
    return R.candidates(rows)


def candidate_statuses(spark, sf):
    return _candidates(spark, sf).select("key", "n_tokens", "status", "winner")


def candidate_counters(spark, sf):
    capped = table(spark, sf, "documents").filter("n_chars > 5000").select(F.col("source").alias("key"))
    return R.reject_counts(_candidates(spark, sf), capped)


def export_splits(spark, sf):
    docs = table(spark, sf, "documents")
    claims = F.when(F.col("doc_id") % 29 == 0, F.array(F.lit("3 labs"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("prompt_id"), F.col("source").alias("blueprint_key"), F.concat_ws(" ", "lang", "source").alias("prompt"), F.col("text").alias("code"), claims.alias("conflicts"), ((F.col("doc_id") % 4) * 90).cast("int").alias("rotation"))
    return R.export_counters(R.export_records(rows, "You write scripts.", eval_fraction=0.3))


def sampled_rejects(spark, sf):
    return C.sampled_rejects(table(spark, sf, "events").select(F.col("event_type").alias("reason"), F.col("event_id").alias("key")))[1]


def design_scores(spark, sf):
    part = table(spark, sf, "part")
    score = C.rank_score(F.col("p_size"), F.col("p_partkey") % 3, F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice") / 20))
    return part.select("p_partkey", F.round(score, 6).alias("score"))


def prompt_numbers(spark, sf):
    """The integers that a prompt of an order may name: counts by line status, sizes, and the numbers of its priority."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("total"), F.count_if(F.col("l_linestatus") == "F").cast("int").alias("f"), F.max("l_linenumber").alias("wide"))
    joined = lines.join(table(spark, sf, "orders"), lines.l_orderkey == F.col("o_orderkey"))
    counts = F.create_map(F.lit("F"), F.col("f"), F.lit("O"), F.col("total") - F.col("f"))
    none = F.create_map().cast("map<string,int>")
    allowed = X.allowed_numbers(counts, none, none, F.col("wide"), F.col("total"), F.col("total"), F.col("o_orderpriority"), F.lit("[item=lab] 7"))
    return joined.select("l_orderkey", F.array_join(allowed, ",").alias("allowed"))


def fitted_histories(spark, sf):
    """Conversations shortened to a budget of tokens; the steps depend on one another, so no SQL."""
    turns = table(spark, sf, "conversations").filter("role is not null")
    line = F.struct("turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), r"[.] ", ".\n").alias("content"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    fitted = X.fit_history(F.col("messages"), 400)
    return chats.select("conv_id", F.size(fitted["messages"]).alias("turns"), fitted["fits"].alias("fits"), F.aggregate(fitted["messages"], F.lit(0), lambda a, m: a + F.length(m["content"])).alias("chars"))


NAMES = "candidate_statuses candidate_counters export_splits sampled_rejects design_scores prompt_numbers fitted_histories".split()
QUERIES = {name: globals()[name] for name in NAMES}
_CANDIDATES = """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS key, doc_id, n_chars, CASE WHEN doc_id % 41 <> 0 THEN text END AS code,
 CASE WHEN (doc_id % 3) * 1000 + doc_id % 20 < 15 AND NOT (doc_id % 3 = 0 AND doc_id % 20 = 0) THEN 'old_version' WHEN n_chars % 600 < 4 THEN 'too_small' WHEN n_chars % 600 > 500 THEN 'too_large'
 WHEN doc_id % 37 = 0 THEN 'parse_off_grid' WHEN doc_id % 41 = 0 OR text IS NULL THEN 'lift_error' END AS early FROM documents),
h AS (SELECT *, sha256(code) AS h, length(code) // 3 AS n FROM d),
w AS (SELECT *, first_value(CASE WHEN early IS NULL AND n <= 3600 THEN key END IGNORE NULLS) OVER (PARTITION BY h ORDER BY -n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM h),
s AS (SELECT key, n AS n_tokens, CASE WHEN early IS NOT NULL THEN early WHEN earlier IS NOT NULL THEN 'duplicate' WHEN n > 3600 THEN 'too_long' ELSE 'pending' END AS status, CASE WHEN early IS NULL THEN earlier END AS winner FROM w)"""
ORACLES = {
    "candidate_statuses": f"{_CANDIDATES} SELECT key, n_tokens, status, winner FROM s",
    "candidate_counters": f"{_CANDIDATES} SELECT status AS reason, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'book_cap', count(DISTINCT source) FROM documents WHERE n_chars > 5000",
    "export_splits": """WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(lower(concat_ws(' ', lang, source)), '[а-яё]') THEN 'ru' ELSE 'en' END AS lang, CASE WHEN concat('0x', substr(sha256(source), 1, 8))::BIGINT / 4294967295.0 < 0.3 THEN 'eval' ELSE 'train' END AS split,
 CASE WHEN doc_id % 29 = 0 THEN 'count_conflict' WHEN 18 // 3 + length(concat_ws(' ', lang, source)) // 3 + length(text) // 3 + 30 > 4096 THEN 'too_long' END AS dropped FROM documents)
SELECT coalesce('dropped_' || dropped, split || '_' || lang) AS counter, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'rotated', count(*) FROM r WHERE dropped IS NULL AND doc_id % 4 > 0""",
    "sampled_rejects": "SELECT reason, key FROM (SELECT event_type AS reason, event_id AS key, row_number() OVER (PARTITION BY event_type ORDER BY sha256(CAST(event_id AS VARCHAR)), event_id) AS r FROM events) WHERE r <= 5",
    "design_scores": "SELECT p_partkey, round(log10(p_size + 1) + CASE p_partkey % 3 WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END - CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / 20 ELSE 50.0 END / 100, 6) AS score FROM part",
    "prompt_numbers": """WITH l AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS f, max(l_linenumber) AS wide FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat([f::VARCHAR, (total - f)::VARCHAR, wide::VARCHAR, total::VARCHAR, '7', '2'], regexp_extract_all(o_orderpriority, '\\d+')))), ',') AS allowed FROM l JOIN orders ON l_orderkey = o_orderkey""",
}

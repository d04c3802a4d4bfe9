"""Queries of the record pipeline on the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions import text as X
from plotweave.operators import relational as R
from plotweave.session import table

#: Fixed values of the export stage: longest script in tokens, share of the evaluation side.
MAX_TOKENS = 3600
EVAL_FRACTION = 0.03


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def status_counters(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang", F.sha2("text", 256).alias("h"), X.token_count(F.col("text")).alias("n_tokens"))
    kept = R.first_wins(docs, "h", "doc_id", F.col("n_tokens") <= MAX_TOKENS)
    status = F.when(F.col("winner") < F.col("doc_id"), "duplicate").when(F.col("n_tokens") > MAX_TOKENS, "too_long").otherwise("ok")
    split = F.when(X.stable_fraction(F.col("doc_id").cast("string")) < EVAL_FRACTION, "eval").otherwise("train")
    return kept.groupBy(split.alias("split"), "lang", status.alias("status")).agg(F.count("*").alias("n"))


def ingest_first_reason(spark, sf):
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    reason = (
        F.when(F.col("quality").isNull(), "unlabelled").when(F.col("n_chars") < 100, "too_short").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
        .when(F.col("n_chars") > 10000, "too_long").otherwise("ok")
    )
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def incremental_pending(spark, sf):
    return R.pending(documents(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


def upsert_keep_payload(spark, sf):
    events = table(spark, sf, "events")
    at = F.floor(F.col("event_id") / 3) % 2
    part = lambda half: R.latest(events.filter(at == half).select(F.col("user_id"), "event_id", "event_type", "value"), ["user_id"], ["event_id"])
    return R.upsert(part(0), part(1), "user_id", ["event_id", "value"], ["event_type"])


def dedupe_first_wins(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    kept = R.first_wins(docs, "h", "doc_id", F.lit(True))
    return kept.select("doc_id", "h", "winner", (F.col("winner") != F.col("doc_id")).alias("duplicate"))


def same_text_elsewhere(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return R.in_other_group(docs, "h", "source").select("doc_id", "source")


def stable_split(spark, sf):
    key = F.col("doc_id").cast("string")
    return documents(spark, sf).select("doc_id", X.stable_fraction(key).alias("fraction"), (X.stable_fraction(key) < 0.3).alias("held_out"))


def stable_rotation(spark, sf):
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text"))
    return documents(spark, sf).select("doc_id", X.stable_choice(key, 4).alias("turns"))


def subsample_one_per_group(spark, sf):
    docs = documents(spark, sf).select("source", "lang", "doc_id", F.sha2("text", 256).alias("h"))
    return R.one_of_each(docs, ["source", "lang"], [F.col("h"), F.col("doc_id")], ["doc_id", "h"])


def eval_sample_topn_hash(spark, sf):
    return R.top_by_hash(documents(spark, sf).select("doc_id", "text"), "text", 50, "doc_id").select("doc_id", "h")


def chat_records(spark, sf):
    turns = table(spark, sf, "conversations").filter("role is not null")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    line = lambda x: F.concat(x.role, F.lit(": "), F.coalesce(x.text, F.lit("")))
    return grouped.select("conv_id", F.size("t").alias("turns"), F.array_join(F.transform("t", line), "\n").alias("chat"))


def history_shorten(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.shorten(F.regexp_replace("text", r"[.] ", ".\n"), 2).alias("short"))


def repetition_flag(spark, sf):
    return documents(spark, sf).select("doc_id", X.is_stuck_in_repetition(F.col("text")).alias("stuck"), X.is_stuck_in_repetition(F.col("text"), 2).alias("twice"))


def normalize_whitespace(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("h"))


def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(X.collapse(F.regexp_replace("html", "<[^>]*>", " ")), 256).alias("h"))


def language_by_script(spark, sf):
    script = F.when(F.col("text").rlike("[а-яё]"), "cyrillic").when(F.col("text").rlike("[äöüß]"), "german").when(F.col("text").rlike("[éèêç]"), "french").when(F.col("text").rlike("[ñóí]"), "spanish").otherwise("plain")
    return documents(spark, sf).groupBy("lang", script.alias("script")).agg(F.count("*").alias("n"))


def numbers_grounded(spark, sf):
    docs = documents(spark, sf)
    own = X.numbers(F.col("text"))
    allowed = F.array(F.lit("2"), F.col("n_chars").cast("string"), F.col("doc_id").cast("string"), F.lit("1"))
    return docs.select("doc_id", F.size(own).alias("numbers"), X.is_grounded(F.col("text"), allowed).alias("grounded"))


def nearest_rank_percentiles(spark, sf):
    return R.nearest_rank(documents(spark, sf), ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9})


def summary_grouping_sets(spark, sf):
    joined = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id", "source"), "doc_id")
    sets = joined.groupingSets([[], ["source"]], "source").agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 3).alias("toxic_rate"), F.round(F.avg("quality"), 3).alias("quality_rate"))
    return sets.select(F.coalesce("source", F.lit("all")).alias("block"), "n", "toxic_rate", "quality_rate")


def _label_summary(spark, sf, parity):
    joined = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id", "source", "lang"), "doc_id").filter(F.substring_index("source", "src", -1).cast("int") % 2 == parity)
    long = joined.select("lang", F.explode(F.create_map(F.lit("toxic"), F.col("toxic"), F.lit("quality"), F.col("quality"))).alias("metric", "v"))
    return long.groupBy("lang", "metric").agg(F.avg("v").alias("value"))


def compare_summaries(spark, sf):
    return R.compare(_label_summary(spark, sf, 0), _label_summary(spark, sf, 1), ["lang", "metric"], "value").select("lang", "metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "delta")


def count_checks(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("actual"), F.sum("l_quantity").alias("quantity"))
    expected = F.round(F.col("quantity") / 25.5)
    check = X.count_checks(expected, F.col("actual"))
    return lines.select("l_orderkey", "actual", check.exact.alias("exact"), check.within10.alias("within10"))


def argmax_first_wins(spark, sf):
    return R.first_most_common(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


def topk_per_variant_then_cap(spark, sf):
    part = table(spark, sf, "part").withColumn("score", F.round("p_retailprice", 2))
    best = R.capped_top(part, "p_brand", "p_type", "score", "p_partkey", per_variant=3, per_category=16)
    return best.select("p_brand", "p_type", "p_partkey", "rank")


def default_choice_cascade(spark, sf):
    part = table(spark, sf, "part")
    wanted = [F.col("p_size") % 7 == 0, F.col("p_partkey") % 11 == 0, F.col("p_size") > 25]
    return R.cascade(part, "p_brand", wanted, "p_size", "p_retailprice", "p_partkey", 1.15).select("p_brand", "p_partkey", "p_size")


def prefix_minimum(spark, sf):
    return R.prefix_minimum(table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", "s_suppkey", "s_acctbal")


def catalog_changes(spark, sf):
    labels = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id", "source"), "doc_id")
    of = lambda what: labels.filter(F.col(what) == 1).groupBy("source").agg(F.count("*").alias("n"))
    return R.changes(of("toxic"), of("quality"), "source", "n")


def search_title(spark, sf):
    """A case-insensitive pattern, newest first with unknown dates last, one row."""
    c = table(spark, sf, "customer")
    return c.filter(F.col("c_mktsegment").ilike("%BUILD%")).orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(1).select("c_custkey", "c_mktsegment")


def json_field(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def records_with_prompts(spark, sf):
    orders, lines = table(spark, sf, "orders").filter("o_orderstatus = 'F'"), table(spark, sf, "lineitem")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select("o_orderkey", "o_custkey", "l_linenumber", "l_partkey")


NAMES = (
    "status_counters ingest_first_reason incremental_pending upsert_keep_payload dedupe_first_wins same_text_elsewhere stable_split stable_rotation subsample_one_per_group eval_sample_topn_hash chat_records"
    " history_shorten repetition_flag normalize_whitespace strip_tags language_by_script numbers_grounded nearest_rank_percentiles summary_grouping_sets compare_summaries count_checks argmax_first_wins"
    " topk_per_variant_then_cap default_choice_cascade prefix_minimum catalog_changes search_title json_field records_with_prompts"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
_CUT = r"trim(regexp_replace({}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_NUMBERS = r"list_distinct(regexp_extract_all(text, '\d+'))"
_LABELS = """WITH j AS (SELECT lang, toxic, quality, CAST(substr(source, 4) AS INT) % 2 AS par FROM labels JOIN documents USING (doc_id)),
s AS (SELECT par, lang, 'toxic' AS metric, avg(toxic) AS value FROM j GROUP BY 1, 2 UNION ALL SELECT par, lang, 'quality', avg(quality) FROM j GROUP BY 1, 2)"""
_SPACE = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"
_LINES = r"string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')"
_LAST = f"list_filter(list_transform({_LINES}, lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '')"
ORACLES = {
    "status_counters": """
WITH d AS (SELECT doc_id, lang, sha256(text) h, length(text) // 3 n FROM documents),
w AS (SELECT h, min(doc_id) winner FROM d WHERE n <= 3600 GROUP BY h)
SELECT CASE WHEN concat('0x', substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.03 THEN 'eval' ELSE 'train' END AS split,
       lang, CASE WHEN winner < doc_id THEN 'duplicate' WHEN n > 3600 THEN 'too_long' ELSE 'ok' END AS status, count(*) AS n
FROM d LEFT JOIN w USING (h) GROUP BY 1, 2, 3""",
    "ingest_first_reason": """SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN n_chars < 100 THEN 'too_short' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality'
WHEN n_chars > 10000 THEN 'too_long' ELSE 'ok' END AS reason, count(*) AS n, min(doc_id) AS first_doc FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "incremental_pending": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "upsert_keep_payload": """WITH h AS (SELECT *, (event_id // 3) % 2 AS half FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY half, user_id ORDER BY event_id DESC) r FROM h) WHERE r = 1),
o AS (SELECT * FROM l WHERE half = 0), n AS (SELECT * FROM l WHERE half = 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value,
       CASE WHEN o.user_id IS NOT NULL THEN o.event_type ELSE n.event_type END AS event_type FROM o FULL JOIN n ON o.user_id = n.user_id""",
    "dedupe_first_wins": "SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS winner, min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id AS duplicate FROM documents",
    "same_text_elsewhere": "SELECT doc_id, source FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)",
    "stable_split": "SELECT doc_id, concat('0x', substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 AS fraction, fraction < 0.3 AS held_out FROM documents",
    "stable_rotation": "SELECT doc_id, concat('0x', substr(sha256(concat(doc_id, '|', text)), 1, 8))::BIGINT % 4 AS turns FROM documents",
    "subsample_one_per_group": "SELECT source, lang, doc_id, h FROM (SELECT source, lang, doc_id, sha256(text) h, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(text), doc_id) r FROM documents) WHERE r = 1",
    "eval_sample_topn_hash": "SELECT doc_id, sha256(text) AS h FROM documents ORDER BY 2, 1 LIMIT 50",
    "chat_records": "SELECT conv_id, CAST(count(*) AS INT) AS turns, string_agg(concat(role, ': ', coalesce(text, '')), chr(10) ORDER BY turn, role, text) AS chat FROM conversations WHERE role IS NOT NULL GROUP BY 1",
    "history_shorten": """WITH l AS (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10)) AS t FROM conversations), s AS (SELECT *, string_split(t, chr(10)) AS a FROM l)
SELECT conv_id, turn, CASE WHEN t IS NULL THEN NULL WHEN len(a) <= 5 THEN t ELSE array_to_string(list_concat(a[1:2], ['... ' || (len(a) - 4) || ' lines omitted ...'], a[len(a) - 1:]), chr(10)) END AS short FROM s""",
    "repetition_flag": f"""WITH l AS (SELECT doc_id, {_LAST} AS a FROM documents)
SELECT doc_id, len(a) >= 8 AND len(list_distinct(a[greatest(len(a) - 7, 1):])) = 1 AS stuck, len(a) >= 2 AND len(list_distinct(a[greatest(len(a) - 1, 1):])) = 1 AS twice FROM l""",
    "normalize_whitespace": f"SELECT doc_id, sha256({_CUT.format('text')}) AS h FROM documents",
    "strip_tags": f"SELECT page_id, sha256({_CUT.format(chr(114) + 'egexp_replace(html, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS h FROM pages",
    "language_by_script": "SELECT lang, CASE WHEN regexp_matches(text, '[а-яё]') THEN 'cyrillic' WHEN regexp_matches(text, '[äöüß]') THEN 'german' WHEN regexp_matches(text, '[éèêç]') THEN 'french' WHEN regexp_matches(text, '[ñóí]') THEN 'spanish' ELSE 'plain' END AS script, count(*) AS n FROM documents GROUP BY 1, 2",
    "numbers_grounded": f"SELECT doc_id, CAST(len({_NUMBERS}) AS INT) AS numbers, list_has_all(['2', n_chars::VARCHAR, doc_id::VARCHAR, '1'], {_NUMBERS}) AS grounded FROM documents",
    "nearest_rank_percentiles": "SELECT lang, count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1] AS p50, list_sort(list(n_chars))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90, max(n_chars) AS largest FROM documents GROUP BY 1",
    "summary_grouping_sets": "SELECT coalesce(source, 'all') AS block, count(*) AS n, round(avg(toxic), 3) AS toxic_rate, round(avg(quality), 3) AS quality_rate FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (source))",
    "compare_summaries": f"{_LABELS} SELECT a.lang, a.metric, round(a.value, 6) AS before, round(b.value, 6) AS after, round(b.value - a.value, 3) AS delta FROM s a JOIN s b ON a.par = 0 AND b.par = 1 AND a.lang = b.lang AND a.metric = b.metric",
    "count_checks": "WITH l AS (SELECT l_orderkey, count(*) AS actual, round(sum(l_quantity) / 25.5) AS e FROM lineitem GROUP BY 1) SELECT l_orderkey, actual, abs(actual - e) = 0 AS exact, abs(actual - e) <= greatest(1.0, e * 0.1) AS within10 FROM l",
    "argmax_first_wins": "WITH c AS (SELECT user_id, event_type, count(*) n, min(event_id) f FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) r FROM c) WHERE r = 1",
    "topk_per_variant_then_cap": """WITH v AS (SELECT p_brand, p_type, p_partkey, round(p_retailprice, 2) s, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY round(p_retailprice, 2) DESC, p_partkey) r FROM part),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS k FROM v WHERE r <= 3) SELECT p_brand, p_type, p_partkey, CAST(k AS INT) AS rank FROM c WHERE k <= 16""",
    "default_choice_cascade": """WITH a AS (SELECT *, max(p_size % 7 = 0) OVER (PARTITION BY p_brand) y FROM part), b AS (SELECT * FROM a WHERE NOT y OR p_size % 7 = 0),
c AS (SELECT * EXCLUDE y, max(p_partkey % 11 = 0) OVER (PARTITION BY p_brand) y FROM b), d AS (SELECT * FROM c WHERE NOT y OR p_partkey % 11 = 0),
e AS (SELECT * EXCLUDE y, max(p_size > 25) OVER (PARTITION BY p_brand) y FROM d), f AS (SELECT * FROM e WHERE NOT y OR p_size > 25),
g AS (SELECT *, min(p_size) OVER (PARTITION BY p_brand) * 1.15 m FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) r FROM g WHERE p_size <= m)
SELECT p_brand, p_partkey, p_size FROM h WHERE r = 1""",
    "prefix_minimum": "SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, min(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM supplier) WHERE m IS NULL OR s_acctbal < m",
    "catalog_changes": """WITH j AS (SELECT * FROM labels JOIN documents USING (doc_id)), t AS (SELECT source, count(*) n FROM j WHERE toxic = 1 GROUP BY 1), q AS (SELECT source, count(*) n FROM j WHERE quality = 1 GROUP BY 1)
SELECT coalesce(t.source, q.source) AS source, coalesce(t.n, 0) AS before, coalesce(q.n, 0) AS after FROM t FULL JOIN q ON t.source = q.source""",
    "search_title": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%BUILD%' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1",
    "json_field": "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1",
    "records_with_prompts": "SELECT o_orderkey, o_custkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'",
}

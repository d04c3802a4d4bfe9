"""Clashing names, empty tables, long texts and broken input, per operator where the other tests have none."""

import gzip

from pyspark.sql import functions as F

from plotweave.llm import hmm_lm, html_text, pii, warc


def test_op9_names_may_clash_and_tables_be_empty(spark):
    df = spark.createDataFrame([(i, f"a b c{i % 3} d", i) for i in range(12)], "doc_id long, text string, score long")
    for c in ("known", "base", "likely", "open", "rare", "times", "n_tokens", "text_name", "symbols"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    got = hmm_lm.score(df, df.filter("doc_id % 2 = 0"), states=2, rounds=1)
    assert {"doc", "score", "score_", "n_tokens", "n_tokens_", "base_score"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 12 and all(r.score == r.doc and r.known == "own known" and r.n_tokens == "own n_tokens" and r.n_tokens_ == 5 and r.score_ < 0 for r in rows)
    assert hmm_lm.digest(df.select("doc_id", "text").limit(0)).count() == 0
    assert hmm_lm.score(df.select("doc_id", "text"), df.limit(0), states=2, rounds=1).filter("n_known = 0").count() == 12  # no training rows


def test_op9_the_first_clusters_come_from_all_rows(spark):
    """Texts beyond the sampled ones, and places beyond any prefix, count in the start."""
    texts = ["x " * 30 + f"u{i}" for i in range(20)] + ["y " * 5000 + "z " * 5000]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = hmm_lm.token_counts(train)
    vocab = hmm_lm.vocabulary(counts, len(texts))
    spark_vocab = spark.sparkContext.broadcast(vocab)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from plotweave.llm import bytewords

        for b in batches:
            w = bytewords.cut(b.column(0).to_pylist(), bytewords.WHITESPACE)
            s, at = hmm_lm.sequences(w, spark_vocab.value.look_up(w)[1], spark_vocab.value.end)
            yield pa.RecordBatch.from_arrays([pa.array([s[i:j].astype(np.uint16).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["symbols"])

    own = hmm_lm.clustered(train.mapInArrow(run, "symbols binary"), vocab, 2)
    assert own.sum() == sum(len(t.split()) + 1 for t in texts)


def test_op2_compressed_archives(spark, tmp_path):
    parts = [b"".join(r + b"\r\n\r\n" for r in warc.records_of(k, "http://a/", b"body %d" % k, None)) for k in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = sorted((r.page_id, bytes(r.payload)) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == [(k, b"body %d" % k) for k in range(3)]
    cut = gzip.compress(parts[0])[:-9]
    try:
        warc.plain(cut)
        raise AssertionError("a cut member must not pass")
    except ValueError:
        pass


def test_op2_names_may_clash_and_tables_be_empty(spark):
    pages = spark.createDataFrame([(1, "u", "h" * 10, "q"), (2, "v", "h" * 10, "q"), (2, "v", "h" * 10, "q"), (None, None, None, None)], "page_id long, url string, html string, payload string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.digest(pages.withColumn("digest", F.lit(1))).collect())
    assert got == [(0, "response", None, 0), (1, "revisit", 2, 10), (2, "response", None, 10), (2, "response", None, 10)]
    assert warc.digest(pages.limit(0)).count() == 0


def test_op8_clash_long_and_empty(spark):
    long = "word " * 60_000 + "mail bob.smith@example.org now " + "tail " * 60_000
    df = spark.createDataFrame([(1, long, "k"), (2, None, "k"), (2, "", "k")], "doc_id long, text string, pii_spans string")
    found, name = pii.scan(df)
    assert name != "pii_spans" and found.columns == [*df.columns, name]
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and "[EMAIL]" in clean.filter("doc_id = 1").first().text
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.digest(df.limit(0)).count() == 0


def test_op10_empty_long_and_clash(spark):
    body = "<p>" + "A sentence of the article that goes on for a while, as articles do. " * 3000 + "</p>"
    page = f"<html><body><nav><a href='/'>Home</a></nav><article class='{' '.join(f'c{i}' for i in range(200))}'><h1>Title of it</h1>{body}</article></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (2, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.digest(df).collect()}
    assert got[2] == ("", 0) and got[1][1] == len(got[1][0]) > 200_000 and "Home" not in got[1][0]
    assert html_text.digest(df.limit(0)).count() == 0

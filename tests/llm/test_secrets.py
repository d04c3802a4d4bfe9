"""The character models on held-out secrets and identifiers that no sample holds; long texts; clashing names; empty tables."""

import base64
import random
import string

from pyspark.sql import functions as F

from plotweave.llm import secrets

WORDS = (
    "max connection pool upload progress download retry limit cache region cluster billing invoice customer shipment ledger adapter gateway socket upstream snapshot backup restore migrate schema column partition replica"
    " scheduler worker queue topic consumer producer metric gauge histogram trace span tracer logger appender layout widget toolbar sidebar dialog modal tooltip canvas vertex shader texture polygon mesh camera"
    " payment refund coupon basket checkout catalog product stock warehouse supplier delivery address country currency exchange account profile avatar session cookie header footer locale translation timezone calendar"
).split()


def planted(seed, n):
    """Random strings of eight kinds, 20 characters or more, none of which a base pattern has."""
    r = random.Random(seed)
    alnum, hexed = string.ascii_letters + string.digits, "0123456789abcdef"
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    kinds = [
        lambda: base64.b64encode(r.randbytes(30)).decode(), lambda: base64.urlsafe_b64encode(r.randbytes(24)).decode(), lambda: of(alnum, 32), lambda: of(alnum, 20),
        lambda: "ghp_" + of(alnum, 36), lambda: "sk_live_" + of(alnum, 24), lambda: of(string.ascii_uppercase + string.digits, 28), lambda: of(hexed, 31),
    ]
    return [[k() for _ in range(n)] for k in kinds]


def identifiers(seed, n):
    r = random.Random(seed)
    pick = lambda k: [r.choice(WORDS) for _ in range(k)]
    date = lambda sep: f"{r.randrange(1995, 2035)}{sep}{r.randrange(1, 13):02}{sep}{r.randrange(1, 29):02}"
    kinds = [
        lambda: "_".join(pick(4)).upper(), lambda: "_".join(["test", *pick(2), date("_"), *pick(1)]), lambda: r.choice(["XML", "HTTP", "JSON", "DB", "URL"]) + "".join(w.capitalize() for w in pick(4)),
        lambda: "-".join(["com", *pick(3), f"v{r.randrange(9)}", "deployment", str(r.randrange(20))]), lambda: "/".join(["src", *pick(4)]), lambda: "".join([pick(1)[0], *(w.capitalize() for w in pick(4))]),
        lambda: "_".join([*pick(3), str(r.randrange(1000))]) + "_final", lambda: "-".join([*pick(2), date("-"), *pick(2)]), lambda: "=" * 24, lambda: "_".join(pick(5)),
    ]
    return [[x for x in (k() for _ in range(n)) if len(x) >= 20] for k in kinds]


def test_held_out_strings(spark, sf):
    model = secrets.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    kinds = [("secret", k, s) for k, x in enumerate(planted(21, 300)) for s in x] + [("plain", k, s) for k, x in enumerate(identifiers(22, 300)) for s in x]
    rows = spark.createDataFrame(kinds, "label string, kind long, text string")
    found, name = secrets.scan(rows, model)
    got = found.groupBy("label", "kind").agg(F.avg((F.size(F.col(name)["spans"]) > 0).cast("double")).alias("share")).collect()
    share = {(r.label, r.kind): round(r.share, 3) for r in got}
    print(share)
    assert all(v >= 0.9 for (label, _), v in share.items() if label == "secret"), share
    assert sum(v for (label, _), v in share.items() if label == "plain") / 10 <= 0.01, share
    named = ["MAX_CONNECTION_POOL_SIZE", "test_case_2024_01_15_results", "XMLHttpRequestUploadProgress", "com-example-service-v2-deployment-7", "getUserNameFromDatabaseConnection"]
    plain, name = secrets.scan(spark.createDataFrame([(x,) for x in named], "text string"), model)
    assert plain.filter(F.size(F.col(name)["spans"]) > 0).count() == 0


def test_many_matches_are_placed_exactly(spark):
    """More matches than STEP in one text, of two kinds, against Python's places."""
    import re

    text = " ".join(f"é AKIA{i:016d}" if i % 3 else "0123456789abcdef" * 2 for i in range(3 * secrets.STEP))
    got = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = sorted([(m.start(), "access", m.end()) for m in re.finditer(secrets.ACCESS, text)] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]{32,}", text)])
    assert got.spans == ",".join(f"{k}:{a}:{b}" for a, k, b in want) and got.n_access == 2 * secrets.STEP


def test_names_may_clash_and_tables_be_empty(spark, sf):
    model = secrets.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    key = base64.b64encode(random.Random(3).randbytes(30)).decode()
    rows = spark.createDataFrame([(1, f"a {key} b", "keep", 5), (1, f"a {key} b", "keep", 5), (None, None, None, None)], "doc_id long, text string, secret_spans string, s long")
    found, name = secrets.scan(rows, model)
    assert name != "secret_spans" and found.columns == [*rows.columns, name]
    clean = secrets.redact(rows, model=model)
    assert clean.columns == rows.columns and [r.text for r in clean.orderBy("doc_id").collect()] == [None, "a [SECRET] b", "a [SECRET] b"]
    assert [r.secret_spans for r in clean.orderBy("doc_id").collect()] == [None, "keep", "keep"]
    empty = rows.limit(0)
    assert secrets.redact(empty).count() == 0 and secrets.digest(empty).count() == 0

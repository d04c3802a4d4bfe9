"""The pipeline's stages on null ids and texts, repeated rows and ids, clashing names and empty tables."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory, sf):
    import os

    d = tmp_path_factory.mktemp("sf")
    for name in ("labels", "benchmark"):
        os.symlink(f"{sf}/{name}.parquet", d / f"{name}.parquet")
    return str(d)


def rows(spark):
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    plain = [text(60) for _ in range(40)]
    near = plain[0].split()
    near[3] = "changed"
    body = [(k, t, "en", f"src{k % 3}", len(t), f"x{k}", k, "r") for k, t in enumerate(plain)]
    body += [(None, text(50), None, None, None, None, None, None), (None, None, "en", "src0", 0, None, None, None), (70, "", "en", "src1", 0, "e", 1, "r"), (71, plain[1], "en", "src1", 9, "copy", 2, "r"), (72, " ".join(near), "en", "src2", 9, "near", 3, "r")]
    body += [body[2], (5, text(40), "de", "src2", 1, "same id", 4, "r"), (73, plain[7] + " password = hunter2hunter2", "en", "src0", 5, "s", 5, "r"), (74, text(9000), "en", "src0", 5, "long", 6, "r")]
    return spark.createDataFrame(body, "doc_id long, text string, lang string, source string, n_chars long, secret_spans string, copy long, `group` string")


def test_stages(spark, folder):
    docs = rows(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixture":
            assert out.columns == docs.columns, name
            assert stage(spark, docs.limit(0), folder).count() == 0, name
        kept[name] = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    every = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert kept["toxicity"] == every or len(kept["toxicity"]) >= len(every) - 1  # made words are clean
    left = kept["near_duplicates"]
    assert len(left) == len(set(left)) == len(every) - 4  # the exact copy, the near copy, the repeated row and what is near to it go, one of each group stays
    assert (-1, "") in left and (70, "") in left and sum(i == 5 for i, _ in left) == 2
    assert kept["decontamination"] == every
    masked = dict((i, t) for i, t in kept["secrets"] if i == 73)
    assert "hunter2" not in masked[73] and "[SECRET]" in masked[73]
    assert {i for i, _ in kept["mixture"]} <= {i for i, _ in every}

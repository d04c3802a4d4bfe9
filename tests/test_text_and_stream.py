from pyspark.sql import functions as F

from plotweave.functions import text as X
from plotweave.streaming import incremental


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


def test_text_functions(spark):
    assert value(spark, "[item=x] a  [b]b[/b]", X.strip_rich_text) == "a b"
    assert value(spark, "going North then east, northern", lambda c: X.rotate_words(c, 1)) == "going East then south, northern"
    assert value(spark, "a\nb\nc\nd\ne\nf", lambda c: X.shorten(c, 1)) == "a\n... 4 lines omitted ...\nf"
    assert value(spark, "x ```python\nlong code\n``` y ```\nz\n```", X.extract_code) == "long code"
    assert value(spark, "\n".join(["q"] * 8), X.is_stuck_in_repetition) and not value(spark, "\n".join(["q"] * 7), X.is_stuck_in_repetition)
    assert value(spark, "привет", X.prompt_language) == "ru"
    assert value(spark, "retry in 12.5s", X.retry_delay) == 12.5
    assert value(spark, None, X.is_stuck_in_repetition) is False


def test_replayed_stream_changes_nothing(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string").write.parquet(src)
    read = lambda: spark.readStream.schema("id long, text string").parquet(src)
    incremental.ingest(read(), store, str(tmp_path / "c1"), "id", "text").awaitTermination()
    spark.createDataFrame([(4, "b"), (5, "c")], "id long, text string").write.mode("append").parquet(src)
    incremental.ingest(read(), store, str(tmp_path / "c1"), "id", "text").awaitTermination()
    incremental.ingest(read(), store, str(tmp_path / "c2"), "id", "text").awaitTermination()  # everything again
    assert sorted((r.id, r.text) for r in spark.read.parquet(store).collect()) == [(1, "a"), (3, "b"), (5, "c")]

"""Text and record functions against plain Python forms, sources and sinks by round trips."""

import json
import random

from pyspark.sql import functions as F

from plotweave.functions import text as X
from plotweave.operators import records as R
from plotweave.plans import record_queries
from tests.conftest import SF


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_lines_are_those_of_python(spark):
    texts = ["a\r\nb\n", "x\x0by\x0cz", "\n\n", "one", "a b", " \t\n q"]
    assert values(spark, texts, X.lines_of) == [t.splitlines() for t in texts]
    assert values(spark, texts, X.strip) == [t.strip() for t in texts]
    stuck = ["\n".join(["q "] * 7 + ["\tq"]), "\r\n".join(["q"] * 8) + "\r\n\r\n", "\n".join(["q"] * 7 + ["r"])]
    assert values(spark, stuck, X.is_stuck_in_repetition) == [True, True, False]


def test_compass_words(spark):
    texts = ["North, NORTH and north to northern", "на север и Северный вход, юго-запад", "Восточная сторона"]
    assert values(spark, texts, lambda c: X.rotate_words(c, 1)) == ["East, East and east to northern", "на восток и Восточный вход, западо-север", "Южная сторона"]
    assert values(spark, texts, lambda c: X.rotate_words(c, 4)) == texts


def test_scalars(spark):
    assert values(spark, [None, " North ", "s", "12", "5", "up"], X.resolve_direction) == [0, 0, 8, 12, None, None]
    assert values(spark, ["retryDelay: '7.5s'", "please retry in 12s", "no"], X.retry_delay) == [7.5, 12.0, None]
    assert values(spark, ["out 0eNqVkd1qwzAMhd/F1ymkP x", "0eshort"], X.layout_in_output) == ["0eNqVkd1qwzAMhd/F1ymkP", None]
    assert values(spark, ['{"favorites": {"a": 1, "b": 2}}', '{"favorites": 7}', '{"numberOfFavorites": "x"}', "{}"], X.favorites_of) == [2, 7, 0, 0]
    assert values(spark, ["Qwen2.5-7B", "Meta-Llama-3-8B", "other"], X.model_template) == ["qwen", "llama3", None]
    assert values(spark, ["labb", "lab", "zzzz"], X.close_names(["lab", "label", "pipe"])) == [["lab", "label"], [], []]
    tags = spark.createDataFrame([(["/mods/vanilla/", "/planets/nauvis/"],), (["/mods/x/"],), (["/planets/gleba/"],), (None,)], "t array<string>")
    assert [r.v for r in tags.select(X.is_vanilla(F.col("t")).alias("v")).collect()] == [True, False, False, True]
    row = spark.createDataFrame([(False, "bad", "o", "\n".join(map(str, range(30)))), (False, None, "out", " "), (True, "x", "y", "z")], "s boolean, e string, o string, r string")
    got = [r.v for r in row.select(X.run_feedback(*(F.col(c) for c in "seor")).alias("v")).collect()]
    assert got[0] == "Error summary: bad\n\nTraceback / Stderr:\n```\n" + "\n".join(map(str, range(5, 30))) + "\n```" and got[1] == "Stdout:\n```\nout\n```" and got[2] == ""


def plain_fit(messages, most):
    total = lambda ms: sum(len(m["content"]) // 3 for m in ms)
    ms = [dict(m) for m in messages]
    for role in ("assistant", "user"):
        for keep in X.KEPT_LINES:
            if total(ms) <= most:
                return ms
            for m in ms:
                lines = m["content"].split("\n")
                if m["role"] == role and len(lines) > 2 * keep + 1:
                    m["content"] = "\n".join([*lines[:keep], X.MARKS[role].format(n=len(lines) - 2 * keep), *lines[-keep:]])
    return ms


def test_histories_fit_as_step_by_step(spark):
    r = random.Random(1)
    chats = [[{"role": r.choice(["user", "assistant", "system"]), "content": "\n".join("w" * r.randrange(40) for _ in range(r.randrange(1, 120)))} for _ in range(r.randrange(1, 6))] for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(chats)), "i int, m array<struct<role:string,content:string>>")
    got = df.select("i", X.fit_history(F.col("m"), 300).alias("v")).collect()
    for row in got:
        want = plain_fit(chats[row.i], 300)
        assert [(m.role, m.content) for m in row.v.messages] == [(m["role"], m["content"]) for m in want]
        assert row.v.fits == (sum(len(m["content"]) // 3 for m in want) <= 300)
    assert record_queries.fitted_histories(spark, SF).count() > 0


def test_tables_and_json(spark, tmp_path):
    parents, children = spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1, "a"), (3, "b")], "canonical_id bigint, prompt string")
    assert [r.prompt for r in R.cascaded(children, parents, "canonical_id", "id").collect()] == ["a"]
    placed = spark.createDataFrame([('[["pipe",1,-2,0,{}],["lab",3,4,8,{"modules":"speed-module=2"}]]',)], "ir string")
    back = placed.select(R.placed_to_json(R.placed_from_json(F.col("ir"))).alias("j")).first().j
    assert json.loads(back) == [["pipe", 1, -2, 0, {}], ["lab", 3, 4, 8, {"modules": "speed-module=2"}]]
    raw = spark.createDataFrame([("a", '{"title": "t", "favorites": 5, "tags": ["x"], "blueprintString": "0e"}'), ("b", "{broken")], "key string, raw_data string")
    assert [tuple(r) for r in R.cached(raw).collect()] == [("a", 5, ["x"], "t", "0e")]
    rows = spark.createDataFrame([(k, k, f"key{k}", "make labs", "code " * (3 if k % 5 else 5000), ["x"] if k == 3 else [], 90) for k in range(60)], "id bigint, prompt_id bigint, blueprint_key string, prompt string, code string, conflicts array<string>, rotation int")
    found = R.export_records(rows, "system", eval_fraction=0.4)
    R.write_jsonl(found, str(tmp_path / "out"))
    train, held = (R.read_jsonl(spark, str(tmp_path / "out" / s)) for s in ("train", "eval"))
    assert train.count() + held.count() == found.filter("dropped is null").count() == 47 and held.count() > 0
    assert train.first().messages[1].content == "make labs" and found.filter("id = 3").first().dropped == "count_conflict"
    facts = spark.createDataFrame([(1, "[item=x] name ", "", ([("lab", 2)] * 1, {}, {"yellow": 3}, [], "east", 4, 5))], "id int, label string, title string, facts struct<entity_counts:array<struct<name:string,count:int>>,recipes:map<string,int>,belt_tiers:map<string,int>,label_signals:array<string>,main_belt_direction:string,width:int,height:int>")
    payload = json.loads(R.facts_payload(facts).first().payload)
    assert payload == {"id": 1, "label": "name", "title": None, "entity_counts": {"lab": 2}, "recipes": None, "belt_tiers": {"yellow": 3}, "label_signals": None, "main_belt_direction": "east", "width": 4, "height": 5}


def test_canonical_stage_pull_and_retries(spark):
    rows = spark.createDataFrame([("a", 0, 9, "same"), ("b", 0, 5, "same"), ("c", 0, 4, "other"), ("d", 0, 1, "x" * 20000)], "key string, book_pos int, favorites int, code string")
    ranked = R.by_popularity(rows, 1).selectExpr("key", "book_pos", "rank", "1 AS major", "0 AS minor", "9 AS n_entities", "cast(null AS string) AS reject", "code")
    known = ranked.filter("key = 'c'").select(F.sha2("code", 256).alias("code_hash"), F.lit("z").alias("blueprint_key"))
    done = spark.createDataFrame([], "blueprint_key string")
    got = {r.key: (r.status, r.winner) for r in R.canonical_stage(ranked, done, known).collect()}
    assert got == {"a": ("pending", None), "b": ("duplicate", "a"), "c": ("duplicate", "z"), "d": ("too_long", None)}
    assert {r.key for r in R.canonical_stage(ranked, done, known, limit=2).collect()} == {"a", "b"}
    assert [r.key for r in R.pull(rows, rows.filter("key = 'a'"), 2).collect()] == ["b", "c"]
    tried = R.retries(lambda df, k: df.withColumn("error", F.when(F.col("book_pos") + F.col("favorites") > 4 * k, "bad")), F.col("error"), rows.select("key", "book_pos", "favorites"), 2)
    assert {r.key: (r.attempts, r.error) for r in tried.collect()} == {"a": (2, "bad"), "b": (2, None), "c": (1, None), "d": (1, None)}

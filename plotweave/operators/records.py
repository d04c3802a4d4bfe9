"""The record pipeline's tables, sources, sinks and candidate chain. Keys are unique by construction; what SQL would cascade is a semi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.functions import text as X
from plotweave.operators import relational as R

BLUEPRINTS = "key string, title string, blueprint_string string, favorites int, created_at timestamp_ntz, raw_data string"
CANONICAL = (
    "id bigint, blueprint_key string, book_index string, label string, title string, canonical_code string, code_hash string, facts string, ir string, n_tokens int, status string, error string, updated_at timestamp_ntz"
)
PROMPTS = "id bigint, canonical_id bigint, lang string, prompt string, model string, created_at timestamp_ntz"
#: A layout's entities as JSON: a list of [name, x, y, direction, {setting: value}].
PLACED = "array<struct<name:string,x:int,y:int,direction:int,extras:map<string,string>>>"
#: Entities and tokens that a candidate may have, the oldest version (0.0 is one without a version), tokens of a chat's frame, of a record.
ENTITIES, CODE_TOKENS, OLDEST, FRAME, RECORD = (4, 500), 3600, (0, 15), 30, 4096


def unique(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in an order: what a primary key allows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cascaded(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """The children whose parent exists: what is left after a delete that cascades."""
    return children.join(parents.select(F.col(parent).alias(child)).distinct(), child, "left_semi")


def canonical_rows(rows: DataFrame) -> DataFrame:
    """Rows with the defaults of the canonical table: no place in a book, status pending; one row of each place, the latest."""
    full = rows.withColumns({"book_index": F.coalesce("book_index", F.lit("")), "status": F.coalesce("status", F.lit("pending"))})
    return unique(full, ["blueprint_key", "book_index"], [F.col("updated_at").desc_nulls_last(), F.col("id").desc()])


def by_popularity(rows: DataFrame, least: int) -> DataFrame:
    """Rows of so many favourites or more with their rank, a struct that sorts by favourites, then key: the order that decides which duplicate wins."""
    return rows.filter(F.col("favorites") >= least).withColumn("rank", F.struct((-F.col("favorites")).alias("less"), F.col("key").alias("key")))


def cached(raw: DataFrame) -> DataFrame:
    """key, favorites, tags, title, blueprint_string of the stored JSON rows (key, raw_data); rows whose JSON can't be read are left out."""
    value = F.from_json("raw_data", "title string, blueprintString string, tags array<string>", {"mode": "PERMISSIVE"})
    readable = F.try_parse_json("raw_data").isNotNull()
    return raw.filter(readable).select("key", X.favorites_of(F.col("raw_data")).alias("favorites"), value["tags"].alias("tags"), value["title"].alias("title"), value["blueprintString"].alias("blueprint_string"))


def cache_rows(fetched: DataFrame) -> DataFrame:
    """Rows of the blueprint table from fetched JSON (key, raw_data): favourites as a number, whatever their shape."""
    value = F.from_json("raw_data", "title string, blueprintString string")
    return fetched.select("key", value["title"].alias("title"), value["blueprintString"].alias("blueprint_string"), X.favorites_of(F.col("raw_data")).alias("favorites"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"), "raw_data")


def pull(keys: DataFrame, stored: DataFrame, first: int | None = None) -> DataFrame:
    """The keys that aren't stored yet, in order, the first so many where a batch is limited."""
    new = R.pending(keys.select("key").distinct(), stored.select("key"), ["key"]).orderBy("key")
    return new if first is None else new.limit(first)


def merged(fresh: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Fresh rows and those stored rows whose key none of them has."""
    return fresh.unionByName(stored.join(fresh.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def candidates(rows: DataFrame, tokens=X.token_count) -> DataFrame:
    """rows with status and winner: version, size, code, duplicate, too_long or pending, the first that applies.

    rows: key, book_pos, rank (the order that decides), major, minor, n_entities, reject (the parser's reason or null), code. A script that is too long
    never wins; one whose hash has a winner is a duplicate before its length is looked at.
    """
    version = (F.col("major") * 1000 + F.col("minor") < OLDEST[0] * 1000 + OLDEST[1]) & ~((F.col("major") == 0) & (F.col("minor") == 0))
    early = F.when(version, "old_version").when(F.col("n_entities") < ENTITIES[0], "too_small").when(F.col("n_entities") > ENTITIES[1], "too_large").when(F.col("reject").isNotNull(), F.concat(F.lit("parse_"), "reject")).when(F.col("code").isNull(), "lift_error")
    checked = rows.withColumns({"_early": early, "_hash": F.sha2("code", 256), "_tokens": tokens(F.col("code"))})
    w = Window.partitionBy("_hash").orderBy("rank", "key", "book_pos")
    fits = F.col("_early").isNull() & (F.col("_tokens") <= CODE_TOKENS)
    earlier = F.first(F.when(fits, F.struct("key", "book_pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = checked.withColumn("_winner", F.when(F.col("_early").isNull(), earlier))
    status = F.coalesce("_early", F.when(F.col("_winner").isNotNull(), F.lit("duplicate")), F.when(F.col("_tokens") > CODE_TOKENS, F.lit("too_long")), F.lit("pending"))
    return ranked.select(*rows.columns, F.col("_hash").alias("code_hash"), F.col("_tokens").alias("n_tokens"), status.alias("status"), F.col("_winner.key").alias("winner"))


def reject_counts(found: DataFrame, capped: DataFrame) -> DataFrame:
    """reason, n: how many candidates ended with each status, and how many books lost children to the cap (each once). capped: key."""
    return found.groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("n")).union(capped.select("key").distinct().agg(F.lit("book_cap").alias("reason"), F.count("*").alias("n")))


def canonical_stage(rows: DataFrame, done: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    """The candidates of the rows whose key isn't done, against the hashes of other keys that are known (code_hash, blueprint_key)."""
    work = R.pending(rows, done.select(F.col("blueprint_key").alias("key")).distinct(), ["key"])
    if limit is not None:
        work = work.join(work.select("key", "rank").distinct().orderBy("rank").limit(limit).select("key"), "key", "left_semi")
    found = candidates(work)
    other = known.select("code_hash", F.col("blueprint_key").alias("other")).groupBy("code_hash").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    joined = found.join(other, "code_hash", "left")
    elsewhere = F.when(F.col("low") != F.col("key"), F.col("low")).when(F.col("high") != F.col("key"), F.col("high"))
    taken = (F.col("status") == "pending") & elsewhere.isNotNull()
    return joined.withColumns({"winner": F.when(taken, elsewhere).otherwise(F.col("winner")), "status": F.when(taken, "duplicate").otherwise(F.col("status"))}).drop("low", "high")


def placed_from_json(ir: Column) -> Column:
    """The entities of a list of lists, by their places in each."""
    rows = F.from_json(ir, "array<array<string>>")
    return F.transform(rows, lambda r: F.struct(F.get(r, F.lit(0)).alias("name"), F.get(r, F.lit(1)).cast("int").alias("x"), F.get(r, F.lit(2)).cast("int").alias("y"), F.get(r, F.lit(3)).cast("int").alias("direction"), F.from_json(F.get(r, F.lit(4)), "map<string,string>").alias("extras")))


def placed_to_json(entities: Column) -> Column:
    """The list of lists of an array of entities."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    row = lambda e: F.concat(F.lit("["), F.concat_ws(",", quoted(e["name"]), e["x"].cast("string"), e["y"].cast("string"), e["direction"].cast("string"), F.coalesce(F.to_json(e["extras"]), F.lit("{}"))), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(entities, row), ","), F.lit("]"))


def snap_of(facts: Column) -> Column:
    """struct<w, h, absolute, dx, dy> from stored facts, or null without a grid."""
    f = F.from_json(facts, "snap array<int>, absolute_snapping boolean, snap_offset array<int>")
    away = lambda k: F.coalesce(F.get(f["snap_offset"], F.lit(k)), F.lit(0))
    value = F.struct(F.get(f["snap"], F.lit(0)).alias("w"), F.get(f["snap"], F.lit(1)).alias("h"), F.coalesce(f["absolute_snapping"], F.lit(False)).alias("absolute"), away(0).alias("dx"), away(1).alias("dy"))
    return F.when(F.size(f["snap"]) == 2, value)


def facts_payload(rows: DataFrame) -> DataFrame:
    """id and the JSON that a prompt writer gets: label and title without marks, the first 12 counts, and facts that are there (empty ones are null).

    rows: id, label, title, facts (struct: entity_counts array of name, count; recipes, belt_tiers maps; label_signals array; main_belt_direction, width, height).
    """
    text = lambda c: F.nullif(X.strip_rich_text(F.col(c)), F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    body = F.struct(
        "id", text("label").alias("label"), text("title").alias("title"), F.map_from_entries(F.slice("facts.entity_counts", 1, 12)).alias("entity_counts"), some("facts.recipes").alias("recipes"), some("facts.belt_tiers").alias("belt_tiers"),
        some("facts.label_signals").alias("label_signals"), F.col("facts.main_belt_direction").alias("main_belt_direction"), F.col("facts.width").alias("width"), F.col("facts.height").alias("height"),
    )
    return rows.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def answered(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of the batches (batch, local_id, canonical_id) with the model's prompts (batch, local_id, lang, prompt); answers to unknown ids are ignored."""
    return batches.join(answers, ["batch", "local_id"]).drop("local_id")


def export_records(rows: DataFrame, system: str, *, eval_fraction: float = 0.03, most: int = RECORD, tokens=X.token_count) -> DataFrame:
    """split, lang, n_tokens, order (id, prompt_id), record of each row that fits (null status reasons in dropped). rows: id, prompt_id, blueprint_key, prompt, code, conflicts (array), rotation."""
    n = tokens(F.lit(system)) + tokens(F.col("prompt")) + tokens(F.col("code")) + FRAME
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    lang = X.prompt_language(F.col("prompt"))
    record = F.struct(
        F.array(role("system", F.lit(system)), role("user", F.col("prompt")), role("assistant", F.col("code"))).alias("messages"),
        F.struct(F.col("id").alias("canonical_id"), "blueprint_key", lang.alias("lang"), F.col("rotation").alias("rotation")).alias("meta"),
    )
    split = F.when(X.stable_fraction(F.col("blueprint_key")) < eval_fraction, "eval").otherwise("train")
    dropped = F.when(F.size("conflicts") > 0, "count_conflict").when(n > most, "too_long")
    return rows.select("id", "prompt_id", split.alias("split"), lang.alias("lang"), n.alias("n_tokens"), dropped.alias("dropped"), record.alias("record"))


def export_counters(found: DataFrame) -> DataFrame:
    """counter, n: kept records by split and language, dropped ones by reason, turned ones."""
    name = F.coalesce(F.concat(F.lit("dropped_"), "dropped"), F.concat_ws("_", "split", "lang"))
    turned = found.filter("dropped is null and record.meta.rotation > 0").agg(F.lit("rotated").alias("counter"), F.count("*").alias("n"))
    return found.groupBy(name.alias("counter")).agg(F.count("*").alias("n")).union(turned)


def write_jsonl(found: DataFrame, path: str) -> None:
    """The kept records as JSON lines, a folder for each split, in the order of their ids."""
    kept = found.filter("dropped is null").select("split", "id", "prompt_id", F.to_json("record").alias("value"))
    for split in ("train", "eval"):
        kept.filter(F.col("split") == split).repartitionByRange("id", "prompt_id").sortWithinPartitions("id", "prompt_id").select("value").write.text(f"{path}/{split}")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON lines; blank lines are left out."""
    schema = "messages array<struct<role:string,content:string>>, meta struct<canonical_id:bigint,blueprint_key:string,lang:string,rotation:int>"
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def retries(attempt, problem, first: DataFrame, most: int) -> DataFrame:
    """Bounded retries over a whole table: attempt(rows, k) gives rows with an outcome, problem is a column that is null where one succeeded.

    Each round takes the rows that failed so far; the result has each row's last outcome and attempts, how many it took.
    """
    done, open_ = None, first
    for k in range(1, most + 1):
        tried = attempt(open_, k).withColumn("attempts", F.lit(k))
        ended = tried if k == most else tried.filter(problem.isNull())
        done = ended if done is None else done.unionByName(ended)
        if k < most:
            open_ = tried.filter(problem.isNotNull()).select(first.columns)
    return done

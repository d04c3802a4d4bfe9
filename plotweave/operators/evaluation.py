"""Evaluation of generated layouts: expectations, scores of cases, summaries by grouping sets, rescoring and corpus rates.

A case is a row of CASE, an outcome one of OUTCOME, a result one of RESULT. Absent checks are null, and rates count what isn't null only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions import text as X

COUNTS = "array<struct<name:string,count:int>>"
CASE = (
    "id string, set string, prompt string, counts map<string,int>, recipes map<string,int>, belt_tier string, contains array<string>, contains_any array<string>, recipes_any array<string>, reference_warnings_per_100 double"
)
#: What a run gave: the script, how it ended, and the facts and issues of its layout (facts null where there is none).
OUTCOME = (
    "id string, code string, exec_ok boolean, error string, gen_tokens int, gen_seconds double, attempts int, valid_first_attempt boolean,"
    f" facts struct<entity_counts:{COUNTS},recipes:map<string,int>,belt_tiers:{COUNTS},total_entities:int>, errors map<string,int>, warnings map<string,int>"
)
CHECK = "struct<entity:string,expected:int,actual:int,exact:boolean,within10:boolean>"
#: The kinds of entities whose numbers say what was asked for.
KEY_KINDS = (
    "furnace", "assembling-machine", "lab", "solar-panel", "accumulator", "boiler", "generator", "mining-drill", "beacon", "reactor", "roboport", "ammo-turret", "electric-turret", "fluid-turret", "offshore-pump", "rocket-silo",
)
RATES = ("complete", "exec_ok", "valid", "belt_tier_ok", "contains_ok")


def total_of(counts: Column) -> Column:
    return F.aggregate(F.coalesce(F.map_values(counts), F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)


def warnings_per_100(warnings: Column, total: Column) -> Column:
    return 100.0 * warnings / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1))


def dominant(counts: Column) -> Column:
    """The name of the largest count, the first of equal ones; counts are in the order in which they were first seen."""
    numbers = F.transform(counts, lambda c: c["count"])
    return F.when(F.size(counts) > 0, F.get(counts, (F.array_position(numbers, F.array_max(numbers)) - 1).cast("int"))["name"])


def expectations(facts: DataFrame, kinds: DataFrame) -> DataFrame:
    """id, counts, belt_tier, contains: what a reference layout's facts make one expect. facts: id, entity_counts, belt_tiers; kinds: name, kind."""
    key = [r["name"] for r in kinds.filter(F.col("kind").isin(*KEY_KINDS)).select("name").distinct().collect()]  # a row a prototype
    kept = F.filter("entity_counts", lambda c: F.array_contains(F.array(*map(F.lit, key)), c["name"]))
    names = F.transform("entity_counts", lambda c: c["name"])
    return facts.select("id", F.map_from_entries(kept).alias("counts"), dominant(F.col("belt_tiers")).alias("belt_tier"), F.when(F.size(kept) == 0, F.slice(names, 1, 3)).alias("contains"))


def sampled_cases(records: DataFrame, limit: int) -> DataFrame:
    """id, set, prompt, code of the first records by the hash of their prompt. records: messages (role, content: system, question, answer)."""
    prompt, code = F.col("messages")[1]["content"], F.col("messages")[2]["content"]
    h = F.sha2(prompt, 256)
    return records.select(F.concat(F.lit("B-"), F.substring(h, 1, 10)).alias("id"), F.lit("B").alias("set"), prompt.alias("prompt"), code.alias("code"), h.alias("h")).orderBy("h").limit(limit).drop("h")


def fixed_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON list (id, prompt, expect), as CASE."""
    expect = "expect struct<counts:map<string,int>,recipes:map<string,int>,belt_tier:string,contains:array<string>,contains_any:array<string>,recipes_any:array<string>>"
    rows = spark.read.schema(f"id string, prompt string, {expect}").option("multiLine", True).json(path)
    return rows.select("id", F.lit("A").alias("set"), "prompt", *(f"expect.{c}" for c in ("counts", "recipes", "belt_tier", "contains", "contains_any", "recipes_any")), F.lit(None).cast("double").alias("reference_warnings_per_100"))


def _checks(expected: Column, actual: Column, prefix: str) -> Column:
    def check(e):
        n = F.coalesce(F.element_at(actual, e["key"]), F.lit(0))
        off = F.abs(n - e["value"])
        return F.struct(F.concat(F.lit(prefix), e["key"]).alias("entity"), e["value"].alias("expected"), n.alias("actual"), (off == 0).alias("exact"), (off <= F.greatest(F.lit(1.0), e["value"] * 0.1)).alias("within10"))

    return F.coalesce(F.transform(F.map_entries(expected), check), F.array().cast(f"array<{CHECK}>"))


def score(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A result for each case that has an outcome."""
    o = outcomes.join(cases, "id")
    counts = F.map_from_entries(F.coalesce("facts.entity_counts", F.array().cast(COUNTS)))
    made = F.coalesce("facts.recipes", F.create_map().cast("map<string,int>"))
    there, have = F.map_keys(counts), F.col("facts").isNotNull()
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    wanted = [
        F.when(some(F.col("contains")), F.size(F.array_except("contains", there)) == 0), F.when(some(F.col("contains_any")), F.size(F.array_intersect("contains_any", there)) > 0),
        F.when(some(F.col("recipes_any")), F.size(F.array_intersect("recipes_any", F.map_keys(made))) > 0),
    ]
    asked = F.filter(F.array(*wanted), lambda c: c.isNotNull())
    valid = F.col("exec_ok") & have & (total_of(F.col("errors")) == 0)
    return o.select(
        "id", "set", "prompt", X.code_problem(F.col("code")).isNull().alias("complete"), F.coalesce("exec_ok", F.lit(False)).alias("exec_ok"),
        F.when(~F.coalesce("exec_ok", F.lit(False)), F.substring(F.coalesce("error", F.lit("")), 1, 300)).alias("error"), F.coalesce(valid, F.lit(False)).alias("valid"),
        F.coalesce(F.map_zip_with(F.coalesce("errors", F.create_map().cast("map<string,int>")), F.coalesce("warnings", F.create_map().cast("map<string,int>")), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), F.create_map().cast("map<string,int>")).alias("issues"),
        F.coalesce("facts.total_entities", F.lit(0)).alias("total_entities"), F.coalesce("gen_tokens", F.lit(0)).alias("gen_tokens"), F.round(F.coalesce("gen_seconds", F.lit(0.0)), 2).alias("gen_seconds"),
        F.concat(_checks(F.col("counts"), counts, ""), _checks(F.col("recipes"), made, "recipe:")).alias("count_checks"),
        F.when(F.col("belt_tier").isNotNull(), F.coalesce(dominant(F.col("facts.belt_tiers")) == F.col("belt_tier"), F.lit(False))).alias("belt_tier_ok"),
        F.when(F.size(asked) > 0, F.forall(asked, lambda c: c)).alias("contains_ok"),
        F.when(have, F.round(warnings_per_100(total_of(F.col("warnings")), F.col("facts.total_entities")), 2)).alias("warnings_per_100"),
        F.round("reference_warnings_per_100", 2).alias("reference_warnings_per_100"), F.coalesce("attempts", F.lit(1)).alias("attempts"), F.coalesce("valid_first_attempt", valid, F.lit(False)).alias("valid_first_attempt"),
    )


def summarize(results: DataFrame) -> DataFrame:
    """block ('all' and each set) with n, the rates, medians, means and the issues added up ({name: count}). Rates are null where nothing was checked."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 3).alias(c)
    both = F.when(F.col("warnings_per_100").isNotNull(), F.col("reference_warnings_per_100"))
    block = F.coalesce("set", F.lit("all")).alias("block")
    main = results.groupingSets([[], ["set"]], "set").agg(
        F.count("*").alias("n"), *(rate(c) for c in RATES), rate("valid_first_attempt"), F.round(F.median("warnings_per_100"), 2).alias("median_warnings_per_100"), F.round(F.median(both), 2).alias("median_reference_warnings_per_100"),
        F.round(F.avg("gen_tokens"), 1).alias("mean_gen_tokens"), F.round(F.avg("gen_seconds"), 2).alias("mean_gen_seconds"), F.round(F.avg("attempts"), 2).alias("mean_attempts"),
    ).select(block, "*").drop("set")
    checks = results.select("set", F.explode("count_checks").alias("c")).groupingSets([[], ["set"]], "set")
    checks = checks.agg(F.round(F.avg(F.col("c.exact").cast("double")), 3).alias("count_exact"), F.round(F.avg(F.col("c.within10").cast("double")), 3).alias("count_within10")).select(block, "count_exact", "count_within10")
    by_name = results.select("set", F.explode("issues").alias("name", "n")).groupingSets([[], ["set"], ["name"], ["set", "name"]], "set", "name").agg(F.sum("n").alias("n"), F.grouping("name").alias("every")).filter("every = 0")
    totals = by_name.select(block, "name", "n").groupBy("block").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "name", "n"))).alias("x"))
    totals = totals.select("block", F.transform("x", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("issue_totals"))
    return main.join(checks, "block", "left").join(totals, "block", "left")


def rescored(old: DataFrame, cases: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of the cases that an old report (id) and the present cases share, from the outcomes given; and the ids that no longer exist."""
    return score(cases.join(old.select("id").distinct(), "id", "left_semi"), outcomes), old.select("id").distinct().join(cases.select("id"), "id", "left_anti")


def reference_rates(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (blueprints, median and mean of warnings per 100 entities) and category, n of all issues. reports: total_entities, errors, warnings (maps)."""
    per = reports.select(warnings_per_100(total_of(F.col("warnings")), F.col("total_entities")).alias("rate"))
    rates = per.agg(F.count("*").alias("blueprints"), F.round(F.median("rate"), 2).alias("median_warnings_per_100"), F.round(F.avg("rate"), 2).alias("mean_warnings_per_100"))
    both = reports.select(F.explode("errors").alias("category", "n")).union(reports.select(F.explode("warnings").alias("category", "n")))
    return rates, both.groupBy("category").agg(F.sum("n").alias("n"))


def table_of(summary: DataFrame) -> DataFrame:
    """metric and a column for each block, in the order of METRICS."""
    long = summary.select("block", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for i, c in enumerate(METRICS)))).alias("x"))
    return long.groupBy("x.i", "x.metric").pivot("block").agg(F.first("x.v")).orderBy("i").drop("i")


#: The metrics of the printed table, in order.
METRICS = (
    "n", "complete", "exec_ok", "valid", "valid_first_attempt", "mean_attempts", "count_exact", "count_within10", "belt_tier_ok", "contains_ok", "median_warnings_per_100", "median_reference_warnings_per_100",
    "mean_gen_tokens", "mean_gen_seconds",
)


def save_report(results: DataFrame, path: str, adapter: str, sets: str) -> None:
    """Results and their summary as JSON lines below a new path, stamped with the time of the run."""
    stamp = F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss").alias("written")
    results.select(F.lit(adapter).alias("adapter"), F.lit(sets).alias("sets"), stamp, "*").write.json(f"{path}/results")
    summarize(results).select(F.lit(adapter).alias("adapter"), stamp, "*").write.json(f"{path}/summary")

"""Queries of the layout, design, evaluation and text operators on literal inputs; their SQL states the expected rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plotweave.functions import text as X
from plotweave.operators import catalog as C
from plotweave.operators import designs, evaluation, flow, generators, graphs, lifting, sequential, validator
from plotweave.plans.literal_expected import EXPECTED
from plotweave.sources import entity_settings as E
from plotweave.sources import layout_strings as S

L = "layout_id"


def entity(name, x, y, direction=0, size=(1, 1), **more):
    return {"name": name, "position": {"x": x + size[0] / 2, "y": y + size[1] / 2}, "direction": direction, **more}


def line(name, x, y, n, direction=4, step=(1, 0)):
    return [entity(name, x + k * step[0], y + k * step[1], direction) for k in range(n)]


def parsed(spark, layouts: dict[str, list[dict]], **options):
    rows = [(k, S.encode_one(json.dumps({"blueprint": {"entities": e, "version": 2 << 48}}))) for k, e in layouts.items()]
    found = S.entities(S.layouts(spark.createDataFrame(rows, "key string, text string"), "key", "text"), "key", **options)
    return graphs.cut(found.withColumn(L, F.substring_index(L, "#", 1)))


MACHINE = entity("assembling-machine-1", 0, 2, size=(3, 3))
POLE = entity("small-electric-pole", 2, 1)
VALID = {
    "fine": [*line("transport-belt", 0, 0, 3), entity("inserter", 1, 1), MACHINE, POLE],
    "collision": [*line("transport-belt", 0, 0, 3), entity("stone-furnace", 1, 0, size=(2, 2))],
    "head_on": [entity("transport-belt", 0, 0, 4), entity("transport-belt", 1, 0, 12)],
    "lone": [entity("underground-belt", 0, 0, 4, type="input")],
    "nested": [*line("underground-belt", 0, 0, 2), *[entity("underground-belt", x, 0, 4, type="output") for x in (2, 3)]],
    "far": [entity("underground-belt", 0, 0, 4, type="input"), entity("underground-belt", 6, 0, 4, type="output")],
    "no_poles": [*line("transport-belt", 0, 0, 3), entity("inserter", 1, 1), MACHINE],
    "unpowered": [*line("transport-belt", 0, 0, 3), entity("inserter", 1, 1), MACHINE, entity("small-electric-pole", 9, 9)],
    "islands": [entity("small-electric-pole", 0, 0), entity("small-electric-pole", 20, 0)],
    "target": [entity("burner-inserter", 0, 1), entity("stone-wall", 0, 0), entity("iron-chest", 0, 2)],
    "ground": [entity("burner-inserter", 1, 1), entity("iron-chest", 1, 2), entity("stone-wall", 1, -3)],
    "pump": [entity("offshore-pump", 0, 1, 0, size=(1, 2)), entity("pipe", 0, 0)],
    "off": [entity("pipe", 0, 0), {"name": "pipe", "position": {"x": 3.2, "y": 0.5}}],
    "unknown": [entity("pipe", 0, 0), entity("nothing", 3, 3)],
}


def validator_issues(spark, sf):
    return validator.issues(parsed(spark, VALID)).groupBy(L, "severity", "category").agg(F.count("*").alias("n"))


RECIPES = [
    ("iron-gear-wheel", "crafting", 0.5, True, [("iron-plate", 2.0, False)], [("iron-gear-wheel", 1.0, False)]),
    ("copper-cable", "crafting", 0.5, True, [("copper-plate", 1.0, False)], [("copper-cable", 2.0, False)]),
    ("electronic-circuit", "crafting", 0.5, True, [("copper-cable", 3.0, False), ("iron-plate", 1.0, False)], [("electronic-circuit", 1.0, False)]),
    ("plastic-bar", "chemistry", 1.0, True, [("coal", 1.0, False), ("petroleum-gas", 20.0, True)], [("plastic-bar", 2.0, False)]),
    ("iron-plate", "smelting", 3.2, True, [("iron-ore", 1.0, False)], [("iron-plate", 1.0, False)]),
    ("steel-plate", "smelting", 16.0, True, [("iron-plate", 5.0, False)], [("steel-plate", 1.0, False)]),
    ("inserter", "crafting", 0.5, False, [("electronic-circuit", 1.0, False), ("iron-gear-wheel", 1.0, False), ("iron-plate", 1.0, False)], [("inserter", 1.0, False)]),
    ("engine-unit", "advanced-crafting", 10.0, True, [("steel-plate", 1.0, False), ("iron-gear-wheel", 1.0, False), ("pipe", 2.0, False)], [("engine-unit", 1.0, False)]),
    ("concrete", "crafting-with-fluid", 10.0, False, [("stone-brick", 5.0, False), ("iron-ore", 1.0, False), ("water", 100.0, True)], [("concrete", 10.0, False)]),
    ("belt", "crafting", 0.5, False, [("iron-plate", 1.0, False), ("iron-gear-wheel", 1.0, False)], [("belt", 2.0, False)]),
]


def recipes(spark):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], k) for k, r in enumerate(RECIPES)], "recipe string, category string, time double, productivity boolean, ord int")


def parts(spark):
    rows = [(r[0], side, *p) for r in RECIPES for side, ps in (("in", r[4]), ("out", r[5])) for p in ps]
    return spark.createDataFrame(rows, "recipe string, side string, item string, amount double, fluid boolean")


def final_products(spark, sf):
    used = [("circuits", "copper-cable"), ("circuits", "electronic-circuit"), ("mixed", "iron-gear-wheel"), ("mixed", "inserter"), ("mixed", "belt"), ("ore", "iron-plate"), ("unknown", "no such")]
    return C.final_products(spark.createDataFrame(used, "layout_id string, recipe string"), parts(spark))


def recipe_shape_rank(spark, sf):
    return C.shape_rank(recipes(spark), parts(spark), "electronic-circuit", 5)


def recipe_tables(spark, sf):
    """Families of products, what is smelted, recipes that changed, barrels, in one table of names."""
    p = parts(spark)
    families = C.recipe_families(p.filter("side = 'out'").select("item").distinct(), recipes(spark), p).select(F.lit("family").alias("what"), F.col("item").alias("name"), F.col("family").alias("value"))
    smelted = C.smelting(recipes(spark), p).select(F.lit("smelts"), "input", "product")
    old = p.filter("not (recipe = 'concrete' and item = 'iron-ore')").withColumn("item", F.when(F.col("item") == "coal", "wood").otherwise(F.col("item")))
    changed = C.changed_recipes(old, p).select(F.lit("changed"), "recipe", F.lit(""))
    barrels = C.barrel_recipes(spark.createDataFrame([("water",)], "name string")).groupBy("recipe").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "side", "item"))), " ").alias("v")).select(F.lit("barrel"), "recipe", "v")
    return families.union(smelted).union(changed).union(barrels)


KINDS = {
    "circuits": [*[entity("assembling-machine-1", 4 * k, 0, size=(3, 3), recipe="copper-cable") for k in range(3)], *[entity("assembling-machine-1", 4 * k, 4, size=(3, 3), recipe="electronic-circuit") for k in range(2)]],
    "gears": [entity("assembling-machine-1", 4 * k, 0, size=(3, 3), recipe="iron-gear-wheel") for k in range(2)],
    "plastics": [entity("chemical-plant", 4 * k, 0, size=(3, 3), recipe="plastic-bar") for k in range(2)],
    "two_products": [entity("assembling-machine-1", 4 * k, 0, size=(3, 3), recipe=r) for k, r in enumerate(("inserter", "engine-unit"))],
    "mall": [entity("assembling-machine-1", 4 * k, 0, size=(3, 3), recipe=r) for k, r in enumerate(("inserter", "belt"))],
    "solar": [entity("solar-panel", 3 * k, 0, size=(3, 3)) for k in range(4)],
    "pump_station": [*[entity("solar-panel", 3 * k, 0, size=(3, 3)) for k in range(4)], entity("pipe", 0, 5)],
    "steam": [entity("boiler", 0, 0, size=(3, 2)), *[entity("steam-engine", 3 * k, 3, size=(3, 5)) for k in range(2)]],
    "nuclear": [entity("nuclear-reactor", 0, 0, size=(5, 5)), entity("heat-exchanger", 6, 0, size=(3, 2))],
    "labs": [entity("lab", 4 * k, 0, size=(3, 3)) for k in range(4)],
    "smelter": [*[entity("stone-furnace", 2 * k, 0, size=(2, 2)) for k in range(3)], *[entity("steel-furnace", 2 * k, 3, size=(2, 2)) for k in range(3)]],
    "ore": [entity("electric-mining-drill", 3 * k, 0, size=(3, 3)) for k in range(4)],
    "wall": line("stone-wall", 0, 0, 9, 0),
    "turret_and_factory": [entity("gun-turret", 0, 0, size=(2, 2)), *[entity("assembling-machine-1", 4 * k, 4, size=(3, 3), recipe="iron-gear-wheel") for k in range(3)]],
    "mixed_purpose": [*[entity("lab", 4 * k, 0, size=(3, 3)) for k in range(4)], *[entity("stone-furnace", 2 * k, 5, size=(2, 2)) for k in range(8)]],
    "belts": line("transport-belt", 0, 0, 5),
}


def classify_layouts(spark, sf):
    return C.classify(parsed(spark, KINDS), recipes(spark), parts(spark), buildings=("inserter", "belt"))


def design(spark):
    """A furnace row: a head of a splitter, a segment of a furnace with its inserters and belts, a tail of a belt."""
    segment = [("stone-furnace", "furnace", 0, 2, 2, 2, 0), ("inserter", "inserter", 0, 1, 1, 1, 0), ("inserter", "inserter", 0, 4, 1, 1, 0), *[("transport-belt", "transport-belt", x, y, 1, 1, 4) for x in (0, 1) for y in (0, 5)]]
    rows = [("row", "head", 0, "splitter", "splitter", -1, 0, 1, 2, 4), *[("row", "segment", k, *e) for k, e in enumerate(segment)], ("row", "tail", 0, "transport-belt", "transport-belt", 6, 5, 1, 1, 4)]
    ents = spark.createDataFrame([(*r, None, "input", None) for r in rows], "design string, part string, idx int, name string, kind string, x int, y int, w int, h int, direction int, recipe string, io_type string, modules string")
    return ents, spark.createDataFrame([("row", "stone_furnaces", 2, 3)], "design string, category string, period int, repeats int")


def build_segments(spark, sf):
    ents, headers = design(spark)
    builds = designs.build(ents, headers, F.lit(1)).union(designs.build(ents, headers, F.lit(4)))
    return builds.groupBy(L, "name").agg(F.count("*").alias("n"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))


def design_facts(spark, sf):
    ents, headers = design(spark)
    m = C.metrics(ents, headers)
    return m.join(C.traits(ents, headers).select("design", "machine", "pitch", "poles", "chain"), "design")


WOVEN = {
    "plain": [entity("underground-belt", 0, 0, 4, type="input"), entity("underground-belt", 3, 0, 4, type="output")],
    "woven": [
        entity("underground-belt", 0, 0, 4, type="input"), entity("fast-underground-belt", 1, 0, 4, type="input"), entity("underground-belt", 3, 0, 4, type="output"), entity("fast-underground-belt", 5, 0, 4, type="output"), entity("transport-belt", 6, 0, 4),
    ],
    "crossing": [entity("underground-belt", 0, 0, 4, type="input"), entity("underground-belt", 2, 0, 0, type="input"), entity("underground-belt", 4, 0, 4, type="output")],
    "long": [entity("express-underground-belt", 0, 0, 4, type="input"), entity("express-underground-belt", 8, 0, 4, type="output"), entity("express-transport-belt", 9, 0, 4)],
}


def belt_weaving(spark, sf):
    """Which layouts weave, and the names of their belts at the slowest tier."""
    ents = parsed(spark, WOVEN)
    names = designs.retiered(ents, 0).groupBy(L).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]), " ").alias("names"))
    return names.join(designs.weaving(ents).withColumn("woven", F.lit(True)), L, "left").withColumn("woven", F.coalesce("woven", F.lit(False)))


LIFTED = {
    "mixed": [*line("transport-belt", 0, 0, 5), *line("transport-belt", 4, 2, 4, 12, (-1, 0)), *line("pipe", 0, 5, 4, 0, (2, 0)), entity("lab", 9, 9, size=(3, 3)), *WOVEN["plain"][:0], entity("underground-belt", 0, 8, 4, type="input"), entity("underground-belt", 3, 8, 4, type="output")],
    "column": [*line("stone-wall", 0, 0, 4, 0, (0, 3)), entity("constant-combinator", 5, 5)],
}


def lifted_forms(spark, sf):
    ents = parsed(spark, LIFTED)
    forms = graphs.cut(lifting.lift(ents))
    return forms.select(L, "form", "name", "direction", "x", "y", "count", "dx", "dy").join(lifting.verified(ents, forms), L)


def extracted_designs(spark, sf):
    """A furnace row cut into head, segment and tail, and built again."""
    row = [*[entity("stone-furnace", 4 * k, 2, size=(2, 2)) for k in range(4)], *[entity("inserter", 4 * k, y) for k in range(4) for y in (1, 4)], *line("transport-belt", 0, 0, 16), *line("transport-belt", 0, 5, 16), entity("pipe", -2, 0)]
    ents, headers = designs.extract(parsed(spark, {"row": row, "no_period": [entity("pipe", k * k, 0) for k in range(7)]}))
    return ents.groupBy("design", "part", "name").agg(F.count("*").alias("n")).join(headers, "design")


FLOW = {
    "gears": [*line("transport-belt", 0, 0, 3), entity("assembling-machine-1", 0, 2, size=(3, 3), recipe="iron-gear-wheel"), *line("transport-belt", 0, 6, 3), entity("inserter", 1, 1), entity("inserter", 1, 5)],
    "side": [*line("transport-belt", 0, 1, 3), entity("transport-belt", 1, 0, 8), entity("assembling-machine-1", 5, 5, size=(3, 3), recipe="electronic-circuit")],
}
INPUTS = [("gears", "b:0:0", "iron-plate"), ("gears", "b:0:1", "coal"), ("side", "b:0:0", "coal"), ("side", "b:3:0", "stone"), ("side", "b:3:1", "wood")]


def _flow(spark):
    ents = parsed(spark, FLOW)
    return ents, flow.simulate(ents, parts(spark).select("recipe", "side", "item"), spark.createDataFrame(INPUTS, "layout_id string, node string, item string"))


def simulate_lanes(spark, sf):
    """What reaches belts and machines; the places of hands are left out."""
    return _flow(spark)[1].filter("node not like 'h:%'")


def verdict(spark, sf):
    ents, known = _flow(spark)
    return flow.verdict(ents, parts(spark).select("recipe", "side", "item"), known)


KNOWN = E.Vocabulary(item=("iron-plate", "speed-module", "stone", "wood"), recipe=("iron-gear-wheel",), virtual=("signal-A",), fluid=("water",))
RAW = [
    entity("assembling-machine-2", 0, 0, size=(3, 3), recipe="iron-gear-wheel", items=[{"id": {"name": "speed-module"}, "items": {"in_inventory": [{"inventory": 4, "stack": 0}, {"inventory": 4, "stack": 1}]}}]),
    entity("assembling-machine-2", 4, 0, size=(3, 3), items={"speed-module": 3}), entity("requester-chest", 8, 0, request_filters=[{"index": 2, "name": "iron-plate", "count": 5}, {"index": 1, "name": "raw-wood", "count": 1}]),
    entity("inserter", 9, 0, filters=[{"index": 1, "name": "stone"}, {"index": 2, "name": "iron-plate"}], use_filters=True, filter_mode="blacklist"), entity("splitter", 10, 0, size=(2, 1), filter="stone", output_priority="left"),
    entity("constant-combinator", 13, 0, control_behavior={"filters": [{"index": 1, "count": 7, "signal": {"type": "virtual", "name": "signal-A"}}]}), entity("pipe", 14, 0, 2), entity("pipe", 15, 0, quality="rare"),
]


def parsed_settings(spark, sf):
    ents = parsed(spark, {"a": RAW}, known=KNOWN)
    return ents.select("idx", "name", F.array_join(F.transform(F.array_sort(F.map_entries("extras")), lambda e: F.concat_ws(":", e["key"], e["value"])), " ").alias("settings"), F.coalesce("reject", F.lit("")).alias("reject"))


PROMPTS = [
    ("Build 4 stone furnaces and 3 labs", {"stone-furnace": 4}), ("A 13 by 18 block with 2 assembling-machine-2 of level 2", {"assembling-machine-2": 2}), ("4 blue belts", {"express-transport-belt": 50}), ("Поставь 5 каменных печей", {"stone-furnace": 6}),
    ("10 inserters and 1 lamp going North, then east", {"inserter": 7, "fast-inserter": 3, "small-lamp": 2}), ("90 degree turn, 160 MW, mk 2 machines", {}),
]


def prompt_checks(spark, sf):
    rows = spark.createDataFrame([(k, p, c, {}) for k, (p, c) in enumerate(PROMPTS)], "id int, prompt string, counts map<string,int>, recipes map<string,int>")
    conflicts = F.array_join(F.transform(X.count_conflicts("prompt", "counts", "recipes"), lambda c: F.concat_ws(" ", c["n"].cast("string"), c["tail"])), ", ")
    natural = X.natural_names(["assembling-machine-2", "stone-furnace"])
    return rows.select("id", conflicts.alias("conflicts"), X.prompt_language(F.col("prompt")).alias("lang"), X.rotate_words(natural("prompt"), 1).alias("turned"))


ANSWERS = [
    "Sure:\n```python\nfrom a import Blueprint\nbp = Blueprint()\nprint(bp.to_string())\n```\nand\n```\nx\n```", "Here it is\nimport x\nbp = Blueprint()\nprint(bp.to_string()\n<|eot_id|>\nbye", "no code at all", "import a\nprint(1)", "",
]


def answer_checks(spark, sf):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "id int, answer string").withColumn("code", X.extract_code(F.col("answer")))
    return rows.select("id", F.length("code").alias("chars"), F.coalesce(X.code_problem(F.col("code")), F.lit("")).alias("problem"))


def _results(spark):
    cases = [
        ("a1", "A", "p", {"lab": 10, "beacon": 3}, {"x": 2}, "yellow", ["lab"], None, None, None), ("a2", "A", "p", {}, None, None, ["lab", "pipe"], ["gate"], None, None), ("b1", "B", "p", {"lab": 4}, None, "red", None, None, ["x"], 12.5),
        ("b2", "B", "p", {"lab": 1}, None, None, None, None, None, 0.0),
    ]
    code = "bp = Blueprint()\nprint(bp.to_string())"
    facts = lambda counts, recipes, tiers, n: (list(counts.items()), recipes, tiers, n)
    outcomes = [
        ("a1", code, True, None, 100, 1.5, 1, True, facts({"lab": 11, "beacon": 3, "pipe": 2}, {"x": 1}, [("yellow", 5), ("red", 5)], 16), {}, {"belt_end": 2}), ("a2", code + "(", False, "boom", 50, 0.25, 2, False, None, {}, {}),
        ("b1", code, True, None, 80, 1.0, 1, True, facts({"lab": 4}, {"x": 9}, [("red", 1)], 4), {"collision": 1}, {"belt_end": 1}), ("b2", "", True, None, 10, 0.5, 3, False, facts({"lab": 1}, {}, [], 1), {}, {}),
    ]
    return evaluation.score(spark.createDataFrame(cases, evaluation.CASE), spark.createDataFrame(outcomes, evaluation.OUTCOME))


def scored_cases(spark, sf):
    checks = F.array_join(F.transform("count_checks", lambda c: F.concat_ws(":", c["entity"], c["actual"].cast("string"), c["exact"].cast("string"), c["within10"].cast("string"))), " ")
    return _results(spark).select("id", "complete", "valid", checks.alias("checks"), "belt_tier_ok", "contains_ok", "warnings_per_100", F.aggregate(F.map_values("issues"), F.lit(0), lambda a, n: a + n).alias("issues"))


def evaluation_summary(spark, sf):
    s = evaluation.summarize(_results(spark))
    issues = F.coalesce(F.array_join(F.transform("issue_totals", lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), " "), F.lit(""))
    return s.select("block", "n", "complete", "exec_ok", "valid", "valid_first_attempt", "count_exact", "count_within10", "belt_tier_ok", "contains_ok", "median_warnings_per_100", "median_reference_warnings_per_100", "mean_gen_tokens", "mean_attempts", issues.alias("issue_totals"))


def layout_drawings(spark, sf):
    return C.drawings(parsed(spark, {k: FLOW[k] for k in ("gears", "side")}))


def generated_modules(spark, sf):
    plans = {"smelting": generators.smelting_column(24), "assembling": generators.assembler_row(7, rows=2, inputs=2), "labs": generators.lab_array(20), "circuits": generators.green_circuits(4), "mining": generators.mining_field(16), "steam": generators.steam_row(4)}
    out = None
    for name, plan in plans.items():
        rows, box = generators.put(spark, plan, (5, 7), 8)
        one = rows.filter("name not like '%pole%'").groupBy("name").agg(F.count("*").alias("n"), F.min("x").alias("first_x"), F.min("y").alias("first_y")).select(F.lit(name).alias("module"), F.lit(box.width).alias("width"), F.lit(box.height).alias("height"), "*")
        out = one if out is None else out.union(one)
    return out


def runs_and_wires(spark, sf):
    """Arithmetic runs and the wires of poles, of small literals."""
    values = spark.createDataFrame([("a", v) for v in (0, 5, 10, 6, 7)] + [("b", v) for v in (1, 2, 5, 6, 9, 10)], "k string, v int")
    runs = sequential.arithmetic_runs(values, ["k"], "v").select(F.concat(F.lit("run "), "k").alias("what"), "first", "step", "count")
    poles = spark.createDataFrame([("p", k, 6.0 * k, 0.0, 7.0) for k in range(4)] + [("p", 9, 100.0, 0.0, 7.0)], "layout_id string, idx int, px double, py double, wire double")
    return runs.union(sequential.wires(poles).select(F.lit("wire"), "a", "b", F.lit(1)))


NAMES = (
    "validator_issues final_products recipe_shape_rank recipe_tables classify_layouts build_segments design_facts belt_weaving lifted_forms extracted_designs simulate_lanes verdict parsed_settings prompt_checks answer_checks"
    " scored_cases evaluation_summary layout_drawings generated_modules runs_and_wires"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLES = {name: EXPECTED[name] for name in NAMES}

"""The catalog of designs: recipes as a table, classification, traits, metrics, ranks, and what a design can be used for.

Recipes: recipes (recipe, category, time, productivity, ord: their order) and parts (recipe, side 'in' or 'out', item, amount, fluid). Entities as
plotweave.sources.layout_strings.entities returns them; designs have a row an entity with design, part ('head', 'segment', 'tail') and modules beside,
and a header: design, category, period, repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

L = "layout_id"
# What makes a category, and the products and machines that have one of their own.
FURNACES = {"stone-furnace": "stone_furnaces", "steel-furnace": "steel_furnaces", "electric-furnace": "electric_furnaces"}
PRODUCTS = {"electronic-circuit": "green_circuits", "advanced-circuit": "red_circuits", "processing-unit": "blue_circuits", "plastic-bar": "plastic"}
TURRETS = ("gun-turret", "laser-turret", "flamethrower-turret", "artillery-turret")
WALLS = ("stone-wall", "gate", "land-mine")
FAMILIES = {
    "nuclear": ("nuclear-reactor", "heat-exchanger", "steam-turbine"), "steam": ("boiler", "steam-engine"), "solar": ("solar-panel", "accumulator"), "labs": ("lab",), "mining": ("electric-mining-drill",),
    **{category: (name,) for name, category in FURNACES.items()},
}
CRAFTERS = ("assembling-machine-1", "assembling-machine-2", "assembling-machine-3", "chemical-plant", "oil-refinery", "centrifuge", "rocket-silo")
PRODUCTION = (
    "nuclear-reactor", "heat-exchanger", "steam-turbine", "boiler", "steam-engine", "solar-panel", "accumulator", "lab", "electric-mining-drill", "burner-mining-drill", "stone-furnace", "steel-furnace", "electric-furnace", *CRAFTERS,
)
FLUIDS = ("pipe", "pipe-to-ground", "pump", "storage-tank", "offshore-pump")
PURITY, AREA_PURITY = 0.6, {"nuclear": 0.4, "steam": 0.5, "solar": 0.5, "mining": 0.5, "defense": 0.5}
AREA_FAMILIES = {**FAMILIES, "mining": ("electric-mining-drill", "beacon"), "defense": TURRETS + WALLS}
MULTI = 3
FAMILY_OF_CRAFT = (("smelting", "furnace_column"), ("oil-processing", "refinery_block"), ("chemistry", "chem_row"), ("centrifuging", "centrifuge_row"), ("crafting", "machine_row"), ("advanced-crafting", "machine_row"))
REASONS = ("starved", "clog", "lane_mixed", "output_mixed", "fluid_mix", "no_output", "dangling_inserter")
DENSE, THICK, COVER, GAP = 0.2, 20, 0.6, 3
LANE_ITEMS, INSERTER_MARGIN, SLOWEST = 4, 0.8, 0.014


# --- recipes ---------------------------------------------------------------------------------------------------------------


def expected_parts(raw: DataFrame) -> DataFrame:
    """recipe, side, item, amount, fluid of raw parts (amount, or amount_min and amount_max; probability; type): what is expected on average."""
    amount = F.coalesce("amount", (F.col("amount_min") + F.col("amount_max")) / 2, F.lit(1.0)) * F.coalesce("probability", F.lit(1.0))
    return raw.select("recipe", "side", "item", amount.cast("double").alias("amount"), (F.coalesce("type", F.lit("item")) == "fluid").alias("fluid")).groupBy("recipe", "side", "item", "fluid").agg(F.sum("amount").alias("amount"))


def barrel_recipes(fluids: DataFrame, amount: float = 50.0) -> DataFrame:
    """Parts of the two recipes of each fluid (name): into a barrel and out of it."""
    filled = F.concat("name", F.lit("-barrel"))
    part = lambda recipe, side, item, n, fluid: F.struct(recipe.alias("recipe"), F.lit(side).alias("side"), item.alias("item"), F.lit(n).alias("amount"), F.lit(fluid).alias("fluid"))
    empty = F.concat(F.lit("empty-"), filled)
    barrel, fluid = F.lit("barrel"), F.col("name")
    rows = F.array(
        part(filled, "in", fluid, amount, True), part(filled, "in", barrel, 1.0, False), part(filled, "out", filled, 1.0, False), part(empty, "in", filled, 1.0, False), part(empty, "out", fluid, amount, True), part(empty, "out", barrel, 1.0, False)
    )
    return fluids.select(F.explode(rows).alias("r")).select("r.*")


def changed_recipes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recipes of both versions whose ingredients or products have other names."""
    names = lambda parts, x: parts.groupBy("recipe", "side").agg(F.array_sort(F.collect_set("item")).alias(x))
    both = old.select("recipe").distinct().join(new.select("recipe").distinct(), "recipe")
    sides = names(old, "a").join(names(new, "b"), ["recipe", "side"], "full")
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    return sides.filter(differ).select("recipe").distinct().join(both, "recipe", "left_semi")


def smelting(recipes: DataFrame, parts: DataFrame) -> DataFrame:
    """input, product of the smelting recipes with one ingredient and one product."""
    own = parts.join(recipes.filter("category = 'smelting'").select("recipe"), "recipe", "left_semi")
    single = own.groupBy("recipe").agg(F.count_if(F.col("side") == "in").alias("ins"), F.count_if(F.col("side") == "out").alias("outs"), F.max(F.when(F.col("side") == "in", F.col("item"))).alias("input"), F.max(F.when(F.col("side") == "out", F.col("item"))).alias("product"))
    return single.filter("ins = 1 and outs = 1").select("input", "product")


def shapes(parts: DataFrame) -> DataFrame:
    """recipe, solids, fluids_in, fluids_out."""
    inside, outside = F.col("side") == "in", F.col("side") == "out"
    return parts.groupBy("recipe").agg(F.count_if(inside & ~F.col("fluid")).alias("solids"), F.count_if(inside & F.col("fluid")).alias("fluids_in"), F.count_if(outside & F.col("fluid")).alias("fluids_out"))


def shape_rank(recipes: DataFrame, parts: DataFrame, recipe: str, most: int = 4) -> DataFrame:
    """recipe, distance of the recipes nearest in shape to the given one: equal shapes first, intermediates before buildings, then by name."""
    own = shapes(parts)
    target = own.filter(F.col("recipe") == recipe).select(F.col("solids").alias("s"), F.col("fluids_in").alias("i"), F.col("fluids_out").alias("o"))  # one row
    away = F.abs(F.col("solids") - F.col("s")) + F.abs(F.col("fluids_in") - F.col("i")) + F.abs(F.col("fluids_out") - F.col("o"))
    others = own.filter((F.col("recipe") != recipe) & ~F.col("recipe").endswith("-barrel")).join(recipes.select("recipe", "productivity"), "recipe").join(F.broadcast(target))
    return others.withColumn("distance", away).orderBy("distance", ~F.col("productivity"), "recipe").limit(most).select("recipe", "distance")


def final_products(used: DataFrame, parts: DataFrame, key: str = L) -> DataFrame:
    """key, item: what the used recipes (key, recipe) make and none of them takes."""
    own = used.select(key, "recipe").distinct().join(F.broadcast(parts), "recipe")
    return own.filter("side = 'out'").select(key, "item").distinct().join(own.filter("side = 'in'").select(key, "item").distinct(), [key, "item"], "left_anti")


def recipe_families(products: DataFrame, recipes: DataFrame, parts: DataFrame) -> DataFrame:
    """item, family of the products (item), by the recipe named like it, else by its first maker."""
    makers = parts.filter("side = 'out'").select("item", "recipe").join(products.select("item").distinct(), "item").join(recipes, "recipe").join(shapes(parts), "recipe")
    first = Window.partitionBy("item").orderBy(F.col("recipe") != F.col("item"), "ord")
    family = (
        F.when(F.col("category") == "chemistry", "chemistry").when(F.col("category") == "oil-processing", "oil").when(F.col("category") == "centrifuging", "uranium").when(F.col("fluids_in") > 0, "assembly_fluid")
        .otherwise(F.concat(F.lit("assembly_"), F.least(F.greatest("solids", F.lit(1)), F.lit(3)).cast("string"), F.lit("in")))
    )
    return makers.withColumn("n", F.row_number().over(first)).filter("n = 1").select("item", family.alias("family"))


def items_of(properties: DataFrame, key: str, values: list[str], kind: str | None = None) -> DataFrame:
    """Items (name, type, and their properties as columns) whose property has one of the values, and of one type where it is given."""
    kept = properties.filter(F.col(key).isin(*values)) if values else properties.filter(F.col(key).isNotNull())
    return (kept if kind is None else kept.filter(F.col("type") == kind)).select("name").distinct()


def craftable_inputs(machines: DataFrame, recipes: DataFrame, parts: DataFrame) -> DataFrame:
    """machine, item: solid ingredients of every recipe that a machine (machine, category) can make."""
    return machines.join(recipes.select("recipe", "category"), "category").join(parts.filter("side = 'in' and not fluid"), "recipe").select("machine", "item").distinct()


def machine_family(categories: Column) -> Column:
    """The family of a row of machines by what they craft, the first that applies; null for others."""
    out = F.lit(None).cast("string")
    for category, family in reversed(FAMILY_OF_CRAFT):
        out = F.when(F.array_contains(categories, category), family).otherwise(out)
    return out


def lane_rate(speed: Column) -> Column:
    """Items a second on one lane of a belt of that speed (tiles a tick)."""
    return F.coalesce(speed, F.lit(0.0)) * 60 * LANE_ITEMS


def inserter_rate(rotation: Column, bulk: Column) -> Column:
    """Rough items a second of an inserter: its swings, twice for bulk."""
    return F.coalesce(rotation, F.lit(SLOWEST)) * 60 * F.when(F.coalesce(bulk, F.lit(False)), 2).otherwise(1)


def belt_tiers(names: DataFrame) -> DataFrame:
    """tier (0 is the slowest), belt, underground, splitter of the speeds that have all three. names: name, kind, speed."""
    by = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("name")))
    found = names.filter("speed is not null").groupBy("speed").agg(by("transport-belt").alias("belt"), by("underground-belt").alias("underground"), by("splitter").alias("splitter"))
    whole = found.filter("belt is not null and underground is not null and splitter is not null")
    return whole.withColumn("tier", F.row_number().over(Window.orderBy("speed")) - 1).select("tier", "belt", "underground", "splitter")  # a row a tier


# --- what a layout is ------------------------------------------------------------------------------------------------------


def products(entities: DataFrame, parts: DataFrame) -> DataFrame:
    """layout_id, final (sorted): what the recipe machines of a layout deliver."""
    used = entities.filter(F.col("name").isin(*CRAFTERS) & F.col("recipe").isNotNull())
    return final_products(used, parts).groupBy(L).agg(F.array_sort(F.collect_set("item")).alias("final"))


def _count(names: tuple[str, ...] | str) -> Column:
    return F.count_if(F.col("name").isin(*([names] if isinstance(names, str) else names)))


def _share(names: tuple[str, ...]) -> Column:
    area = F.col("w") * F.col("h")
    return F.sum(F.when(F.col("name").isin(*names), area).otherwise(0)) / F.greatest(F.sum(area), F.lit(1))


def classify(entities: DataFrame, recipes: DataFrame, parts: DataFrame, buildings: tuple[str, ...] = ()) -> DataFrame:
    """layout_id, category: what a layout is for, or null.

    First by its machines, in a fixed order; then by what its recipe machines deliver: one product has its category or its recipe's family, two or three make a
    'multi' block, more or two buildings a mall, which has none. A category's own machines must be most of all production machines, and power and
    mining must take most of the area. buildings: products that can be placed.
    """
    aggregates = {
        "turrets": _count(TURRETS), "walls": _count(WALLS), "defended": _share(TURRETS + WALLS), "producing": _share(PRODUCTION), "reactors": _count("nuclear-reactor"), "boilers": _count("boiler"), "engines": _count("steam-engine"),
        "panels": _count("solar-panel"), "fluids": _count(FLUIDS), "labs": _count("lab"), "drills": _count("electric-mining-drill"), "crafters": _count(CRAFTERS), "production": _count(PRODUCTION),
        **{f"own_{k}": _count(names) for k, names in FAMILIES.items()}, **{f"share_{k}": _share(AREA_FAMILIES[k]) for k in AREA_PURITY},
    }
    counted = entities.groupBy(L).agg(*(v.alias(k) for k, v in aggregates.items())).join(products(entities, parts), L, "left")
    one = F.when(F.size("final") == 1, F.get("final", F.lit(0)))
    families = recipe_families(counted.select(one.alias("item")).filter("item is not null").distinct(), recipes, parts)
    counted = counted.withColumn("item", one).join(F.broadcast(families), "item", "left")
    named = F.lit(None).cast("string")
    for item, category in PRODUCTS.items():
        named = F.when(F.col("item") == item, category).otherwise(named)
    furnaces = [F.col(f"own_{c}") for c in FURNACES.values()]
    most = F.greatest(*furnaces)
    furnace = F.coalesce(*(F.when(n == most, F.lit(c)) for n, c in zip(furnaces, FURNACES.values(), strict=True)))
    placed = F.size(F.filter("final", lambda x: x.isin(*buildings))) if buildings else F.lit(0)
    category = (
        F.when(((F.col("turrets") > 0) | (F.col("walls") >= 8)) & (F.col("defended") >= AREA_PURITY["defense"]) & (F.col("producing") <= 0.1), "defense").when(F.col("reactors") > 0, "nuclear")
        .when((F.col("boilers") > 0) & (F.col("engines") >= 2), "steam").when((F.col("panels") >= 4) & (F.col("fluids") == 0), "solar").when(F.col("labs") >= 4, "labs").when(sum(furnaces, F.lit(0)) >= 4, furnace)
        .when(F.col("drills") >= 4, "mining").when(F.col("crafters") >= 2, F.when(F.size("final") == 1, F.coalesce(named, "family")).when(F.size("final").between(2, MULTI) & (placed < 2), "multi"))
    )
    found = counted.withColumn("category", category)
    own, area = F.col("crafters"), F.lit(True)
    for k in FAMILIES:
        own = F.when(F.col("category") == k, F.col(f"own_{k}")).otherwise(own)
    for k, least in AREA_PURITY.items():
        area = F.when(F.col("category") == k, F.col(f"share_{k}") >= least).otherwise(area)
    pure = (F.col("production") > 0) & (own / F.col("production") >= PURITY) & area
    return found.select(L, F.when((F.col("category") == "defense") | pure, F.col("category")).alias("category"))


# --- what a design is ------------------------------------------------------------------------------------------------------

D = "design"
MACHINES = ("assembling-machine", "furnace", "lab", "mining-drill", "solar-panel", "accumulator", "boiler", "generator", "reactor", "rocket-silo")


def commonest(rows: DataFrame, keys: list[str], value: str, order: str = "idx") -> DataFrame:
    """keys, value, n: the most common value of each group, of equally common ones the first seen; null counts as a value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*keys, value, "n")


def metrics(entities: DataFrame, headers: DataFrame) -> DataFrame:
    """design, machines, tiles_per_machine, beacons_per_machine, height, belt_tier, head and tail entities: of one segment, whose length is the header's period."""
    part = lambda p: F.col("part") == p
    machine = part("segment") & F.col("kind").isin(*MACHINES) & (F.col("name") != "beacon")
    tier = F.when(F.col("kind").isin("transport-belt", "underground-belt", "splitter"), F.when(F.substring_index("name", "-", 1).isin("fast", "express"), F.substring_index("name", "-", 1)).otherwise("yellow"))
    belts = commonest(entities.filter(part("segment")).withColumn("tier", tier).filter("tier is not null"), [D], "tier").select(D, F.col("tier").alias("belt_tier"))
    counted = entities.groupBy(D).agg(
        F.count_if(machine).alias("machines"), F.count_if(part("segment") & (F.col("name") == "beacon")).alias("beacons"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("height"),
        F.count_if(part("head")).alias("head_entities"), F.count_if(part("tail")).alias("tail_entities"),
    )
    per = lambda a: F.when(F.col("machines") > 0, F.round(a / F.col("machines"), 2))
    joined = counted.join(headers.select(D, "period"), D).join(belts, D, "left")
    return joined.select(D, "machines", "height", per(F.col("period") * F.col("height")).alias("tiles_per_machine"), per(F.col("beacons")).alias("beacons_per_machine"), "belt_tier", "head_entities", "tail_entities")


def per_segment(entities: DataFrame, value: str) -> DataFrame:
    """design, value, n: how often each machine, recipe or pole is in a segment."""
    return entities.filter((F.col("part") == "segment") & F.col(value).isNotNull()).groupBy(D, value).agg(F.count("*").alias("n"))


def main_machines(entities: DataFrame, headers: DataFrame) -> DataFrame:
    """design, machine: the most common machine of the category's family, or of all machines where the segment has none of it."""
    machines = entities.filter((F.col("part") == "segment") & F.col("kind").isin(*MACHINES)).join(headers.select(D, "category"), D)
    own = F.lit(False)
    for category, names in FAMILIES.items():
        own = own | ((F.col("category") == category) & F.col("name").isin(*names))
    own = own | (~F.col("category").isin(*FAMILIES) & F.col("name").isin(*CRAFTERS))
    counts = machines.withColumn("own", own).groupBy(D, "name").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("own").alias("own"))
    w = Window.partitionBy(D).orderBy(F.col("own").desc(), F.col("n").desc(), "first")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select(D, F.col("name").alias("machine"))


def row_machines(entities: DataFrame) -> DataFrame:
    """design, name, recipe: the most common machine with its recipe in a segment of crafting machines."""
    rows = entities.filter((F.col("part") == "segment") & F.col("kind").isin("assembling-machine", "furnace")).withColumn("both", F.struct("name", "recipe"))
    return commonest(rows, [D], "both").select(D, "both.name", "both.recipe")


def module_choice(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """design, name, modules: the most common modules of each kind of machine; and design, recipe, modules where those of a recipe's machines differ. '' is none."""
    slotted = entities.withColumn("modules", F.coalesce("modules", F.lit("")))
    by_type = commonest(slotted, [D, "name"], "modules").select(D, "name", "modules")
    by_recipe = commonest(slotted.filter("recipe is not null"), [D, "name", "recipe"], "modules").withColumnRenamed("modules", "own").join(by_type, [D, "name"])
    return by_type, by_recipe.filter("own != modules").groupBy(D, "recipe").agg(F.max("own").alias("modules"))


def with_modules(entities: DataFrame, by_type: DataFrame, by_recipe: DataFrame, slots: DataFrame) -> DataFrame:
    """entities with the modules of their recipe, else of their type, where these fit the machine's slots (name, slots); beacons take no productivity."""
    total = lambda m: F.aggregate(F.filter(F.split(m, ";"), lambda p: p != ""), F.lit(0), lambda a, p: a + F.substring_index(p, "=", -1).cast("int"))
    fits = lambda m: (total(m) <= F.col("slots")) & ~((F.col("name") == "beacon") & F.contains(m, F.lit("productivity")))
    joined = entities.join(by_type.withColumnRenamed("modules", "_t"), [D, "name"], "left").join(by_recipe.withColumnRenamed("modules", "_r"), [D, "recipe"], "left").join(F.broadcast(slots), "name", "left")
    want = F.coalesce(F.when(F.col("_r").isNotNull() & fits(F.col("_r")), F.col("_r")), F.when(F.col("_t").isNotNull() & fits(F.col("_t")), F.col("_t")))
    new = F.when(F.col("slots").isNull() | want.isNull(), F.col("modules")).otherwise(F.nullif(want, F.lit("")))
    return joined.withColumn("modules", new).select(entities.columns)


def traits(entities: DataFrame, headers: DataFrame) -> DataFrame:
    """design, machine, recipe, pitch, poles, machine_modules, beacon_modules, chain: what tells the designs of one category apart."""
    segment = entities.filter("part = 'segment'")
    main = main_machines(entities, headers)
    machines = segment.join(main, (segment[D] == main[D]) & (segment["name"] == main["machine"])).drop(main[D])
    widest = machines.groupBy(D, "y").agg(F.sum("w").alias("wide")).groupBy(D).agg(F.max("wide").alias("wide"))
    recipe = commonest(machines.filter("recipe is not null"), [D], "recipe").select(D, "recipe")
    modules = lambda rows, name: commonest(rows, [D], "modules").select(D, F.replace("modules", F.lit("-module"), F.lit("")).alias(name))
    rows_of = lambda kind, name: segment.filter(F.col("kind") == kind).groupBy(D).agg(F.collect_set("y").alias(name))
    band = machines.groupBy(D).agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    several = entities.filter("recipe is not null").groupBy(D).agg((F.count_distinct("recipe") > 1).alias("chain"))
    found = headers.select(D, "category", "period").join(main, D, "left")
    for part in (widest, recipe, modules(machines, "machine_modules"), modules(segment.filter("name = 'beacon'"), "beacon_modules"), rows_of("electric-pole", "poles_at"), rows_of("inserter", "hands_at"), band, several):
        found = found.join(part, D, "left")
    between = (F.col("category") == "mining") & F.forall("poles_at", lambda y: (y >= F.col("top")) & (y < F.col("bottom")))
    inline = F.size(F.array_except("poles_at", F.coalesce("hands_at", F.array().cast("array<int>")))) == 0
    poles = F.when(F.col("poles_at").isNull(), "none").when(F.coalesce(between, F.lit(False)), "between drills").when(inline, "inline").otherwise("own row")
    pitch = F.when(F.col("wide") >= F.col("period"), "tight").otherwise("gaps")
    return found.select(D, "machine", "recipe", pitch.alias("pitch"), poles.alias("poles"), "machine_modules", "beacon_modules", F.coalesce("chain", F.lit(False)).alias("chain"))


def variant(beaconed: Column, t: dict[str, Column]) -> Column:
    """The label of a design by its traits (machine, recipe, beacon_modules, machine_modules, pitch, poles, chain, weaving, lamps; recipe null where it doesn't count)."""
    flags = [F.when(t[k], F.lit(k)) for k in ("chain", "weaving", "lamps") if k in t]
    first = F.when(beaconed & t["beacon_modules"].isNotNull(), F.concat(F.lit("beacons "), t["beacon_modules"])).when(beaconed, "beacons").otherwise("no beacons")
    return F.concat_ws(", ", first, t["machine"], t["recipe"], t["machine_modules"], F.concat(F.lit("pitch "), t["pitch"]), F.concat(F.lit("poles "), t["poles"]), *flags)


def rank_score(favorites: Column, major: Column, tiles: Column) -> Column:
    """Favourites on a logarithmic scale, a bonus for newer versions, and less for each tile a machine takes (50 where that isn't known)."""
    newer = F.when(major >= 2, 1.0).when(major >= 1, 0.5).otherwise(0.0)
    return F.log10(F.coalesce(favorites, F.lit(0)) + 1) + newer - F.coalesce(tiles, F.lit(50.0)) / 100


def is_simple(beacons: Column, modules: Column, weaving: Column, machine: Column) -> Column:
    return (F.coalesce(beacons, F.lit(0.0)) == 0) & modules.isNull() & ~F.coalesce(weaving, F.lit(False)) & (machine != "assembling-machine-3")


def sanity(entities: DataFrame) -> DataFrame:
    """layout_id, category, problem: why a build isn't a working module of its category, or null. entities: a build's rows with category."""
    n = lambda name: F.count_if(F.col("name") == name)
    made = lambda recipe: F.count_if(F.col("recipe") == recipe)
    counts = entities.groupBy(L, "category").agg(
        n("heat-exchanger").alias("exchangers"), n("nuclear-reactor").alias("reactors"), n("steam-turbine").alias("turbines"), n("steam-engine").alias("engines"), n("boiler").alias("boilers"), n("accumulator").alias("accumulators"),
        n("solar-panel").alias("panels"), made("copper-cable").alias("cables"), made("electronic-circuit").alias("circuits"),
        ((F.max(F.col("x") + F.col("w")) - F.min("x")) * (F.max(F.col("y") + F.col("h")) - F.min("y"))).alias("box"), F.sum(F.col("w") * F.col("h")).alias("covered"),
    )
    c = F.col
    ratio = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    problem = (
        F.when((c("category") == "nuclear") & ((c("exchangers") < 3 * c("reactors")) | (c("turbines") < 1.5 * c("exchangers"))), "too few heat exchangers or turbines")
        .when((c("category") == "steam") & ~ratio("engines", "boilers").between(1.5, 2.0), "engines per boiler").when((c("category") == "solar") & (c("accumulators") > 0) & ~ratio("accumulators", "panels").between(0.6, 1.2), "accumulators per panel")
        .when((c("category") == "green_circuits") & (c("cables") > 0) & ~ratio("cables", "circuits").between(1.2, 1.8), "cables per circuit").when(c("covered") / F.greatest(c("box"), F.lit(1)) < DENSE, "too sparse")
    )
    return counts.select(L, "category", problem.alias("problem"))


def straight_walls(entities: DataFrame, headers: DataFrame) -> DataFrame:
    """design, straight: whether a piece of defence repeats along its line. Walls count, or turrets where there are none."""
    walls, turrets = F.col("name").isin("stone-wall", "gate"), F.col("name").isin(*TURRETS)
    kinds = entities.groupBy(D).agg(F.max(walls).alias("walled"))
    rows = entities.join(kinds, D).filter(F.when(F.col("walled"), walls).otherwise(turrets))
    tiled = rows.withColumn("ty", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)))
    inside = tiled.filter("part = 'segment'")
    columns = inside.withColumn("tx", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1))).join(headers.select(D, "period"), D).groupBy(D).agg(F.count_distinct(F.pmod("tx", "period")).alias("columns"))
    lines = inside.select(D, "ty").distinct().withColumn("gap", F.lead("ty").over(Window.partitionBy(D).orderBy("ty")) - F.col("ty") - 1)
    band = lines.groupBy(D).agg(F.min("ty").alias("low"), F.max("ty").alias("high"), F.coalesce(F.max("gap"), F.lit(0)).alias("gap"))
    ends = tiled.filter("part != 'segment'").groupBy(D).agg(F.min("ty").alias("end_low"), F.max("ty").alias("end_high"))
    forms = entities.groupBy(D).agg(F.count_if(F.col("part") != "segment").alias("ends"))
    joined = headers.select(D, "period", "repeats").join(forms, D, "left").join(kinds, D, "left").join(columns, D, "left").join(band, D, "left").join(ends, D, "left")
    segmented = (F.coalesce("ends", F.lit(0)) > 0) | (F.col("repeats") > 1)
    covered = F.col("columns") >= F.when(F.col("walled"), COVER).otherwise(0.0) * F.col("period")
    within = F.col("end_low").isNull() | ((F.col("end_low") >= F.col("low")) & (F.col("end_high") <= F.col("high")))
    straight = segmented & covered & (F.col("high") - F.col("low") + 1 <= THICK) & (F.col("gap") <= GAP) & within
    return joined.select(D, F.coalesce(straight, F.lit(False)).alias("straight"))


def flow_reason(status: Column, kinds: Column) -> Column:
    """Why a design doesn't work: the search ran out, or the first kind of problem in a fixed order; else the first kind there is, or the status."""
    known = F.filter(F.array(*map(F.lit, REASONS)), lambda r: F.array_contains(kinds, r))
    return F.when(status.isin("inputs_ambiguous", "needs_shared_lane"), status).otherwise(F.coalesce(F.get(known, F.lit(0)), F.get(F.array_sort(kinds), F.lit(0)), status))


def furnace_input(inputs: Column, outputs: Column) -> Column:
    return F.when(F.array_contains(inputs, "iron-plate"), "steel").when(F.array_contains(outputs, "steel-plate"), "ore_to_steel").otherwise("ore")


def sampled_rejects(rejects: DataFrame, each: int = 5) -> tuple[DataFrame, DataFrame]:
    """reason, n of all rejects (reason, key, ...), and so many of each reason, by the hash of their key: the same ones in every run."""
    w = Window.partitionBy("reason").orderBy(F.sha2(F.col("key").cast("string"), 256), "key")
    return rejects.groupBy("reason").agg(F.count("*").alias("n")), rejects.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each).drop("_n")


def resolved(sample: DataFrame, rows: DataFrame) -> DataFrame:
    """Sampled rejects with the rows that they are about, by key."""
    return sample.join(rows, "key")


def misfit(recipe: dict[str, Column], row: dict[str, Column]) -> Column:
    """Why a recipe doesn't fit a row of machines, the first reason, or null.

    recipe: known, category, solids, fluids_in, fluids_out, solid_out; row: family, crafts (array), several (recipes in the row), item_inputs, fluid_in, fluid_out, exits.
    """
    return (
        F.when(~recipe["known"], "no such recipe").when(row["family"].isNull(), "not a crafting machine").when(row["several"], "a block of several recipes").when(~F.array_contains(row["crafts"], recipe["category"]), "not crafted here")
        .when(recipe["solids"] > row["item_inputs"], "too many solid ingredients").when((recipe["fluids_in"] > row["fluid_in"]) | (recipe["fluids_out"] > row["fluid_out"]), "too many fluids")
        .when((recipe["solid_out"] > 0) & (row["exits"] == 0), "no exit")
    )


def ranked_designs(recipes: DataFrame, parts: DataFrame, rows: DataFrame, recipe: str) -> DataFrame:
    """design, distance, tiles_per_machine, score of the row designs that take a recipe, the best first. rows: design, recipe (its own, or null for a furnace's one
    solid), family, crafts, several, item_inputs, fluid_in, fluid_out, exits, tiles_per_machine, score."""
    own = shapes(parts)
    out = parts.filter("side = 'out' and not fluid").groupBy("recipe").agg(F.count("*").alias("solid_out"))
    wanted = recipes.filter(F.col("recipe") == recipe).join(own, "recipe").join(out, "recipe", "left")
    wanted = wanted.select(*(F.col(c).alias(f"r_{c}") for c in ("category", "solids", "fluids_in", "fluids_out")), F.coalesce("solid_out", F.lit(0)).alias("r_solid_out"))  # one row
    joined = rows.join(F.broadcast(own), "recipe", "left").join(F.broadcast(wanted))
    known = {"known": F.lit(True), **{c: F.col(f"r_{c}") for c in ("category", "solids", "fluids_in", "fluids_out", "solid_out")}}
    fits = misfit(known, {c: F.col(c) for c in ("family", "crafts", "several", "item_inputs", "fluid_in", "fluid_out", "exits")}).isNull()
    away = sum((F.abs(F.coalesce(c, F.lit(d)) - F.col(f"r_{c}")) for c, d in (("solids", 1), ("fluids_in", 0), ("fluids_out", 0))), F.lit(0))
    return joined.filter(fits).select(D, away.alias("distance"), F.coalesce("tiles_per_machine", F.lit(50.0)).alias("tiles_per_machine"), "score").orderBy("distance", "tiles_per_machine", F.col("score").desc(), D)


def throughput(machines: DataFrame, parts: DataFrame, recipes: DataFrame, lanes: DataFrame, hands: DataFrame) -> DataFrame:
    """design, item, side, per_machine, machines_fed, keeps_up: what one machine takes and makes a second, how many its lanes feed, and whether the hands keep up.

    machines: design, recipe, speed; lanes: design, item, n, belt_speed (input lanes by item); hands: design, machine, side, rate (of each inserter).
    """
    own = machines.join(recipes.select("recipe", "time"), "recipe").join(parts.filter("not fluid"), "recipe")
    rates = own.select(D, "side", "item", (F.col("amount") * F.coalesce("speed", F.lit(1.0)) / F.col("time")).alias("rate"))
    slowest = hands.groupBy(D, "machine", "side").agg(F.sum("rate").alias("r")).groupBy(D, "side").agg(F.min("r").alias("hands"))
    needed = rates.groupBy(D, "side").agg(F.sum("rate").alias("needed"))
    fed = F.floor(F.coalesce("n", F.lit(0)) * lane_rate(F.col("belt_speed")) / F.col("rate")).cast("int")
    joined = rates.join(lanes, [D, "item"], "left").join(needed, [D, "side"]).join(slowest, [D, "side"], "left")
    keeps = F.when(F.col("hands") > 0, F.col("needed") <= INSERTER_MARGIN * F.col("hands"))
    return joined.select(D, "item", "side", F.round("rate", 3).alias("per_machine"), F.when(F.col("side") == "in", F.coalesce(fed, F.lit(0))).alias("machines_fed"), keeps.alias("keeps_up"))


def chosen_for_book(results: DataFrame, per_family: int = 4, each: int = 2) -> DataFrame:
    """Of each family the designs of the most favourites, and of each of these so many recipes, those with the design's own ends first. results: family, design, favorites, recipe, ends, ord."""
    designs = results.select("family", D, "favorites").distinct()
    top = designs.withColumn("n", F.row_number().over(Window.partitionBy("family").orderBy(F.col("favorites").desc(), D))).filter(F.col("n") <= per_family).select("family", D)
    w = Window.partitionBy("family", D).orderBy(F.col("ends") != "own", "ord", "recipe")
    return results.join(top, ["family", D]).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= each).drop("n")


def result_report(results: DataFrame) -> DataFrame:
    """family, outcome, n of substitution results (family, outcome)."""
    return results.groupBy("family", "outcome").agg(F.count("*").alias("n"))


#: How a layout is drawn.
ARROWS = {0: "^", 4: ">", 8: "v", 12: "<"}
DRAWN = {
    "underground-belt": "u", "splitter": "=", "inserter": "i", "long-handed-inserter": "l", "fast-inserter": "f", "bulk-inserter": "k", "burner-inserter": "n", "small-electric-pole": "p", "medium-electric-pole": "P", "substation": "$",
    "big-electric-pole": "B", "constant-combinator": "c", "small-lamp": "*", "pipe": "|", "pipe-to-ground": "!", "solar-panel": "S", "accumulator": "A", "lab": "L", "boiler": "O", "steam-engine": "E", "offshore-pump": "W",
    "electric-mining-drill": "D", "beacon": "#", "stone-furnace": "F", "steel-furnace": "F", "electric-furnace": "F",
}
DRAWN_RECIPES = {"copper-cable": "C", "electronic-circuit": "G", "advanced-circuit": "R", "iron-gear-wheel": "V"}


def drawings(entities: DataFrame, wide: int = 80, high: int = 40) -> DataFrame:
    """layout_id, map: each layout as lines of characters, a tile each, from its top left corner on."""
    lookup = lambda pairs, c: F.element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), c)
    base = F.regexp_replace("name", "fast-(?!inserter)|express-", "")
    char = F.when(base == "transport-belt", lookup(ARROWS, F.col("direction"))).otherwise(F.coalesce(lookup(DRAWN_RECIPES, F.col("recipe")), lookup(DRAWN, base), lookup(DRAWN, F.col("name")), F.upper(F.substring("name", 1, 1))))
    tiled = entities.withColumn("c", char).withColumn("tx", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1))).withColumn("ty", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)))
    last = tiled.groupBy(L, "tx", "ty").agg(F.max_by("c", "idx").alias("c"))
    box = last.groupBy(L).agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
    drawn = last.join(box, L).filter((F.col("tx") < F.col("x0") + wide) & (F.col("ty") < F.col("y0") + high))
    grid = drawn.groupBy(L, "x0", "x1", "y0", "y1").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("tx", "ty"), F.col("c")))).alias("at"))  # wide * high places at most
    row = lambda y: F.array_join(F.transform(F.sequence("x0", F.least("x1", F.col("x0") + wide - 1)), lambda x: F.coalesce(F.element_at("at", F.struct(x.alias("tx"), y.alias("ty"))), F.lit("."))), "")
    return grid.select(L, F.array_join(F.transform(F.sequence("y0", F.least("y1", F.col("y0") + high - 1)), row), "\n").alias("map"))

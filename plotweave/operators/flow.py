"""Dataflow over all layouts at once: lane graph, inserter links, a monotone simulation to its fixpoint, ports and its verdict.

Places are named by strings: 'b:idx:lane' a belt's lane (0 left, 1 right; a splitter's right half has 2 and 3), 'h:idx' what a hand takes, 'i:idx' what an entity has
received, 'o:idx' what it gives, 'g:x:y' a tile of ground. Edges may let one item pass only, or all but one.

Recipes are a table: recipe, side ('in' or 'out'), item. Roles are another: name (of an entity), role, item, and product for the role smelt: what a machine needs one of
besides its recipe (fuel, pack, smelt), what it holds (ammo), and what it may hand on (fuel, pack, ammo).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators import graphs
from plotweave.operators import layouts as A

L = "layout_id"
BELTS = ("transport-belt", "underground-belt", "splitter")
#: Stands for every item, where a chest or the ground takes all.
ANY = "*"
EDGE = (L, "src", "dst", "rule", "rule_item")
ROLES = "name string, role string, item string, product string"


def place(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def _none() -> Column:
    return F.lit(None).cast("string")


def _extra(entities: DataFrame, key: str) -> Column:
    return F.element_at("extras", F.lit(key)) if "extras" in entities.columns else _none()


def _half(tx: Column, ty: Column, x: Column, y: Column, direction: Column) -> Column:
    """0 for the left half of a splitter, 1 for the right one, by the tile."""
    along = (tx - x) + (ty - y)
    return F.when(direction.isin(0, 4), along).otherwise(1 - along)


def belt_feeds(entities: DataFrame) -> DataFrame:
    """src, dst, side of belts that run into belts, by the tile they leave (src_half) and the tile they reach (dst_half, of splitters): side 'behind', 'left' or
    'right' of the fed belt."""
    senders = A.tiles(entities.filter(F.col("kind").isin(*BELTS) & ~((F.col("kind") == "underground-belt") & (F.col("io_type") == "input"))))
    dx, dy = A.vector(F.col("direction"))
    ahead = senders.select(L, F.col("idx").alias("src"), F.col("kind").alias("src_kind"), "direction", (F.col("tx") + dx).alias("px"), (F.col("ty") + dy).alias("py"), _half(F.col("tx"), F.col("ty"), F.col("x"), F.col("y"), F.col("direction")).alias("src_half"))
    found = A.lookup(ahead.withColumn("idx", F.col("src")), F.col("px"), F.col("py"), "dst", among=entities).drop("idx").filter("dst is not null and dst != src")
    fed = entities.filter(F.col("kind").isin(*BELTS)).select(L, F.col("idx").alias("dst"), F.col("direction").alias("to"), F.col("kind").alias("to_kind"), F.col("io_type").alias("to_io"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    turn = F.pmod(F.col("direction") - F.col("to"), F.lit(16))
    side = F.when(turn == 0, "behind").when(turn == 4, "left").when(turn == 12, "right")  # a belt that runs clockwise of the fed one comes from its left
    joined = found.join(fed, [L, "dst"]).withColumn("side", side).filter("side is not null")
    joined = joined.withColumn("dst_half", _half(F.col("px"), F.col("py"), F.col("to_x"), F.col("to_y"), F.col("to")))
    tunnel = (F.col("to_kind") == "underground-belt") & (F.col("to_io") == "output") & (F.col("side") == "behind")
    return joined.filter(~tunnel).select(L, "src", "src_kind", "src_half", "direction", "dst", "dst_half", "to", "to_kind", "to_io", "side")


def curves(feeds: DataFrame) -> DataFrame:
    """layout_id, dst, incoming: belts that are fed from one side only, and the direction they are fed in."""
    by = feeds.filter("to_kind = 'transport-belt'").groupBy(L, "dst").agg(F.count_if(F.col("side") == "behind").alias("behind"), F.collect_set(F.when(F.col("side") != "behind", F.col("src"))).alias("beside"), F.max(F.when(F.col("side") != "behind", F.col("direction"))).alias("incoming"))
    return by.filter((F.col("behind") == 0) & (F.size("beside") == 1)).select(L, "dst", "incoming")


def lane_edges(entities: DataFrame) -> DataFrame:
    """src, dst, rule, rule_item of lanes. A belt fed from one side only is a curve and keeps lanes; other side feeds fill the near lane; an underground takes one
    lane from the side; splitters send either half's lanes out of both, what is filtered out of the preferred half only."""
    feeds = belt_feeds(entities)
    settings = entities.filter("kind = 'splitter'").select(L, F.col("idx").alias("src"), _extra(entities, "filter").alias("item"), _extra(entities, "output_priority").alias("prefers"))
    joined = feeds.join(curves(feeds), [L, "dst"], "left").join(settings, [L, "src"], "left")
    lanes = F.when(F.col("src_kind") == "splitter", F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = joined.withColumn("lane", F.explode(lanes)).withColumn("l", F.col("lane") % 2)
    near = F.when(F.col("side") == "left", 0).otherwise(1)
    # the half of an underground that isn't under the ground: behind an entrance, before an exit
    dx, dy = A.vector(F.col("direction"))
    ox, oy = A.vector(F.when(F.col("to_io") == "output", F.col("to")).otherwise(F.pmod(F.col("to") + 8, F.lit(16))))
    passing = F.when(dy * ox - dx * oy > 0, 0).otherwise(1)
    to_lane = (
        F.when((F.col("side") == "behind") & (F.col("to_kind") == "splitter"), 2 * F.col("dst_half") + F.col("l")).when(F.col("side") == "behind", F.col("l")).when(F.col("to_kind") == "splitter", None)
        .when(F.col("to_kind") == "transport-belt", F.when(F.col("incoming").isNotNull(), F.col("l")).otherwise(near)).otherwise(F.when(F.col("l") == passing, near))
    )
    filtered = F.col("item").isNotNull() & F.col("prefers").isin("left", "right")
    rule = F.when(filtered, F.when(F.col("src_half") == F.when(F.col("prefers") == "left", 0).otherwise(1), "only").otherwise("except"))
    out = rows.withColumns({"to_lane": to_lane, "rule": rule}).filter("to_lane is not null").select(L, place("b", "src", "lane").alias("src"), place("b", "dst", "to_lane").alias("dst"), "rule", F.when(F.col("rule").isNotNull(), F.col("item")).alias("rule_item"))
    under = A.undergrounds(entities.filter("kind = 'underground-belt'"), F.col("reach"), F.col("io_type") == "output").withColumn("lane", F.explode(F.array(F.lit(0), F.lit(1))))
    return out.union(under.select(L, place("b", "entrance", "lane"), place("b", "exit", "lane"), _none(), _none())).distinct()


def _drops(rows: DataFrame, entities: DataFrame, tx: Column, ty: Column, moves: Column) -> DataFrame:
    """rows with target (idx), to_kind and to: the place where an arm that moves in a direction drops at a tile. A belt gets it on the far lane, along the belt
    on the right one, in a curve on the inner one."""
    placed = rows.withColumns({"px": tx, "py": ty, "moves": moves})
    found = A.lookup(placed, F.col("px"), F.col("py"), "target", among=entities)
    kinds = entities.select(L, F.col("idx").alias("target"), F.col("kind").alias("to_kind"), F.col("direction").alias("to_direction"), F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("name").alias("to_name"))
    bent = graphs.cut(curves(belt_feeds(entities)).withColumnsRenamed({"dst": "target"}))
    joined = found.join(kinds, [L, "target"], "left").join(bent, [L, "target"], "left")
    turn = F.pmod(F.col("moves") - F.col("to_direction"), F.lit(16))
    ax, ay = A.vector(F.col("incoming"))
    bx, by = A.vector(F.col("to_direction"))
    lane = F.when(F.col("incoming").isNotNull(), F.when(ax * by - ay * bx > 0, 1).otherwise(0)).when(turn == 4, 1).when(turn == 12, 0).otherwise(1)
    lane = lane + F.when(F.col("to_kind") == "splitter", 2 * _half(F.col("px"), F.col("py"), F.col("to_x"), F.col("to_y"), F.col("to_direction"))).otherwise(0)
    to = F.when(F.col("target").isNull(), place("g", "px", "py")).when(F.col("to_kind").isin(*BELTS), place("b", "target", lane)).otherwise(place("i", "target"))
    return joined.withColumn("to", to).drop("to_direction", "to_x", "to_y", "incoming", "moves")


def hands(entities: DataFrame) -> DataFrame:
    """layout_id, idx, source (idx or null), from_kind, from_tile, target, to_kind, to_name, to, items (array or null), blacklist of each inserter."""
    dx, dy = A.vector(F.col("direction"))
    reach = F.when(F.col("name") == "long-handed-inserter", 2).otherwise(1)
    items = F.filter(F.split(F.coalesce(_extra(entities, "filters"), F.lit("")), ";"), lambda x: x != "")
    rows = entities.filter("kind = 'inserter'").select(L, "idx", "x", "y", "direction", "name", F.when(F.size(items) > 0, items).alias("items"), F.coalesce(_extra(entities, "filter_mode") == "blacklist", F.lit(False)).alias("blacklist"), (reach * dx).alias("rx"), (reach * dy).alias("ry"))
    rows = rows.withColumns({"sx": F.col("x") + F.col("rx"), "sy": F.col("y") + F.col("ry")})
    found = A.lookup(rows, F.col("sx"), F.col("sy"), "source", among=entities)
    kinds = entities.select(L, F.col("idx").alias("source"), F.col("kind").alias("from_kind"), F.col("name").alias("from_name"), F.col("direction").alias("from_direction"), F.col("x").alias("from_x"), F.col("y").alias("from_y"), _extra(entities, "filter").alias("from_filter"), _extra(entities, "output_priority").alias("from_prefers"))
    found = found.join(kinds, [L, "source"], "left")
    found = found.withColumn("from_half", F.when(F.col("from_kind") == "splitter", _half(F.col("sx"), F.col("sy"), F.col("from_x"), F.col("from_y"), F.col("from_direction"))))
    return _drops(found, entities, F.col("x") - F.col("rx"), F.col("y") - F.col("ry"), F.pmod(F.col("direction") + 8, F.lit(16)))


def takes(hand: DataFrame) -> DataFrame:
    """Edges from where hands take to the hands: both lanes of a belt; of a splitter its half under the hand, and of the other what it sends there; what an entity gives;
    the ground."""
    belt = hand.filter(F.col("from_kind").isin("transport-belt", "underground-belt")).withColumn("lane", F.explode(F.array(F.lit(0), F.lit(1)))).select(L, place("b", "source", "lane").alias("src"), "idx", _none().alias("rule"), _none().alias("rule_item"))
    split = hand.filter("from_kind = 'splitter'").withColumn("lane", F.explode(F.array(*map(F.lit, range(4)))))
    filtered = F.col("from_filter").isNotNull() & F.col("from_prefers").isin("left", "right") & (F.floor(F.col("lane") / 2) != F.col("from_half"))
    rule = F.when(filtered, F.when(F.col("from_half") == F.when(F.col("from_prefers") == "left", 0).otherwise(1), "only").otherwise("except"))
    split = split.withColumn("rule", rule).select(L, place("b", "source", "lane").alias("src"), "idx", "rule", F.when(F.col("rule").isNotNull(), F.col("from_filter")).alias("rule_item"))
    entity = hand.filter(F.col("source").isNotNull() & ~F.col("from_kind").isin(*BELTS)).select(L, place("o", "source").alias("src"), "idx", _none(), _none())
    ground = hand.filter("source is null").select(L, place("g", "sx", "sy").alias("src"), "idx", _none(), _none())
    return reduce(DataFrame.union, [belt, split, entity, ground]).select(L, "src", place("h", "idx").alias("dst"), "rule", "rule_item")


def needs(entities: DataFrame, recipes: DataFrame, roles: DataFrame) -> DataFrame:
    """layout_id, idx, need, item: what a machine must receive, one item of each need. A need is an ingredient, or a role of which any item does."""
    wanted = entities.filter("recipe is not null").select(L, "idx", "recipe").join(F.broadcast(recipes.filter("side = 'in'")), "recipe").select(L, "idx", F.col("item").alias("need"), "item")
    any_of = entities.select(L, "idx", "name").join(F.broadcast(roles.filter("role in ('fuel', 'pack', 'smelt')")), "name").select(L, "idx", F.concat(F.lit("any "), "role").alias("need"), "item")
    return wanted.union(any_of).distinct()


def _accepted(entities: DataFrame, recipes: DataFrame, roles: DataFrame) -> DataFrame:
    """layout_id, idx, item: what may be put into an entity that isn't a store."""
    held = entities.select(L, "idx", "name").join(F.broadcast(roles.filter("role = 'ammo'")), "name").select(L, "idx", "item")
    return needs(entities, recipes, roles).select(L, "idx", "item").union(held).distinct()


def gives(hand: DataFrame, entities: DataFrame, recipes: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges from hands to where they drop, through their filters, and into machines what these accept only; and from an entity to the next what it may hand on."""
    accepted = _accepted(entities, recipes, roles)
    stores = entities.filter("kind = 'container'").select(L, F.col("idx").alias("target"))
    # a blacklist is a chain of places, each of which holds back one item
    black = hand.filter("blacklist and items is not null").select(L, "idx", F.posexplode("items").alias("k", "item"))
    step = lambda k: F.when(k == 0, place("h", "idx")).otherwise(F.concat_ws(":", F.lit("h"), F.col("idx").cast("string"), k.cast("string")))
    chain = black.select(L, step(F.col("k")).alias("src"), step(F.col("k") + 1).alias("dst"), F.lit("except").alias("rule"), F.col("item").alias("rule_item"))
    end = F.when(F.col("blacklist") & F.col("items").isNotNull(), step(F.size("items"))).otherwise(place("h", "idx"))
    white = F.when(~F.col("blacklist"), F.col("items"))
    rows = hand.withColumns({"end": end, "white": white})
    free = rows.join(stores.withColumn("store", F.lit(True)), [L, "target"], "left").filter(F.col("store") | F.col("target").isNull() | F.col("to_kind").isin(*BELTS))
    open_ = free.withColumn("rule_item", F.explode_outer("white")).select(L, F.col("end").alias("src"), F.col("to").alias("dst"), F.when(F.col("rule_item").isNotNull(), F.lit("only")).alias("rule"), "rule_item")
    into = rows.join(accepted.withColumnRenamed("idx", "target"), [L, "target"]).filter(F.col("white").isNull() | F.array_contains("white", F.col("item")))
    bound = into.select(L, F.col("end").alias("src"), F.col("to").alias("dst"), F.lit("only").alias("rule"), F.col("item").alias("rule_item"))
    handed = into.join(F.broadcast(roles.filter("role in ('fuel', 'pack', 'ammo')").select(F.col("name").alias("from_name"), "item").distinct()), ["from_name", "item"])
    on = handed.filter(~F.col("blacklist") | ~F.array_contains(F.coalesce("items", F.array().cast("array<string>")), F.col("item"))).select(L, place("i", "source"), F.col("to"), F.lit("only"), F.col("item"))
    return reduce(DataFrame.union, [open_, bound, chain, on]).distinct()


def drills(entities: DataFrame, resource: str) -> DataFrame:
    """layout_id, idx, node, item: what drills put in front of them."""
    dx, dy = A.vector(F.col("direction"))
    middle = lambda a, size: F.col(a) + F.floor((F.col(size) - 1) / 2)
    front = lambda a, size, d: F.when(d > 0, F.col(a) + F.col(size)).when(d < 0, F.col(a) - 1).otherwise(middle(a, size))
    rows = entities.filter("kind = 'mining-drill' and name != 'pumpjack'").select(L, "idx", "name", "x", "y", "w", "h", "direction")
    return _drops(rows, entities, front("x", "w", dx), front("y", "h", dy), F.col("direction")).select(L, "idx", F.col("to").alias("node"), F.lit(resource).alias("item"))


def graph(entities: DataFrame, recipes: DataFrame, roles: DataFrame) -> DataFrame:
    """All edges (EDGE) of layouts: lanes, hands, stores."""
    hand = graphs.cut(hands(entities))
    stores = entities.filter("kind = 'container'").select(L, place("i", "idx").alias("src"), place("o", "idx").alias("dst"), _none().alias("rule"), _none().alias("rule_item"))
    return graphs.cut(reduce(DataFrame.union, [lane_edges(entities), takes(hand), gives(hand, entities, recipes, roles), stores]).select(*EDGE).distinct())


def _no_roles(entities: DataFrame) -> DataFrame:
    return entities.sparkSession.createDataFrame([], ROLES)


def working(entities: DataFrame, recipes: DataFrame, roles: DataFrame, known: DataFrame) -> DataFrame:
    """layout_id, idx of machines each of whose needs something received meets."""
    want = needs(entities, recipes, roles)
    met = known.join(want.withColumn("node", place("i", "idx")), [L, "node", "item"]).groupBy(L, "idx").agg(F.count_distinct("need").alias("met"))
    return met.join(want.groupBy(L, "idx").agg(F.count_distinct("need").alias("needs")), [L, "idx"]).filter("met = needs").select(L, "idx")


def simulate(entities: DataFrame, recipes: DataFrame, inputs: DataFrame, rounds: int | None = None, *, roles: DataFrame | None = None, resource: str = "iron-ore") -> DataFrame:
    """layout_id, node, item: everything that reaches each place. inputs: layout_id, node, item given from outside.

    Items spread along lanes and hands; a machine that has received one item of each need gives its products, a furnace what its items smelt to; drills give the
    resource; stores give what they receive. Repeated until nothing is new.
    """
    roles = _no_roles(entities) if roles is None else roles
    entities = graphs.cut(entities)  # read by each kind of edge, parsed once
    edges = graph(entities, recipes, roles)
    machines = entities.filter("recipe is not null").select(L, "idx", "recipe").join(F.broadcast(recipes.filter("side = 'out'")), "recipe").select(L, "idx", "item")
    smelters = entities.select(L, "idx", "name").join(F.broadcast(roles.filter("role = 'smelt'")), "name").select(L, "idx", place("i", "idx").alias("node"), "item", "product")
    dug = graphs.cut(drills(entities, resource))
    burning = graphs.cut(needs(entities, recipes, roles).select(L, "idx").distinct())
    start = inputs.select(L, "node", "item").union(dug.join(burning, [L, "idx"], "left_anti").select(L, "node", "item"))
    known = graphs.cut(graphs.spread(start, edges, [L], rounds))
    for _ in graphs.counted(rounds):
        works = graphs.cut(working(entities, recipes, roles, known))
        out = place("o", "idx").alias("node")
        made = machines.join(works, [L, "idx"]).select(L, out, "item").union(known.join(smelters, [L, "node", "item"]).join(works, [L, "idx"]).select(L, out, F.col("product").alias("item")))
        made = graphs.cut(made.union(dug.join(works, [L, "idx"]).select(L, "node", "item")).distinct().join(known, [L, "node", "item"], "left_anti"))
        if made.isEmpty():
            break
        known = graphs.cut(known.union(graphs.spread(made, edges, [L], rounds)).distinct())
    return known


def _picks(entities: DataFrame, recipes: DataFrame, roles: DataFrame) -> DataFrame:
    """layout_id, node, item: what hands take from each lane, ANY where a store, a belt or the ground takes all."""
    hand = hands(entities)
    to = takes(hand).filter("src like 'b:%'").select(L, F.col("src").alias("node"), F.split("dst", ":")[1].cast("bigint").alias("idx"))
    stores = entities.filter("kind = 'container'").select(L, F.col("idx").alias("target"), F.lit(True).alias("store"))
    whole = hand.join(stores, [L, "target"], "left").withColumn("all", F.coalesce("store", F.lit(False)) | F.col("target").isNull() | F.col("to_kind").isin(*BELTS))
    white = F.when(~F.col("blacklist"), F.col("items"))
    every = whole.filter("all").withColumn("item", F.explode(F.coalesce(white, F.array(F.lit(ANY))))).select(L, F.col("idx").cast("bigint").alias("idx"), "item")
    some = whole.filter("not all").join(_accepted(entities, recipes, roles).withColumnRenamed("idx", "target"), [L, "target"]).filter(white.isNull() | F.array_contains(white, F.col("item"))).select(L, F.col("idx").cast("bigint"), "item")
    return to.join(every.union(some), [L, "idx"]).select(L, "node", "item").distinct()


def lane_need(entities: DataFrame, recipes: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """layout_id, node, item: what is taken from a lane or from a lane that it flows into; ANY if anything is."""
    roles = _no_roles(entities) if roles is None else roles
    back = lane_edges(entities).select(L, F.col("dst").alias("src"), F.col("src").alias("dst"), "rule", "rule_item")
    picks = _picks(entities, recipes, roles)
    plain = back.withColumns({"rule": _none(), "rule_item": _none()})
    return graphs.spread(picks.filter(F.col("item") != ANY), back, [L]).union(graphs.spread(picks.filter(F.col("item") == ANY), plain, [L])).distinct()


def taken_before(entities: DataFrame, recipes: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """layout_id, node, item: what is taken from a lane or from a lane that flows into it, whatever the filters; ANY if anything is."""
    roles = _no_roles(entities) if roles is None else roles
    return graphs.spread(_picks(entities, recipes, roles), lane_edges(entities).withColumns({"rule": _none(), "rule_item": _none()}), [L])


def upstream(edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """layout_id, node of the lanes (layout_id, node) and of all that flow into them."""
    return graphs.reachable(lanes, edges.select(L, F.col("dst").alias("src"), F.col("src").alias("dst")), [L]).select(L, "node")


def input_ports(entities: DataFrame) -> DataFrame:
    """layout_id, node: lanes that no belt, hand or drill feeds (a splitter's free half isn't one if the other is fed), and stores that are emptied but not filled."""
    lanes = F.explode(F.when(F.col("kind") == "splitter", F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0), F.lit(1))))
    every = entities.filter(F.col("kind").isin(*BELTS)).withColumn("lane", lanes).select(L, "idx", "kind", place("b", "idx", "lane").alias("node"))
    hand = hands(entities)
    dropped = hand.select(L, F.col("to").alias("node")).union(drills(entities, "").select(L, "node")).filter("node like 'b:%'")
    fed = lane_edges(entities).select(L, F.col("dst").alias("node")).union(dropped).distinct()
    touched = fed.select(L, F.split("node", ":")[1].cast("bigint").alias("idx")).distinct().withColumn("touched", F.lit(True))
    free = every.join(fed, [L, "node"], "left_anti").withColumn("idx", F.col("idx").cast("bigint")).join(touched, [L, "idx"], "left").filter("kind != 'splitter' or touched is null").select(L, "node")
    stores = entities.filter((F.col("kind") == "container") & F.coalesce(_extra(entities, "requests"), F.lit("")).eqNullSafe("")).select(L, "idx")
    emptied = stores.join(hand.select(L, F.col("source").alias("idx")), [L, "idx"], "left_semi").join(hand.select(L, F.col("target").alias("idx")), [L, "idx"], "left_anti")
    return free.union(emptied.select(L, place("i", "idx")))


def signs(entities: DataFrame) -> DataFrame:
    """layout_id, idx, items of filter inserters that can never move anything: they take from bare ground onto which nothing is dropped, and don't drop into what
    holds items. Players use them to name an item."""
    hand = hands(entities)
    dropped = hand.filter("target is null").select(L, F.col("to").alias("from_tile")).distinct()
    holds = entities.filter(F.col("holds_items") & ~F.col("kind").isin(*BELTS)).select(L, F.col("idx").alias("target"))
    shown = hand.filter("items is not null and not blacklist and source is null").withColumn("from_tile", place("g", "sx", "sy"))
    return shown.join(dropped, [L, "from_tile"], "left_anti").join(holds, [L, "target"], "left_anti").select(L, "idx", "items")


def inner_inputs(entities: DataFrame, depth: int = 3) -> DataFrame:
    """layout_id, node: input lanes that lie deeper than so many tiles in their layout's box, behind and to both sides."""
    box = entities.groupBy(L).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w") - 1).alias("x1"), F.max(F.col("y") + F.col("h") - 1).alias("y1"))
    ports = input_ports(entities).filter("node like 'b:%'").withColumn("idx", F.split("node", ":")[1].cast("bigint"))
    placed = ports.join(entities.select(L, F.col("idx").cast("bigint").alias("idx"), "x", "y", "direction"), [L, "idx"]).join(box, L)
    west, east, north, south = F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y")
    behind = F.when(F.col("direction") == 4, west).when(F.col("direction") == 12, east).when(F.col("direction") == 8, north).otherwise(south)
    beside = F.when(F.col("direction").isin(4, 12), F.least(north, south)).otherwise(F.least(west, east))
    return placed.filter(F.least(behind, beside) > depth).select(L, "node")


def dead_hands(entities: DataFrame) -> DataFrame:
    """layout_id, idx of hands that take from belts which nothing can ever reach: no port, hand or drill leads to them."""
    hand = graphs.cut(hands(entities))
    starts = input_ports(entities).union(hand.select(L, F.col("to").alias("node"))).union(drills(entities, "").select(L, "node")).filter("node like 'b:%'").distinct()
    live = graphs.reachable(starts, lane_edges(entities).select(L, "src", "dst"), [L]).select(L, F.col("node").alias("src"))
    taking = takes(hand).filter("src like 'b:%'")
    alive = taking.join(live, [L, "src"], "left_semi").select(L, "dst")
    return taking.select(L, "dst").distinct().join(alive, [L, "dst"], "left_anti").select(L, F.split("dst", ":")[1].cast("bigint").alias("idx"))


def verdict(entities: DataFrame, recipes: DataFrame, known: DataFrame, *, roles: DataFrame | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """layout_id, problem, node, item of what is wrong.

    starved: a machine's need that nothing received meets, or a pack that a lab lacks and another gets; no_output: a working machine whose products nobody takes;
    dangling_inserter: a hand with nothing to take, unless what it feeds works anyway or nothing can ever reach its belt, or one that drops into nothing; clog: an item that nobody takes from a lane where others
    are taken from; output_mixed: an input that leaves with products; lane_mixed: a belt with a lane of several items, each once.
    """
    roles = _no_roles(entities) if roles is None else roles
    entities, known = graphs.cut(entities), graphs.cut(known)
    want, works = needs(entities, recipes, roles), graphs.cut(working(entities, recipes, roles, known))
    got = known.filter("node like 'i:%'").withColumn("idx", F.split("node", ":")[1].cast("bigint"))
    met = want.withColumn("idx", F.col("idx").cast("bigint")).join(got.select(L, "idx", "item"), [L, "idx", "item"], "left_semi").select(L, "idx", "need").distinct()
    lacks = want.select(L, F.col("idx").cast("bigint").alias("idx"), "need").distinct().join(met, [L, "idx", "need"], "left_anti").select(L, F.lit("starved").alias("problem"), place("i", "idx").alias("node"), F.col("need").alias("item"))
    labs = entities.filter("kind = 'lab'").select(L, F.col("idx").cast("bigint").alias("idx")).join(works.withColumn("idx", F.col("idx").cast("bigint")), [L, "idx"], "left_semi")
    packs = got.join(labs, [L, "idx"], "left_semi").select(L, "item").distinct()
    short = labs.join(packs, L).join(got.select(L, "idx", "item"), [L, "idx", "item"], "left_anti").select(L, F.lit("starved"), place("i", "idx"), "item")

    hand = graphs.cut(hands(entities))
    products = known.filter("node like 'o:%'").withColumn("idx", F.split("node", ":")[1].cast("bigint"))
    makers = entities.filter("kind in ('assembling-machine', 'furnace')").select(L, F.col("idx").cast("bigint").alias("idx"))
    made = products.join(makers, [L, "idx"])
    left = made.select(L, "idx").distinct().join(hand.select(L, F.col("source").cast("bigint").alias("idx")), [L, "idx"], "left_anti").select(L, F.lit("no_output"), place("o", "idx"), _none())

    stores = entities.filter("kind = 'container'").select(L, F.col("idx").alias("target"))
    accepted = _accepted(entities, recipes, roles).select(L, F.col("idx").alias("target")).union(stores).distinct().withColumn("takes", F.lit(True))
    edges = gives(hand, entities, recipes, roles)
    moved = known.join(takes(hand).union(edges.filter("src like 'i:%'")).select(L, F.col("src").alias("node"), F.col("dst").alias("hand"), "rule", "rule_item"), [L, "node"]).filter(F.col("rule").isNull() | ((F.col("rule") == "only") == (F.col("item") == F.col("rule_item"))))
    through = known.filter("node like 'h:%'").join(edges.select(L, F.col("src").alias("node"), "dst", "rule", "rule_item"), [L, "node"]).filter(F.col("rule").isNull() | ((F.col("rule") == "only") == (F.col("item") == F.col("rule_item"))))
    moves = through.select(L, F.split("node", ":")[1].cast("bigint").alias("idx"))
    handed = moved.filter("node like 'i:%'").join(hand.select(L, F.col("to").alias("hand"), "idx", place("i", "source").alias("node")), [L, "hand", "node"]).select(L, F.col("idx").cast("bigint"))
    moves = moves.union(handed).distinct().withColumn("busy", F.lit(True))
    judged = hand.withColumn("idx", F.col("idx").cast("bigint")).join(moves, [L, "idx"], "left").join(accepted, [L, "target"], "left").join(works.select(L, F.col("idx").alias("target"), F.lit(True).alias("serves")), [L, "target"], "left")
    taken_ground = hand.filter("source is null").select(L, place("g", "sx", "sy").alias("to"), F.lit(True).alias("picked")).distinct()
    judged = judged.join(taken_ground, [L, "to"], "left")
    nowhere = F.col("target").isNotNull() & ~F.col("to_kind").isin(*BELTS) & F.col("takes").isNull()
    judged = judged.join(dead_hands(entities).withColumn("dead", F.lit(True)), [L, "idx"], "left")
    dangling = judged.filter((F.col("busy").isNull() & F.col("serves").isNull() & F.col("dead").isNull()) | (F.col("busy").isNotNull() & F.col("target").isNull() & F.col("picked").isNull()) | nowhere).select(L, F.lit("dangling_inserter"), place("h", "idx"), _none())

    lanes = known.filter("node like 'b:%'")
    edges_of_lanes = graphs.cut(lane_edges(entities))
    need, before = graphs.cut(lane_need(entities, recipes, roles)), graphs.cut(taken_before(entities, recipes, roles))
    ends = lanes.join(edges_of_lanes.select(L, F.col("src").alias("node")), [L, "node"], "left_anti")
    outputs = graphs.cut(ends.join(made.select(L, "item").union(drills(entities, "").select(L, "item")).distinct(), [L, "item"], "left_semi"))
    leads_out = upstream(edges_of_lanes, outputs.select(L, "node").distinct())
    anyway = need.union(before).filter(F.col("item") == ANY).select(L, "node").union(leads_out).distinct()
    inside = lanes.join(anyway, [L, "node"], "left_anti")
    useful = inside.join(need, [L, "node", "item"], "left_semi").select(L, "node").distinct()
    stuck = inside.join(useful, [L, "node"], "left_semi").join(need.union(before), [L, "node", "item"], "left_anti")
    belt = F.concat(F.lit("b:"), F.split("node", ":")[1])
    clogs = stuck.select(L, F.lit("clog"), belt.alias("node"), "item").distinct()

    found = [lacks, short, left, dangling, clogs]
    if inputs is not None:
        given = inputs.select(L, "item").distinct().join(made.select(L, "item").distinct(), [L, "item"], "left_anti")
        free = before.filter(F.col("item") == ANY).select(L, "node").distinct()
        mixed_out = lanes.join(outputs.select(L, "node").distinct(), [L, "node"], "left_semi").join(free, [L, "node"], "left_anti").join(given, [L, "item"], "left_semi").join(before, [L, "node", "item"], "left_anti")
        found.append(mixed_out.select(L, F.lit("output_mixed"), "node", "item"))
    crowded = lanes.groupBy(L, "node").agg(F.count_distinct("item").alias("n"), F.min("item").alias("item")).filter("n > 1")
    found.append(crowded.groupBy(L, belt.alias("node")).agg(F.min("item").alias("item")).select(L, F.lit("lane_mixed"), "node", "item"))
    return reduce(DataFrame.union, [f.toDF(L, "problem", "node", "item") for f in found])


def final_products(entities: DataFrame, recipes: DataFrame) -> DataFrame:
    """Items that a layout's recipes make and none of them uses."""
    used = entities.filter("recipe is not null").select(L, "recipe").distinct().join(F.broadcast(recipes), "recipe")
    return used.filter("side = 'out'").select(L, "item").distinct().join(used.filter("side = 'in'").select(L, "item").distinct(), [L, "item"], "left_anti")

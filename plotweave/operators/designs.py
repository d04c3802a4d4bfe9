"""Designs: a head, a segment and a tail along x, cut out of layouts, built again with any number of segments, and checked.

entities of designs: design, part ('head', 'segment', 'tail'), idx, name, kind, x, y, w, h, direction, recipe, io_type, ...; headers: design, period, repeats.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators import graphs, sequential, validator
from plotweave.operators import layouts as A

L, D = "layout_id", "design"
#: Tiers of belts, slowest first, as (belt, underground, splitter), and the reach of their undergrounds.
TIERS = (("transport-belt", "underground-belt", "splitter"), ("fast-transport-belt", "fast-underground-belt", "fast-splitter"), ("express-transport-belt", "express-underground-belt", "express-splitter"))
REACH = (5, 7, 9)
#: Undergrounds of one line whose tiers are tried in every combination, at most.
EXHAUSTIVE = 7
#: Issues of power that a design must never have.
POWER = ("pole_islands", "unpowered", "no_poles")
_KEY = ("name", "x", "y", "direction", "recipe", "io_type")


def key_of(prefix: str = "") -> Column:
    """What makes two entities equal, as one string."""
    return F.concat_ws("|", *(F.coalesce(F.col(prefix + c).cast("string"), F.lit("")) for c in _KEY))


def build(entities: DataFrame, headers: DataFrame, segments: Column) -> DataFrame:
    """layout_id (design and number of segments), design and the entities of a build of so many segments (a number, or a column of headers); equal ones once."""
    h = headers.select(D, "period", "repeats", segments.cast("int").alias("n"))
    joined = entities.join(F.broadcast(h), D)
    shift = F.when(F.col("part") == "segment", F.col("k")).when(F.col("part") == "tail", F.col("n") - F.col("repeats")).otherwise(0) * F.col("period")
    copies = F.sequence(F.lit(0), F.when(F.col("part") == "segment", F.col("n") - 1).otherwise(0))
    placed = joined.withColumn("k", F.explode(copies)).withColumn("x", F.col("x") + shift).withColumn(L, F.concat_ws("x", F.col(D).cast("string"), F.col("n").cast("string")))
    order = F.struct((F.when(F.col("part") == "head", 0).when(F.col("part") == "segment", 1).otherwise(2)).alias("p"), "k", "idx")
    w = Window.partitionBy(L, key_of()).orderBy(order)
    first = placed.withColumn("_o", order).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return first.withColumn("idx", F.row_number().over(Window.partitionBy(L).orderBy("_o")) - 1).drop("_o", "_n", "k", "part", "n", "repeats", "period")


def copies_apart(entities: DataFrame, n: int, dx: int, dy: int = 0) -> DataFrame:
    """n shifted copies of each layout, equal entities once; a layout whose copies overlap otherwise is left out."""
    moved = entities.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"x": F.col("x") + F.col("k") * dx, "y": F.col("y") + F.col("k") * dy})
    w = Window.partitionBy(L, key_of()).orderBy("k", "idx")
    once = moved.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    once = once.withColumn("idx", F.row_number().over(Window.partitionBy(L).orderBy("k", "idx")) - 1)
    return once.join(A.collisions(once).select(L).distinct(), L, "left_anti")


def extract(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Designs of the layouts that repeat along x: their entities by part, the segment at the origin, and headers. A layout that its design doesn't rebuild,
    belts that close a line apart, gives none. entities: as parsed; lamps and labels are left out."""
    solid = graphs.cut(entities.filter(~F.col("kind").isin(*sequential.DECOR)))
    found = graphs.cut(sequential.periods(solid))
    joined = solid.join(found.drop("cell"), L)
    end = F.col("start") + F.col("repeats") * F.col("period")
    cell = F.floor((F.col("x") - F.col("start")) / F.col("period"))
    inner = (F.col("x") >= F.col("start")) & (F.col("x") < end)
    # belts of the segment are those of an inner cell, or of the halves that border one another where there are two
    position = F.col("x") - F.col("start") - cell * F.col("period")
    second = F.least(F.col("repeats") - 1, F.lit(1))
    from_cell = F.when(F.col("kind") != "transport-belt", 0).when(F.col("repeats") > 2, second).otherwise(F.when(position * 2 < F.col("period"), 1).otherwise(0))
    part = F.when(F.col("x") < F.col("start"), "head").when(F.col("x") >= end, "tail").when(cell == from_cell, "segment")
    rows = joined.withColumns({"part": part, "cell": cell}).filter("part is not null")
    rows = rows.withColumn("x", F.when(F.col("part") == "segment", F.col("x") - F.col("start") - F.col("cell") * F.col("period")).otherwise(F.col("x") - F.col("start")))
    designs = rows.withColumn(D, F.col(L)).drop(L, "cell", "start", "repeats", "period")
    headers = found.select(F.col(L).alias(D), "period", "repeats", "start")
    again = build(designs, headers, F.col("repeats")).select(D, key_of().alias("key"), (F.col("kind") == "transport-belt").alias("belt"))
    source = joined.withColumn("x", F.col("x") - F.col("start")).select(F.col(L).alias(D), key_of().alias("key"))
    missing = source.filter(F.lit(True)).join(again.select(D, "key"), [D, "key"], "left_anti").select(D)
    added = again.filter("not belt").join(source, [D, "key"], "left_anti").select(D)
    wrong = missing.union(added).distinct()
    return designs.join(wrong, D, "left_anti"), headers.drop("start").join(wrong, D, "left_anti")


def cells(entities: DataFrame, snap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole layouts as designs of one segment, whose copies stand a grid apart (snap: layout_id, w) where that isn't wider, else their width."""
    width = entities.groupBy(L).agg((F.max(F.col("x") + F.col("w")) - F.min("x")).alias("width"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    headers = width.join(snap.select(L, F.col("w").alias("grid")), L, "left").select(F.col(L).alias(D), F.when(F.col("grid") <= F.col("width"), F.col("grid")).otherwise(F.col("width")).alias("period"), F.lit(1).alias("repeats"))
    moved = entities.join(width, L).withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0"), "part": F.lit("segment"), D: F.col(L)})
    return moved.drop(L, "width", "x0", "y0"), headers


def weaving(entities: DataFrame) -> DataFrame:
    """layout_id of the layouts where an underground pair passes another underground of its line, of whatever name."""
    ends = entities.filter("kind = 'underground-belt'")
    pairs = A.undergrounds(ends, F.coalesce("reach", F.lit(5)), F.col("io_type") == "output")
    vertical = F.col("direction") % 8 == 0
    placed = ends.select(L, "idx", vertical.alias("vertical"), F.when(vertical, F.col("x")).otherwise(F.col("y")).alias("line"), F.when(vertical, F.col("y")).otherwise(F.col("x")).alias("at"))
    spans = pairs.join(placed.withColumnRenamed("idx", "entrance"), [L, "entrance"]).join(placed.select(L, F.col("idx").alias("exit"), F.col("at").alias("to")), [L, "exit"])
    inside = spans.join(placed.select(L, "vertical", "line", F.col("at").alias("between")), [L, "vertical", "line"])
    return inside.filter((F.col("between") > F.least("at", "to")) & (F.col("between") < F.greatest("at", "to"))).select(L).distinct()


def _pairs(rows: list[tuple], tiers: dict[int, int]) -> dict[int, int]:
    """Entrance and exit of the undergrounds (idx, direction, out, line, at) by the tiers given: the next one of a tier on the line must be an exit of the same direction within reach."""
    found = {}
    lines: dict[tuple, list[tuple]] = {}
    for idx, direction, out, line, at in rows:
        lines.setdefault((direction % 8, line, tiers[idx]), []).append((at, idx, direction, out))
    for (_, _, tier), ends in lines.items():
        ends.sort()
        for k, (at, idx, direction, out) in enumerate(ends):
            ahead = k + (1 if direction in (4, 8) else -1)
            if not out and 0 <= ahead < len(ends):
                to, other, other_direction, other_out = ends[ahead]
                if other_out and other_direction == direction and abs(to - at) <= REACH[tier]:
                    found[idx] = other
    return found


def retiered(entities: DataFrame, tier: int) -> DataFrame:
    """layout_id, idx, name of all belts, undergrounds and splitters at a tier (0 to 2). A pair of undergrounds that would connect otherwise at that tier gets the
    nearest other tier that keeps it; a layout where none does is left out."""
    place = {name: (t, k) for t, names in enumerate(TIERS) for k, name in enumerate(names)}
    rows = entities.filter(F.col("name").isin(*place)).select(L, "idx", "name", "kind", "x", "y", "direction", (F.col("io_type") == "output").alias("out"))
    kind = entities.schema["idx"].dataType.simpleString()

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        ends = [(int(r.idx), int(r.direction), bool(r.out), int(r.x if r.direction % 8 == 0 else r.y), int(r.y if r.direction % 8 == 0 else r.x)) for r in frame[frame["kind"] == "underground-belt"].itertuples()]
        own = {int(r.idx): place[r.name][0] for r in frame.itertuples()}
        want = _pairs(ends, own)
        chosen = {i: tier for i in own}
        back = {b: a for a, b in want.items()}
        spans: dict[tuple, list[tuple]] = {}
        for idx, direction, out, line, at in ends:
            if idx in back:
                continue
            far = next(e[4] for e in ends if e[0] == want[idx]) if idx in want else at + max(REACH) * (1 if (direction in (4, 8)) != out else -1)
            spans.setdefault((direction % 8, line), []).append((min(at, far), max(at, far), (idx, want[idx]) if idx in want else (idx,)))
        for group in spans.values():
            clusters, reach = [], None
            for low, high, unit in sorted(group):
                if reach is None or low > reach:
                    clusters.append([])
                clusters[-1].append(unit)
                reach = high if reach is None or low > reach else max(reach, high)
            for units in clusters:
                members = {i for u in units for i in u}
                local = [e for e in ends if e[0] in members]
                goal = {a: b for a, b in want.items() if a in members}
                first = tuple(own[u[0]] for u in units)
                most = max(set(first), key=lambda t: (first.count(t), -first.index(t)))
                options = itertools.product(range(len(TIERS)), repeat=len(units)) if len(units) <= EXHAUSTIVE else [(tier,) * len(units), tuple(tier if t == most else t for t in first), first]
                keeping = [o for o in options if _pairs(local, {i: t for u, t in zip(units, o, strict=True) for i in u}) == goal]
                if not keeping:
                    return pd.DataFrame([], columns=[L, "idx", "name"])
                best = min(keeping, key=lambda o: (sum(t != tier for t in o), sum(abs(t - tier) for t in o), -sum(o)))
                chosen.update({i: t for u, t in zip(units, best, strict=True) for i in u})
        return pd.DataFrame({L: frame[L], "idx": frame["idx"], "name": [TIERS[chosen[int(r.idx)]][place[r.name][1]] for r in frame.itertuples()]})

    return rows.groupBy(L).applyInPandas(work, f"{L} {entities.schema[L].dataType.simpleString()}, idx {kind}, name string")


def tiling_problems(entities: DataFrame, headers: DataFrame, source: DataFrame, segments: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """design, n, category of what is wrong with builds of so many segments: errors, warnings of kinds that the source doesn't have, and issues of power.
    source: design, category of the source's issues."""
    sizes = headers.withColumn("n", F.explode(F.array(*map(F.lit, segments))))
    builds = None
    for n in segments:
        one = build(entities, sizes.filter(F.col("n") == n), F.lit(n)).withColumn("n", F.lit(n))
        builds = one if builds is None else builds.unionByName(one)
    names = builds.select(L, D, "n").distinct()
    issues = validator.issues(builds.drop(D, "n").withColumn("reject", F.lit(None).cast("string"))).join(names, L)
    known = source.select(D, "category").distinct().withColumn("known", F.lit(True))
    judged = issues.join(known, [D, "category"], "left")
    return judged.filter((F.col("severity") == "error") | F.col("known").isNull() | F.col("category").isin(*POWER)).select(D, "n", "category").distinct()


def pruned_lines(edges: DataFrame, core: DataFrame, stops: DataFrame, margin: int, keys: list[str]) -> DataFrame:
    """keys, node of a graph (edges: keys, a, b) that stay: the core (keys, node) and every path between its nodes, and up to margin steps of each tail that
    was cut off, but not through stops (keys, node)."""
    left = graphs.pruned(edges, core, keys)
    ends = lambda e: e.select(*keys, F.col("a").alias("node")).union(e.select(*keys, F.col("b").alias("node"))).distinct()
    kept = graphs.cut(ends(left).union(core.select(*keys, "node")).distinct())
    both = edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b"), F.col("a")))
    frontier = kept
    for _ in range(margin):
        grown = frontier.withColumnRenamed("node", "a").join(both, [*keys, "a"]).select(*keys, F.col("b").alias("node")).distinct()
        frontier = graphs.cut(grown.join(kept, [*keys, "node"], "left_anti").join(stops.select(*keys, "node"), [*keys, "node"], "left_anti"))
        kept = graphs.cut(kept.union(frontier))
    return kept


def to_json(entities: DataFrame, headers: DataFrame) -> DataFrame:
    """design, json: the design as one record, its parts as lists of [name, x, y, direction, settings]."""
    from plotweave.operators import records

    extras = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("io_type", "recipe"))), lambda e: e["v"].isNotNull() & ~((e["k"] == "io_type") & (e["v"] == "input")))
    row = F.struct("idx", "name", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("direction").cast("int").alias("direction"), F.map_from_entries(extras).alias("extras"))
    parts = entities.groupBy(D).agg(*(F.array_sort(F.collect_list(F.when(F.col("part") == p, row.dropFields("extras").withField("extras", F.map_entries(row["extras"]))))).alias(p) for p in ("head", "segment", "tail")))
    packed = lambda p: records.placed_to_json(F.transform(p, lambda e: F.struct(e["name"].alias("name"), e["x"].alias("x"), e["y"].alias("y"), e["direction"].alias("direction"), F.map_from_entries(e["extras"]).alias("extras"))))
    body = F.concat(F.lit('{"period":'), F.col("period").cast("string"), F.lit(',"repeats":'), F.col("repeats").cast("string"), *(x for p in ("head", "segment", "tail") for x in (F.lit(f',"{p}":'), packed(F.col(p)))), F.lit("}"))
    return parts.join(headers, D).select(D, body.alias("json"))


def from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entities (design, part, idx, name, x, y, direction, recipe, io_type) and headers of designs as JSON (design, json)."""
    from plotweave.operators import records

    headers = rows.select(D, F.get_json_object("json", "$.period").cast("int").alias("period"), F.get_json_object("json", "$.repeats").cast("int").alias("repeats"))
    found = None
    for p in ("head", "segment", "tail"):
        part = rows.select(D, F.lit(p).alias("part"), F.posexplode(records.placed_from_json(F.get_json_object("json", f"$.{p}"))).alias("idx", "e"))
        found = part if found is None else found.union(part)
    one = lambda k: F.element_at(F.col("e.extras"), F.lit(k))
    return found.select(D, "part", "idx", "e.name", "e.x", "e.y", "e.direction", one("recipe").alias("recipe"), F.coalesce(one("io_type"), F.lit("input")).alias("io_type")), headers

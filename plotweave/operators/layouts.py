"""Operators on many layouts at once: one row an entity, layout_id first in every key.

An entity has layout_id, idx (its place in its layout), name, x, y (its smallest tile), w, h (tiles), direction (0 north, 4 east, 8 south, 12 west).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators import graphs

L = "layout_id"


def vector(direction: Column) -> tuple[Column, Column]:
    """dx, dy of a direction."""
    dx = F.when(direction == 4, 1).when(direction == 12, -1).otherwise(0)
    dy = F.when(direction == 8, 1).when(direction == 0, -1).otherwise(0)
    return dx, dy


def tiles(entities: DataFrame) -> DataFrame:
    """A row for each tile of each entity: tx, ty."""
    columns = F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1))
    rows = F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1))
    return entities.withColumn("tx", columns).withColumn("ty", rows)


def owners(tiled: DataFrame) -> DataFrame:
    """The first entity of each tile."""
    return tiled.groupBy(L, "tx", "ty").agg(F.min("idx").alias("owner"))


def collisions(entities: DataFrame) -> DataFrame:
    """Pairs (owner, idx) of entities on one tile; each later entity meets the tile's first one only, each pair once."""
    tiled = tiles(entities).select(L, "idx", "tx", "ty")
    return tiled.join(owners(tiled), [L, "tx", "ty"]).filter("owner < idx").select(L, "owner", "idx").distinct()


def lookup(entities: DataFrame, tx: Column, ty: Column, name: str = "target", among: DataFrame | None = None) -> DataFrame:
    """entities with the owner of a computed tile, or null; owners are looked for among other entities if given."""
    found = owners(tiles(entities if among is None else among).select(L, "idx", "tx", "ty")).select(F.col(L).alias("_l"), F.col("tx").alias("_x"), F.col("ty").alias("_y"), F.col("owner").alias(name))
    at = entities.withColumn("_tx", tx).withColumn("_ty", ty)
    return at.join(found, (at[L] == found["_l"]) & (at["_tx"] == found["_x"]) & (at["_ty"] == found["_y"]), "left").drop("_l", "_x", "_y", "_tx", "_ty")


def front(entities: DataFrame) -> DataFrame:
    """The entity in front of each entity of one tile."""
    dx, dy = vector(F.col("direction"))
    return lookup(entities, F.col("x") + dx, F.col("y") + dy)


def undergrounds(entities: DataFrame, reach: Column, is_exit: Column) -> DataFrame:
    """Entrances with the nearest underground of their name ahead, where it is an exit of their direction within reach; anything else blocks.

    lead over each line orders both ways of it, so nothing is compared pairwise.
    """
    dx, dy = vector(F.col("direction"))
    vertical = F.col("direction") % 8 == 0
    line, at = F.when(vertical, F.col("x")).otherwise(F.col("y")), F.when(vertical, F.col("y")).otherwise(F.col("x"))
    rows = entities.withColumns({"vertical": vertical, "line": line, "at": at, "sign": F.when(dx + dy > 0, 1).otherwise(-1), "out": is_exit, "reach": reach})
    w = Window.partitionBy(L, "name", "vertical", "line").orderBy("at", "idx")
    near = F.struct("idx", "at", "direction", "out")
    looked = rows.withColumn("next", F.when(F.col("sign") > 0, F.lead(near).over(w)).otherwise(F.lag(near).over(w)))
    ok = ~F.col("out") & F.col("next.out") & (F.col("next.direction") == F.col("direction")) & (F.abs(F.col("next.at") - F.col("at")) <= F.col("reach"))
    return looked.filter(ok).select(L, F.col("idx").alias("entrance"), F.col("next.idx").alias("exit"), F.abs(F.col("next.at") - F.col("at")).alias("distance"))


def unpowered(consumers: DataFrame, poles: DataFrame, cell: int = 8) -> DataFrame:
    """Consumers that no pole's supply square overlaps. poles: px, py (centre), half. An equi join on cells stands for the range join.

    Each box and each square takes part once, so the join grows with a layout's places, whatever the number of entities on each.
    """
    span = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
    eps = 1e-9
    box = [L, "x", "y", "w", "h"]
    p = poles.select(L, "px", "py", "half").distinct().withColumn("cx", span(F.col("px") - F.col("half"), F.col("px") + F.col("half"))).withColumn("cy", span(F.col("py") - F.col("half"), F.col("py") + F.col("half")))
    c = consumers.select(box).distinct().withColumn("cx", span(F.col("x"), F.col("x") + F.col("w"))).withColumn("cy", span(F.col("y"), F.col("y") + F.col("h")))
    near = c.join(p, [L, "cx", "cy"])
    covered = near.filter(
        (F.col("px") - F.col("half") < F.col("x") + F.col("w") - eps) & (F.col("px") + F.col("half") > F.col("x") + eps)
        & (F.col("py") - F.col("half") < F.col("y") + F.col("h") - eps) & (F.col("py") + F.col("half") > F.col("y") + eps)
    )
    return consumers.join(covered.select(box).distinct(), box, "left_anti")


def within(dx: Column, dy: Column, distance: float, square: bool = False) -> Column:
    """Whether so far apart on each axis is within a distance (square: on each axis)."""
    return (dx <= distance) & (dy <= distance) if square else dx * dx + dy * dy <= distance * distance + 1e-9


def near_pairs(points: DataFrame, distance: float, *, square: bool = False) -> DataFrame:
    """a < b of each layout's points (idx, x, y) within a distance (square: on each axis), by cells of that size."""
    cell = max(distance, 1.0)
    home = points.select(L, F.col("idx").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    around = points.select(
        L, F.col("idx").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.array(*[F.floor(F.col("x") / cell) + i for i in (-1, 0, 1)])).alias("cx"), F.floor(F.col("y") / cell).alias("_cy")
    ).withColumn("cy", F.explode(F.array(*[F.col("_cy") + i for i in (-1, 0, 1)])))
    near = within(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")), distance, square)
    return home.join(around, [L, "cx", "cy"]).filter((F.col("a") < F.col("b")) & near).select(L, "a", "b")


def near_counts(points: DataFrame, distance: float, *, square: bool = False) -> DataFrame:
    """pairs and largest: how many near_pairs each layout has and their largest b, without those pairs: places meet, with the counts of their points.

    Points of one idx count among those of their places but aren't pairs, so they are taken off again.
    """
    placed = points.select(L, "idx", "x", "y").dropna()
    own = F.shiftright(F.col("n") * (F.col("n") - 1), 1)
    places = placed.groupBy(L, "x", "y").agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    apart = near_pairs(places.withColumn("idx", F.struct("x", "y", "n", "low", "high")), distance, square=square)
    met = apart.select(L, (F.col("a.n") * F.col("b.n")).alias("pairs"), F.least("a.low", "b.low").alias("low"), F.greatest("a.high", "b.high").alias("high")).union(places.select(L, own, "low", "high"))
    found = met.groupBy(L).agg(F.sum("pairs").alias("met"), F.max(F.when(F.col("low") < F.col("high"), F.col("high"))).alias("largest"))
    again = placed.groupBy(L, "idx", "x", "y").agg(F.count("*").alias("n"))
    other = again.select(L, "idx", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("bn"))
    near = within(F.abs(F.col("x") - F.col("bx")), F.abs(F.col("y") - F.col("by")), distance, square)
    twins = again.join(other, [L, "idx"]).filter((F.struct("x", "y") < F.struct("bx", "by")) & near).select(L, (F.col("n") * F.col("bn")).alias("n")).union(again.select(L, own))
    kept = found.join(twins.groupBy(L).agg(F.sum("n").alias("twins")), L).withColumn("pairs", F.col("met") - F.col("twins"))
    return kept.filter("pairs > 0").select(L, "pairs", "largest")


def near_components(points: DataFrame, distance: float) -> DataFrame:
    """node, root (the smallest node of its component): the components that near_pairs makes of points (idx is the node), without those pairs.

    Points of a cell whose diagonal is the distance are all near one another. Cells stand for them and are joined where two of their places are near, so
    pairs grow with a layout's places and rounds with its cells, whatever the number of points on each. An idx on several places is one node and joins them.
    """
    side = distance / math.sqrt(2)
    placed = points.select(L, "idx", "x", "y").dropna().withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)})
    cells = graphs.cut(placed.groupBy(L, "gx", "gy").agg(F.min("idx").alias("cell")))
    places = placed.select(L, "x", "y", "gx", "gy").distinct().join(cells, [L, "gx", "gy"])
    homes = placed.join(cells, [L, "gx", "gy"]).select(L, "idx", "cell", F.min("cell").over(Window.partitionBy(L, "idx")).alias("home"))
    edges = near_pairs(places.select(L, F.col("cell").alias("idx"), "x", "y"), distance).union(homes.filter("cell != home").select(L, "home", "cell"))
    found = graphs.components(cells.select(L, F.col("cell").alias("node")), edges, [L])
    return homes.select(L, "idx", "home").distinct().join(found.withColumnRenamed("node", "home"), [L, "home"]).select(L, F.col("idx").alias("node"), "root")


def straight_runs(entities: DataFrame, least: int = 3) -> DataFrame:
    """Maximal runs of equal name and direction along the direction, of so many tiles or more, by gaps and islands."""
    vertical = F.col("direction") % 8 == 0
    rows = entities.select(L, "name", "direction", F.when(vertical, F.col("x")).otherwise(F.col("y")).alias("line"), F.when(vertical, F.col("y")).otherwise(F.col("x")).alias("at")).distinct()
    w = Window.partitionBy(L, "name", "direction", "line").orderBy("at")
    rows = rows.withColumn("island", F.col("at") - F.row_number().over(w))
    return rows.groupBy(L, "name", "direction", "line", "island").agg(F.min("at").alias("first"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("island")


def span_clusters(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of overlapping spans (low, high, inclusive) of each line: low, high, how many spans."""
    w = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (before < F.col("low")), 1).otherwise(0)).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "cluster").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("spans")).drop("cluster")


def normalized(entities: DataFrame) -> DataFrame:
    """Moved so that each layout's smallest tile is (0, 0), and numbered by y, x and name."""
    low = entities.groupBy(L).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    moved = entities.join(low, L).withColumn("x", F.col("x") - F.col("_x")).withColumn("y", F.col("y") - F.col("_y")).drop("_x", "_y")
    w = Window.partitionBy(L).orderBy("y", "x", "name", "direction", "idx")
    return moved.withColumn("idx", F.row_number().over(w) - 1)


def rotated(entities: DataFrame, turns: int) -> DataFrame:
    """Turned clockwise by so many quarters about the origin; footprints and directions turn too."""
    out = entities
    for _ in range(turns % 4):
        out = out.withColumns({"x": -F.col("y") - F.col("h") + 1, "y": F.col("x"), "w": F.col("h"), "h": F.col("w"), "direction": (F.col("direction") + 4) % 16})
    return out


def extent(entities: DataFrame) -> DataFrame:
    """width, height, tiles covered, and their share of the bounding box, of each layout."""
    box = entities.groupBy(L).agg((F.max(F.col("x") + F.col("w")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("height"))
    covered = tiles(entities).select(L, "tx", "ty").distinct().groupBy(L).agg(F.count("*").alias("covered"))
    return box.join(covered, L).withColumn("density", F.col("covered") / (F.col("width") * F.col("height")))


def area_share(entities: DataFrame, chosen: Column) -> DataFrame:
    """The share of the chosen entities in each layout's footprint area."""
    area = F.col("w") * F.col("h")
    return entities.groupBy(L).agg((F.sum(F.when(chosen, area).otherwise(0)) / F.sum(area)).alias("share"))


def facts(entities: DataFrame) -> DataFrame:
    """total, width, height and main direction (the first one seen among the most common) of each layout."""
    counts = entities.groupBy(L, "direction").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    main = counts.groupBy(L).agg(F.max_by("direction", F.struct("n", -F.col("first"))).alias("main_direction"))
    total = entities.groupBy(L).agg(F.count("*").alias("total"), F.count_distinct("name").alias("names"))
    return total.join(main, L).join(extent(entities).select(L, "width", "height"), L)


def signature(entities: DataFrame) -> DataFrame:
    """A hash of each layout's set of entities; equal for layouts that are equal after normalized()."""
    key = F.concat_ws(",", "name", "x", "y", "direction")
    return normalized(entities).groupBy(L).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(key)), ";"), 256).alias("signature"))


def copies(entities: DataFrame, n: int, dx: int, dy: int = 0) -> DataFrame:
    """n shifted copies of each layout, equal entities merged."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    moved = entities.withColumn("k", k).withColumns({"x": F.col("x") + F.col("k") * dx, "y": F.col("y") + F.col("k") * dy})
    return moved.groupBy(L, "name", "x", "y", "w", "h", "direction").agg(F.min(F.struct("k", "idx")).alias("o")).select(L, "name", "x", "y", "w", "h", "direction", F.col("o.k").alias("k"), F.col("o.idx").alias("idx"))

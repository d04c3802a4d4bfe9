"""The static layout validator: issues of all layouts as one table, from set-based and spatial joins.

Entities as plotweave.sources.layout_strings.entities returns them. issues: layout_id, severity, category, idx, x, y.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.operators import graphs, sequential
from plotweave.operators import layouts as A

L = "layout_id"
BELTS = ("transport-belt", "underground-belt", "splitter")


def _issue(rows: DataFrame, severity: str, category: Column | str) -> DataFrame:
    return rows.select(L, F.lit(severity).alias("severity"), (F.lit(category) if isinstance(category, str) else category).alias("category"), "idx", "x", "y")


def _bounds(entities: DataFrame) -> DataFrame:
    return entities.groupBy(L).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w") - 1).alias("x1"), F.max(F.col("y") + F.col("h") - 1).alias("y1"))


def _inside(tx: str, ty: str) -> Column:
    return F.col(tx).between(F.col("x0"), F.col("x1")) & F.col(ty).between(F.col("y0"), F.col("y1"))


def _at(rows: DataFrame, entities: DataFrame, tx: Column, ty: Column) -> DataFrame:
    """rows with px, py and what is there: other (idx), other_kind, other_direction, other_io, other_holds."""
    rows = rows.withColumns({"px": tx, "py": ty}).join(_bounds(entities), L)
    found = A.lookup(rows, F.col("px"), F.col("py"), "other", among=entities)
    there = entities.select(F.col(L), F.col("idx").alias("other"), F.col("kind").alias("other_kind"), F.col("direction").alias("other_direction"), F.col("io_type").alias("other_io"), F.col("holds_items").alias("other_holds"))
    return found.join(there, [L, "other"], "left")


def collisions(entities: DataFrame) -> DataFrame:
    """Entities on a tile that an earlier one owns, and pumps whose tile in front has an owner."""
    dx, dy = A.vector(F.col("direction"))
    pumps = entities.filter("name = 'offshore-pump'").withColumns({"fx": F.col("x") + F.when(dx > 0, F.col("w")).otherwise(dx), "fy": F.col("y") + F.when(dy > 0, F.col("h")).otherwise(dy)})
    reaching = A.lookup(pumps, F.col("fx"), F.col("fy"), "other", among=entities).filter("other is not null")
    return _issue(A.collisions(entities).join(entities, [L, "idx"]), "error", "collision").union(_issue(reaching, "error", "collision"))


def belts(entities: DataFrame) -> DataFrame:
    dx, dy = A.vector(F.col("direction"))
    moving = A.tiles(entities.filter(F.col("kind").isin(*BELTS) & ~((F.col("kind") == "underground-belt") & (F.col("io_type") == "input"))))
    ahead = _at(moving, entities, F.col("tx") + dx, F.col("ty") + dy).filter(F.col("other").isNull() | (F.col("other") != F.col("idx")))
    plain = F.col("kind") != "splitter"
    belt = F.col("other_kind").isin(*BELTS)
    opposed = (F.pmod(F.col("other_direction") - F.col("direction"), F.lit(16)) == 8) & ~((F.col("other_kind") == "underground-belt") & (F.col("other_io") == "output"))
    category = (
        F.when(F.col("other").isNull(), F.when(_inside("px", "py") & plain, "belt_end")).when(belt, F.when(opposed, "belt_head_on")).when(plain, "belt_end")
    )
    return _issue(ahead.withColumn("category", category).filter("category is not null").withColumns({"x": F.col("tx"), "y": F.col("ty")}), "warning", F.col("category"))


def lone_undergrounds(entities: DataFrame) -> DataFrame:
    """Ends that are in no pair, where each entrance takes the nearest exit ahead that no earlier one has taken."""
    ends = entities.filter("kind = 'underground-belt'")
    pairs = sequential.greedy_pairs(ends)
    paired = pairs.select(L, F.col("entrance").alias("idx")).union(pairs.select(L, "exit"))
    return _issue(ends.join(paired, [L, "idx"], "left_anti"), "warning", "lone_underground")


def inserters(entities: DataFrame) -> DataFrame:
    dx, dy = A.vector(F.col("direction"))
    reach = F.when(F.col("name") == "long-handed-inserter", 2).otherwise(1)
    hands = entities.filter("kind = 'inserter'")
    out = []
    for way in (1, -1):  # takes from the side it points to, drops on the other
        there = _at(hands, entities, F.col("x") + way * reach * dx, F.col("y") + way * reach * dy)
        ground = there.filter(F.col("other").isNull() & _inside("px", "py"))
        holds = F.col("other_holds") & ((F.col("other_kind") != "inserter"))
        out += [_issue(ground, "warning", "inserter_ground"), _issue(there.filter(F.col("other").isNotNull() & ~F.coalesce(holds, F.lit(False))), "error", "inserter_target")]
    return reduce(DataFrame.union, out)


def _poles(entities: DataFrame) -> DataFrame:
    return entities.filter("kind = 'electric-pole'").select(L, "idx", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"), F.col("supply").alias("half"), "wire")


def power(entities: DataFrame) -> DataFrame:
    consumers, poles = entities.filter("electric"), _poles(entities)
    first = lambda rows, category: rows.groupBy(L).agg(F.min_by(F.struct("idx", "x", "y"), "idx").alias("e")).select(L, F.lit("warning").alias("severity"), F.lit(category).alias("category"), "e.idx", "e.x", "e.y")
    lit = consumers.join(poles.select(L).distinct(), L, "left_semi")
    return first(consumers.join(poles.select(L).distinct(), L, "left_anti"), "no_poles").union(first(A.unpowered(lit, poles), "unpowered"))


def pole_islands(entities: DataFrame, reach: float = 30.0) -> DataFrame:
    """Layouts whose poles wires can't join; the smallest island's first pole is named."""
    # poles on one tile are always joined: the first stands for them, with the longest wire
    poles = _poles(entities).groupBy(L, "px", "py").agg(F.min("idx").alias("idx"), F.max("wire").alias("wire"), F.count("*").alias("n"))
    near = A.near_pairs(poles.select(L, "idx", F.col("px").alias("x"), F.col("py").alias("y")), reach)
    side = lambda x: poles.select(L, F.col("idx").alias(x), F.col("px").alias(f"x_{x}"), F.col("py").alias(f"y_{x}"), F.col("wire").alias(f"w_{x}"))
    joined = near.join(side("a"), [L, "a"]).join(side("b"), [L, "b"])
    edges = joined.filter(F.sqrt(F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2)) <= F.least("w_a", "w_b") + 1e-9).select(L, "a", "b")
    found = graphs.components(poles.select(L, F.col("idx").alias("node")), edges, [L])
    islands = found.join(poles.select(L, F.col("idx").alias("node"), "n"), [L, "node"]).groupBy(L, "root").agg(F.sum("n").alias("size"))
    worst = islands.groupBy(L).agg(F.count("*").alias("n"), F.min(F.struct("size", "root")).alias("s")).filter("n > 1").select(L, F.col("s.root").alias("idx"))
    return _issue(worst.join(entities, [L, "idx"]), "warning", "pole_islands")


def issues(entities: DataFrame) -> DataFrame:
    """All issues of all layouts. A layout with an entity that can't be used is unparseable and has no other issue; entities off the grid are an error of
    their layout and count in the rest on the tile that they snap to."""
    entities = graphs.cut(entities)  # read by all checks, parsed once
    broken = entities.filter(F.col("reject").isNotNull() & (F.col("reject") != "off_grid")).groupBy(L).agg(F.min("idx").alias("idx"))
    whole = entities.join(broken.select(L), L, "left_anti")
    off = whole.filter("reject = 'off_grid'").groupBy(L).agg(F.min("idx").alias("idx"))
    layout_issue = lambda rows, category: _issue(rows.withColumns({"x": F.lit(0), "y": F.lit(0)}), "error", category)
    good = whole.drop("reject")
    found = [layout_issue(broken, "unparseable"), layout_issue(off, "off_grid"), collisions(good), belts(good), lone_undergrounds(good), inserters(good), power(good), pole_islands(good)]
    return reduce(DataFrame.union, found)


def category_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(L, "severity", "category").agg(F.count("*").alias("n"))


def feedback(found: DataFrame, most: int = 10, warnings: bool = False) -> DataFrame:
    """layout_id, text: the first issues of a layout as lines, errors first, and how many more there are."""
    kept = found if warnings else found.filter("severity = 'error'")
    line = F.concat(F.lit("- ["), "category", F.lit("] at "), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"))
    w = Window.partitionBy(L).orderBy(F.col("severity") != "error", "category", "idx", "x", "y")
    rows = kept.withColumns({"n": F.row_number().over(w), "of": F.count("*").over(Window.partitionBy(L))})
    first = rows.filter(F.col("n") <= most).groupBy(L).agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"), F.max("of").alias("of"))
    more = F.when(F.col("of") > most, F.array(F.concat(F.lit("- ... and "), (F.col("of") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return first.select(L, F.array_join(F.concat(F.transform("lines", lambda x: x["line"]), more), "\n").alias("text"))

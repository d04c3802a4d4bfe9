"""Queries of the layout operators on layouts derived from lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators import graphs as G
from plotweave.operators import layouts as A
from plotweave.session import table

L = "layout_id"


def entities(spark: SparkSession, sf: str, layouts: int = 400) -> DataFrame:
    """Layouts derived from lineitem: places from part and supplier, direction from the line, kind from the flags."""
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") % layouts).alias(L), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), F.concat("l_returnflag", "l_linestatus").alias("name"),
        (F.col("l_partkey") % 24).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y"), (4 * (F.col("l_linenumber") % 4)).cast("int").alias("direction"),
    ).withColumns({"w": F.when(F.col("name").startswith("N"), 2).otherwise(1), "h": F.when(F.col("name").startswith("N"), 2).otherwise(1)})


def tile_collisions(spark, sf):
    return A.collisions(entities(spark, sf)).groupBy(L).agg(F.count("*").alias("pairs"), F.min("owner").alias("first_owner"))


def front_tile_lookup(spark, sf):
    return A.front(entities(spark, sf)).groupBy(L).agg(F.count("target").alias("fed"), F.count_if(F.col("target").isNull()).alias("ends"), F.sum("target").alias("targets"))


def pickup_targets(spark, sf):
    ents = entities(spark, sf)
    dx, dy = A.vector(F.col("direction"))
    picked = A.lookup(ents.filter("name = 'AF'"), F.col("x") + dx, F.col("y") + dy, "source", among=ents)
    return A.lookup(picked, F.col("x") - dx, F.col("y") - dy, "sink", among=ents).select(L, "idx", "source", "sink")


def asof_with_blocking(spark, sf):
    ents = entities(spark, sf).filter("name in ('RF', 'AF')")
    return A.undergrounds(ents, F.lit(5), (F.col("x") + F.col("y")) % 2 == 1)


def power_coverage_anti(spark, sf):
    ents = entities(spark, sf)
    poles = ents.filter("name = 'AF'").select(L, (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"), F.lit(2.5).alias("half"))
    return A.unpowered(ents.filter("name like 'N%'"), poles).select(L, "idx")


def band_proximity_join(spark, sf):
    ents = entities(spark, sf).filter("name = 'RF'")
    return A.near_counts(ents, 3, square=True)


def straight_runs(spark, sf):
    return A.straight_runs(entities(spark, sf))


def span_clusters(spark, sf):
    ents = entities(spark, sf)
    spans = ents.select(L, F.col("y").alias("line"), F.col("x").alias("low"), (F.col("x") + F.col("idx") % 4).alias("high"))
    return A.span_clusters(spans, [L, "line"])


def normalized_layouts(spark, sf):
    n = A.normalized(entities(spark, sf).withColumns({"x": F.col("x") - 7, "y": F.col("y") + 3}))
    return n.groupBy(L).agg(F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.max("idx").alias("last"), F.sum(F.col("x") * 31 + F.col("y")).alias("checksum"))


def rotated_layouts(spark, sf):
    r = A.rotated(entities(spark, sf), 1)
    return r.groupBy(L).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("direction").alias("sd"))


def layout_facts(spark, sf):
    return A.facts(entities(spark, sf))


def area_share(spark, sf):
    return A.area_share(entities(spark, sf), F.col("name").startswith("N")).withColumn("share", F.round("share", 6))


def layout_density(spark, sf):
    return A.extent(entities(spark, sf)).withColumn("density", F.round("density", 6))


def build_copies(spark, sf):
    return A.copies(entities(spark, sf), 3, 6).groupBy(L, "k").agg(F.count("*").alias("n"), F.max("x").alias("right"))


def pole_components(spark, sf):
    poles = entities(spark, sf).filter("name = 'AF'")
    return A.near_components(poles, 4.0).groupBy(L).agg(F.count_distinct("root").alias("components"), F.sum("root").alias("roots"))


def lane_reachability(spark, sf):
    ents = entities(spark, sf)
    edges = G.cut(A.front(ents).filter("target is not null").select(L, F.col("idx").alias("src"), F.col("target").alias("dst")))  # read in each round
    starts = ents.filter("idx % 50 = 1").select(L, F.col("idx").alias("node"))
    return G.reachable(starts, edges, [L]).groupBy(L).agg(F.count("*").alias("reached"), F.sum("node").alias("nodes"))


def item_fixpoint(spark, sf):
    ents = entities(spark, sf)
    rule = F.when(F.col("idx") % 10 == 0, "only").when(F.col("idx") % 10 == 5, "except")
    edges = G.cut(A.front(ents).filter("target is not null").select(L, F.col("idx").alias("src"), F.col("target").alias("dst"), rule.alias("rule"), F.lit("i1").alias("rule_item")))
    facts = ents.filter("idx % 7 = 1").select(L, F.col("idx").alias("node"), F.concat(F.lit("i"), (F.col("idx") % 3).cast("string")).alias("item"))
    return G.spread(facts, edges, [L]).groupBy(L, "item").agg(F.count("*").alias("n"), F.sum("node").alias("nodes"))


NAMES = (
    "tile_collisions front_tile_lookup pickup_targets asof_with_blocking power_coverage_anti band_proximity_join straight_runs span_clusters normalized_layouts rotated_layouts layout_facts area_share"
    " layout_density build_copies pole_components lane_reachability item_fixpoint"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
_E = """WITH RECURSIVE e AS (SELECT l_orderkey % 400 AS layout_id, l_orderkey * 8 + l_linenumber AS idx, l_returnflag || l_linestatus AS name, CAST(l_partkey % 24 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y,
CAST(4 * (l_linenumber % 4) AS INT) AS direction, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS w, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS h FROM lineitem),
d AS (SELECT *, CASE direction WHEN 4 THEN 1 WHEN 12 THEN -1 ELSE 0 END AS dx, CASE direction WHEN 8 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS dy FROM e),
t AS (SELECT layout_id, idx, x + i AS tx, y + j AS ty FROM e, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE i < w AND j < h),
o AS (SELECT layout_id, tx, ty, min(idx) AS owner FROM t GROUP BY 1, 2, 3),
f AS (SELECT d.*, o.owner AS target FROM d LEFT JOIN o ON d.layout_id = o.layout_id AND d.x + d.dx = o.tx AND d.y + d.dy = o.ty)"""
_POLES = "p AS (SELECT * FROM e WHERE name = 'AF'), g AS (SELECT a.layout_id, a.idx AS a, b.idx AS b FROM p a JOIN p b ON a.layout_id = b.layout_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 16)"
ORACLES = {
    "tile_collisions": f"{_E} SELECT layout_id, count(*) AS pairs, min(owner) AS first_owner FROM (SELECT DISTINCT t.layout_id, owner, idx FROM t JOIN o USING (layout_id, tx, ty) WHERE owner < idx) GROUP BY 1",
    "front_tile_lookup": f"{_E} SELECT layout_id, count(target) AS fed, count(*) FILTER (target IS NULL) AS ends, CAST(sum(target) AS BIGINT) AS targets FROM f GROUP BY 1",
    "pickup_targets": f"""{_E.replace("WITH RECURSIVE", "WITH", 1).replace("o AS (", "o AS MATERIALIZED (", 1)}, h AS MATERIALIZED (SELECT layout_id, idx, x + dx AS px, y + dy AS py, x - dx AS qx, y - dy AS qy FROM d WHERE name = 'AF')
SELECT h.layout_id, h.idx, a.owner AS source, b.owner AS sink FROM h LEFT JOIN o a ON h.layout_id = a.layout_id AND h.px = a.tx AND h.py = a.ty LEFT JOIN o b ON h.layout_id = b.layout_id AND h.qx = b.tx AND h.qy = b.ty""",
    "asof_with_blocking": f"""{_E}, u AS (SELECT *, direction % 8 = 0 AS v, CASE WHEN direction % 8 = 0 THEN x ELSE y END AS line, CASE WHEN direction % 8 = 0 THEN y ELSE x END AS pos, (x + y) % 2 = 1 AS isout FROM d WHERE name IN ('RF', 'AF')),
n AS (SELECT *, CASE WHEN dx + dy > 0 THEN lead(idx) OVER q ELSE lag(idx) OVER q END AS ni, CASE WHEN dx + dy > 0 THEN lead(pos) OVER q ELSE lag(pos) OVER q END AS na,
 CASE WHEN dx + dy > 0 THEN lead(direction) OVER q ELSE lag(direction) OVER q END AS nd, CASE WHEN dx + dy > 0 THEN lead(isout) OVER q ELSE lag(isout) OVER q END AS no FROM u WINDOW q AS (PARTITION BY layout_id, name, v, line ORDER BY pos, idx))
SELECT layout_id, idx AS entrance, ni AS exit, abs(na - pos) AS distance FROM n WHERE NOT isout AND no AND nd = direction AND abs(na - pos) <= 5""",
    "power_coverage_anti": f"""{_E}, p AS (SELECT layout_id, x + 0.5 AS px, y + 0.5 AS py FROM e WHERE name = 'AF')
SELECT layout_id, idx FROM e WHERE name LIKE 'N%' AND NOT EXISTS (SELECT 1 FROM p WHERE p.layout_id = e.layout_id AND px - 2.5 < x + w AND px + 2.5 > x AND py - 2.5 < y + h AND py + 2.5 > y)""",
    "band_proximity_join": f"{_E}, r AS (SELECT * FROM e WHERE name = 'RF') SELECT a.layout_id, count(*) AS pairs, max(b.idx) AS largest FROM r a JOIN r b ON a.layout_id = b.layout_id AND a.idx < b.idx AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY 1",
    "straight_runs": f"""{_E}, r AS (SELECT DISTINCT layout_id, name, direction, CASE WHEN direction % 8 = 0 THEN x ELSE y END AS line, CASE WHEN direction % 8 = 0 THEN y ELSE x END AS pos FROM e),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY layout_id, name, direction, line ORDER BY pos) AS k FROM r) SELECT layout_id, name, direction, line, min(pos) AS first, count(*) AS length FROM i GROUP BY layout_id, name, direction, line, k HAVING count(*) >= 3""",
    "span_clusters": f"""{_E}, s AS (SELECT layout_id, y AS line, x AS low, x + idx % 4 AS high FROM e), m AS (SELECT *, max(high) OVER (PARTITION BY layout_id, line ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
c AS (SELECT *, sum(CASE WHEN b IS NULL OR b < low THEN 1 ELSE 0 END) OVER (PARTITION BY layout_id, line ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT layout_id, line, min(low) AS low, max(high) AS high, count(*) AS spans FROM c GROUP BY layout_id, line, k""",
    "normalized_layouts": f"{_E}, m AS (SELECT *, x - min(x) OVER (PARTITION BY layout_id) AS nx, y - min(y) OVER (PARTITION BY layout_id) AS ny FROM e) SELECT layout_id, min(nx) AS min_x, max(ny) AS max_y, CAST(count(*) - 1 AS INT) AS last, CAST(sum(nx * 31 + ny) AS BIGINT) AS checksum FROM m GROUP BY 1",
    "rotated_layouts": f"{_E} SELECT layout_id, CAST(sum(-y - h + 1) AS BIGINT) AS sx, CAST(sum(x) AS BIGINT) AS sy, CAST(sum((direction + 4) % 16) AS BIGINT) AS sd FROM e GROUP BY 1",
    "layout_facts": f"""{_E}, c AS (SELECT layout_id, direction, row_number() OVER (PARTITION BY layout_id ORDER BY count(*) DESC, min(idx)) AS r FROM e GROUP BY 1, 2)
SELECT e.layout_id, count(*) AS total, count(DISTINCT name) AS names, any_value(c.direction) AS main_direction, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM e JOIN c ON e.layout_id = c.layout_id AND r = 1 GROUP BY 1""",
    "area_share": f"{_E} SELECT layout_id, round(sum(CASE WHEN name LIKE 'N%' THEN w * h ELSE 0 END) / sum(w * h), 6) AS share FROM e GROUP BY 1",
    "layout_density": f"{_E}, b AS (SELECT layout_id, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM e GROUP BY 1), c AS (SELECT layout_id, count(*) AS covered FROM o GROUP BY 1) SELECT layout_id, width, height, covered, round(covered / (width * height), 6) AS density FROM b JOIN c USING (layout_id)",
    "build_copies": f"""{_E}, k AS (SELECT layout_id, name, x + k * 6 AS x, y, w, h, direction, min(k) AS k FROM e, (VALUES (0), (1), (2)) v(k) GROUP BY layout_id, name, x + k * 6, y, w, h, direction) SELECT layout_id, k, count(*) AS n, max(x) AS "right" FROM k GROUP BY 1, 2""",
    "pole_components": f"""{_E}, {_POLES}, r AS (SELECT layout_id, a AS node, a AS seen FROM g UNION SELECT r.layout_id, r.node, g.b FROM r JOIN g ON r.layout_id = g.layout_id AND r.seen = g.a),
m AS (SELECT layout_id, node, min(seen) AS root FROM r GROUP BY 1, 2) SELECT layout_id, count(DISTINCT root) AS components, CAST(sum(root) AS BIGINT) AS roots FROM m GROUP BY 1""",
    "lane_reachability": f"{_E}, r AS (SELECT layout_id, idx FROM e WHERE idx % 50 = 1 UNION SELECT f.layout_id, f.target FROM r JOIN f USING (layout_id, idx) WHERE f.target IS NOT NULL) SELECT layout_id, count(*) AS reached, CAST(sum(idx) AS BIGINT) AS nodes FROM r GROUP BY 1",
    "item_fixpoint": f"""{_E}, r AS (SELECT layout_id, idx, 'i' || (idx % 3) AS item FROM e WHERE idx % 7 = 1 UNION SELECT f.layout_id, f.target, r.item FROM r JOIN f USING (layout_id, idx)
WHERE f.target IS NOT NULL AND (f.idx % 10 NOT IN (0, 5) OR (f.idx % 10 = 0) = (item = 'i1'))) SELECT layout_id, item, count(*) AS n, CAST(sum(idx) AS BIGINT) AS nodes FROM r GROUP BY 1, 2""",
}

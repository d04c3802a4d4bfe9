import inspect
import json

import pytest

from plotweave.operators import generators, graphs, validator
from plotweave.operators import layouts as A
from plotweave.sources import layout_strings as S


def entity(name, x, y, direction=0, size=(1, 1), **more):
    return {"name": name, "position": {"x": x + size[0] / 2, "y": y + size[1] / 2}, "direction": direction, **more}


def encoded(entities, version=2 << 48):
    return S.encode_one(json.dumps({"blueprint": {"entities": entities, "version": version}}))


def parsed(spark, *layouts):
    rows = spark.createDataFrame([(i, encoded(e)) for i, e in enumerate(layouts)], "key int, text string")
    return S.entities(S.layouts(rows, "key", "text"), "key")


BELTS = [entity("transport-belt", x, 0, 4) for x in range(3)]
MACHINE = entity("assembling-machine-1", 0, 2, size=(3, 3))
POLE = entity("small-electric-pole", 2, 1)


def test_round_trip_and_bad_strings(spark):
    text = S.encode_one('{"blueprint": {"entities": []}}')
    assert S.unpacked(text) == ({"blueprint": {"entities": []}}, None)
    assert [S.unpacked(x)[1] for x in (None, "", "1abc", "0!!!!", "0" + "A" * (S.MAX_CHARS + 1))] == ["empty or too long", "empty or too long", "unsupported version byte", "not decodable", "empty or too long"]
    bomb = S.encode_one(" " * (S.MAX_BYTES + 1))
    assert S.unpacked(bomb)[1] == "too large when decoded"


def test_nested_collections(spark):
    one = {"blueprint": {"entities": [], "version": 1 << 48}}
    book = {"blueprint_book": {"version": 3 << 48, "blueprints": [{**one, "index": 8}, {"index": 2, "blueprint_book": {"blueprints": [{"blueprint": {}}]}}, 5]}}
    assert [(p, v >> 48) for p, v, _ in S.collected(book)] == [("8", 1), ("2/0", 3)]
    found = S.layouts(spark.createDataFrame([(1, S.encode_one(json.dumps(book))), (2, "junk")], "k int, t string"), "k", "t").collect()
    assert sorted((r.k, r.pos, r.path, r.error is None) for r in found) == [(1, 0, "8", True), (1, 1, "2/0", True), (2, 0, "", False)]


def test_the_first_children_are_kept(spark):
    """Places count as numbers: the eleventh child comes after the third."""
    book = {"blueprint_book": {"blueprints": [{"blueprint": {"label": str(i)}} for i in range(60)]}}
    rows = spark.createDataFrame([(k, f, S.encode_one(json.dumps(book))) for k, f in ((1, 5), (2, 10), (3, 100))], "k int, favorites int, t string")
    found = S.capped(S.layouts(rows, "k", "t").join(rows.select("k", "favorites"), "k"), "k", "favorites")
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append(int(r.path))
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(25)), 2: list(range(50)), 3: list(range(60))}
    alone = S.single(S.layouts(rows.limit(1).union(spark.createDataFrame([(9, 1, encoded([]))], rows.schema)), "k", "t"), "k")
    assert {(r.k, r.error) for r in alone.collect()} == {(1, "a collection"), (9, None)}


def test_entities_and_rejects(spark):
    old = spark.createDataFrame([(1, encoded([entity("filter-inserter", 1, 2, 2)], 1 << 48))], "key int, text string")
    assert [(r.name, r.direction, r.reject) for r in S.entities(S.layouts(old, "key", "text"), "key").collect()] == [("fast-inserter", 4, None)]
    got = {r.idx: r for r in parsed(spark, [entity("fast-inserter", 1, 2, 4), entity("nothing", 0, 0), {"name": "pipe", "position": {"x": 0.2, "y": 0.5}}, entity("splitter", 3, 4, 4, size=(1, 2))]).collect()}
    assert (got[0].name, got[0].x, got[0].y, got[0].reject) == ("fast-inserter", 1, 2, None)
    assert (got[1].reject, got[2].reject) == ("unknown entity", "off_grid")
    assert (got[3].w, got[3].h, got[3].x, got[3].y) == (1, 2, 3, 4)


ISSUES = [
    ([*BELTS, entity("inserter", 1, 1), MACHINE, POLE], []),
    ([*BELTS, entity("stone-furnace", 1, 0, size=(2, 2))], ["collision", "collision"]),
    ([entity("transport-belt", 0, 0, 4), entity("transport-belt", 1, 0, 12)], ["belt_head_on", "belt_head_on"]),
    ([entity("underground-belt", 0, 0, 4, type="input")], ["lone_underground"]),
    ([entity("underground-belt", 0, 0, 4, type="input"), entity("underground-belt", 5, 0, 4, type="output")], []),
    ([entity("underground-belt", 0, 0, 4, type="input"), entity("underground-belt", 6, 0, 4, type="output")], ["lone_underground", "lone_underground"]),
    ([*BELTS, entity("inserter", 1, 1), MACHINE], ["no_poles"]),
    ([*BELTS, entity("inserter", 1, 1), MACHINE, entity("small-electric-pole", 9, 9)], ["belt_end", "unpowered"]),
    ([entity("small-electric-pole", 0, 0), entity("small-electric-pole", 20, 0)], ["pole_islands"]),
    ([entity("burner-inserter", 0, 1), entity("stone-wall", 0, 0), entity("iron-chest", 0, 2)], ["inserter_target"]),
    ([entity("underground-belt", 0, 0, 4, type="input"), entity("underground-belt", 1, 0, 4, type="input"), entity("underground-belt", 2, 0, 4, type="output"), entity("underground-belt", 3, 0, 4, type="output")], []),
    ([entity("offshore-pump", 0, 1, 0, size=(1, 2)), entity("pipe", 0, 0)], ["collision"]),
    ([entity("pipe", 0, 0), {"name": "pipe", "position": {"x": 3.2, "y": 0.5}}, {"name": "pipe", "position": {"x": 0.6, "y": 0.4}}], ["collision", "off_grid"]),
    ([entity("pipe", 0, 0), entity("pipe", 0, 0), entity("nothing", 3, 3)], ["unparseable"]),
    ([], []),
]


def test_issues(spark):
    """All layouts are judged together; each has its own issues only."""
    got = {f"{k}#": [] for k in range(len(ISSUES))}
    for r in validator.issues(parsed(spark, *(e for e, _ in ISSUES))).collect():
        got[r.layout_id].append(r.category)
    assert [sorted(v) for v in got.values()] == [want for _, want in ISSUES]


def test_four_turns_are_none(spark):
    ents = parsed(spark, [*BELTS, MACHINE, entity("splitter", 5, 5, 4, size=(1, 2))])
    key = lambda df: sorted((r.name, r.x, r.y, r.w, r.h, r.direction) for r in df.collect())
    assert key(A.rotated(ents, 4)) == key(ents) and key(A.rotated(A.rotated(ents, 1), 3)) == key(ents)
    assert key(A.normalized(A.normalized(ents))) == key(A.normalized(ents))
    moved = ents.withColumn("x", ents.x + 9)
    assert A.signature(ents).first().signature == A.signature(moved).first().signature


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 9, 8), (2, 1, 2)], "l int, a int, b int")
    nodes = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 8, 9)] + [(2, 1), (2, 2)], "l int, node int")
    got = sorted(tuple(r) for r in graphs.components(nodes, edges, ["l"]).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 7, 7), (1, 8, 8), (1, 9, 8), (2, 1, 1), (2, 2, 1)]
    lanes = spark.createDataFrame([(1, 1, 2, None, None), (1, 2, 3, "only", "a"), (1, 2, 4, "except", "a"), (1, 3, 1, None, None)], "l int, src int, dst int, rule string, rule_item string")
    facts = spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "l int, node int, item string")
    got = sorted((r.node, r.item) for r in graphs.spread(facts, lanes, ["l"]).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "b")]
    ring = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (1, 4, 5)], "l int, a int, b int")
    assert graphs.pruned(ring, spark.createDataFrame([], "l int, node int"), ["l"]).count() == 3


def test_generators(spark):
    rows = generators.machine_rows(spark, "assembling-machine-1", 3, 5)
    assert rows.filter("name = 'assembling-machine-1'").count() == 5
    cells = generators.solar_cells(spark, 10)
    assert {r.name: r["count"] for r in cells.groupBy("name").count().collect()} == {"solar-panel": 10, "accumulator": 8}
    assert cells.select("x", "y", "name").distinct().count() == 18


def test_ingest_reasons(spark):
    good = encoded([entity("pipe", 0, 0)])
    rows = [("a", 9, [], good), ("b", 2, [], good), ("c", 9, ["/mods/modded/"], good), ("Rare thing", 9, [], good), ("e", 9, ["/version/0,15/"], good), ("f", 9, [], "0x"), ("g", 9, [], None), ("h", 9, [], encoded([]))]
    got = [r.reason for r in S.ingest_reason(spark.createDataFrame(rows, "title string, favorites int, tags array<string>, blueprint_string string")).collect()]
    assert got == ["ok", "low favorites", "modded", "expansion", "old version", "not decodable or a collection", "no string", "empty"]


def test_graphs_run_to_the_end(spark):
    lanes = spark.range(6).selectExpr("1 AS l", "cast(id AS int) AS src", "cast(id + 1 AS int) AS dst", "cast(null AS string) AS rule", "cast(null AS string) AS rule_item").coalesce(1)
    start, none = spark.createDataFrame([(1, 0)], "l int, node int").coalesce(1), spark.createDataFrame([], "l int, node int")
    facts, ends = start.selectExpr("*", "'a' AS item"), lanes.selectExpr("l", "src AS a", "dst AS b")
    assert graphs.spread(facts, lanes, ["l"]).count() == 7
    # a part is never returned as the whole: no limit unless one is given, and an error beyond it
    runs = {graphs.reachable: (start, lanes), graphs.spread: (facts, lanes), graphs.pruned: (ends, none), graphs.components: (lanes.selectExpr("l", "src AS node"), ends)}
    for run, tables in runs.items():
        assert inspect.signature(run).parameters["rounds"].default is None
        with pytest.raises(RuntimeError):
            run(*tables, ["l"], rounds=1)

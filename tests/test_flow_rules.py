"""The rules of the flow on small layouts, simulated and judged together."""

import json

import pytest

from plotweave.operators import flow, graphs
from plotweave.sources import layout_strings as S
from tests.test_layouts import entity

RECIPES = [("gear", "in", "plate"), ("gear", "out", "gear")]
ROLES = [("stone-furnace", "smelt", "ore", "plate"), ("stone-furnace", "fuel", "coal", None), ("lab", "pack", "red", None), ("lab", "pack", "green", None), ("gun-turret", "ammo", "rounds", None)]


def line(x, y, n, direction=4):
    dx, dy = {4: (1, 0), 8: (0, 1), 12: (-1, 0), 0: (0, -1)}[direction]
    return [entity("transport-belt", x + k * dx, y + k * dy, direction) for k in range(n)]


def hand(x, y, direction=0, **more):
    return entity("inserter", x, y, direction, **more)


MACHINE = entity("assembling-machine-1", 0, 2, size=(3, 3), recipe="gear")
CASES = {
    # idx 0: belt, 1: splitter over y 0 and 1, 2: left (north) output, 3: right output
    "splitter": ([*line(0, 0, 1), entity("splitter", 1, 0, 4, size=(1, 2), filter="stone", output_priority="left"), *line(2, 0, 1), *line(2, 1, 1)], [("b:0:0", "stone"), ("b:0:0", "coal"), ("b:0:1", "coal")]),
    # 0: a belt from the north onto an entrance that runs east, 1: entrance, 2: exit
    "under": ([entity("transport-belt", 1, 0, 8), entity("underground-belt", 1, 1, 4, type="input"), entity("underground-belt", 3, 1, 4, type="output")], [("b:0:0", "a"), ("b:0:1", "b")]),
    "right_filter": ([*line(0, 0, 3), MACHINE, hand(1, 1, filters=[{"index": 1, "name": "plate"}], use_filters=True), hand(1, 5), entity("iron-chest", 1, 6)], [("b:0:0", "plate")]),
    "wrong_filter": ([*line(0, 0, 3), MACHINE, hand(1, 1, filters=[{"index": 1, "name": "coal"}], use_filters=True), hand(1, 5), entity("iron-chest", 1, 6)], [("b:0:0", "plate")]),
    "blacklist": ([entity("iron-chest", 0, 0), hand(0, 1, filters=[{"index": 1, "name": "a"}, {"index": 2, "name": "b"}], use_filters=True, filter_mode="blacklist"), entity("iron-chest", 0, 2)], [("i:0", "a"), ("i:0", "b"), ("i:0", "c")]),
    "labs": ([entity("lab", 0, 0, size=(3, 3)), entity("lab", 4, 0, size=(3, 3))], [("i:0", "red"), ("i:0", "green"), ("i:1", "red")]),
    "furnace": ([entity("stone-furnace", 0, 0, size=(2, 2)), hand(0, 2), entity("iron-chest", 0, 3), entity("stone-furnace", 5, 0, size=(2, 2))], [("i:0", "ore"), ("i:0", "coal"), ("i:3", "ore")]),
    "drill": ([entity("electric-mining-drill", 0, 0, 8, size=(3, 3)), *line(0, 3, 3)], []),
    "clog": ([*line(0, 0, 3), MACHINE, hand(1, 1), hand(1, 5), entity("iron-chest", 1, 6)], [("b:0:0", "plate"), ("b:0:0", "stone")]),
    "turrets": ([entity("gun-turret", 0, 0, size=(2, 2)), hand(0, 2), entity("gun-turret", 0, 3, size=(2, 2))], [("i:0", "rounds"), ("i:0", "junk")]),
    # a ring that nothing feeds: its hand is idle, the machine starves
    "ring": ([entity("transport-belt", 0, 0, 4), entity("transport-belt", 1, 0, 8), entity("transport-belt", 1, 1, 12), entity("transport-belt", 0, 1, 0), hand(1, 2), entity("assembling-machine-1", 0, 3, size=(3, 3), recipe="gear")], []),
    "ground": ([hand(0, 0), hand(5, 5), entity("iron-chest", 5, 6), entity("iron-chest", 5, 3)], []),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, S.encode_one(json.dumps({"blueprint": {"entities": e, "version": 2 << 48}}))) for k, (e, _) in CASES.items()]
    ents = graphs.cut(S.entities(S.layouts(spark.createDataFrame(rows, "key string, text string"), "key", "text"), "key"))
    recipes, roles = spark.createDataFrame(RECIPES, "recipe string, side string, item string"), spark.createDataFrame(ROLES, flow.ROLES)
    inputs = spark.createDataFrame([(f"{k}#", n, i) for k, (_, given) in CASES.items() for n, i in given], "layout_id string, node string, item string")
    known = graphs.cut(flow.simulate(ents, recipes, inputs, roles=roles))
    reached, problems = {k: set() for k in CASES}, {k: set() for k in CASES}
    for r in known.collect():
        reached[r.layout_id[:-1]].add((r.node, r.item))
    for r in flow.verdict(ents, recipes, known, roles=roles, inputs=inputs).collect():
        problems[r.layout_id[:-1]].add((r.problem, r.node, r.item))
    ports = {k: set() for k in CASES}
    for r in flow.input_ports(ents).collect():
        ports[r.layout_id[:-1]].add(r.node)
    return reached, problems, ports


def test_belts(judged):
    reached, problems, ports = judged
    got = reached["splitter"]
    assert {("b:2:0", "stone"), ("b:3:0", "coal"), ("b:3:1", "coal")} <= got and ("b:2:0", "coal") not in got and ("b:3:0", "stone") not in got
    assert ports["splitter"] == {"b:0:0", "b:0:1"}  # a splitter's free half is no port where the other is fed
    under = {x for x in reached["under"] if x[0].startswith("b:2")}
    assert len(under) == 1 and under <= {("b:2:0", "a"), ("b:2:0", "b")}  # one lane passes, onto the near one
    assert {("b:1:0", "iron-ore"), ("b:2:0", "iron-ore")} & reached["drill"] or {("b:2:1", "iron-ore")} & reached["drill"]
    assert {p for p in problems["clog"] if p[0] != "lane_mixed"} == {("clog", "b:0", "stone"), ("clog", "b:1", "stone")}  # beyond the hand nothing is taken


def test_hands_and_machines(judged):
    reached, problems, ports = judged
    assert ("i:5", "gear") not in reached["right_filter"] and ("o:3", "gear") in reached["right_filter"] and problems["right_filter"] == set()
    assert {("dangling_inserter", "h:4", None), ("dangling_inserter", "h:5", None), ("starved", "i:3", "plate")} == problems["wrong_filter"]
    assert ("i:2", "c") in reached["blacklist"] and not {("i:2", "a"), ("i:2", "b")} & reached["blacklist"] and ports["blacklist"] == {"i:0"}
    assert problems["labs"] == {("starved", "i:1", "green")}
    assert ("i:2", "plate") in reached["furnace"] and ("starved", "i:3", "any fuel") in problems["furnace"]
    assert ("i:2", "rounds") in reached["turrets"] and ("i:2", "junk") not in reached["turrets"] and problems["turrets"] == set()
    assert {("dangling_inserter", "h:0", None), ("dangling_inserter", "h:1", None)} <= problems["ground"]
    assert problems["ring"] == {("starved", "i:5", "plate")} and ports["ring"] == set()


def test_signs_and_inner_inputs(spark):
    layouts = {
        "sign": [hand(0, 0, filters=[{"index": 1, "name": "plate"}], use_filters=True), *line(0, 1, 2), hand(5, 5, filters=[{"index": 1, "name": "coal"}], use_filters=True), entity("iron-chest", 5, 6)],
        "deep": [*line(6, 6, 2), entity("pipe", 0, 0), entity("pipe", 13, 13), *line(1, 1, 2)],
    }
    rows = [(k, S.encode_one(json.dumps({"blueprint": {"entities": e, "version": 2 << 48}}))) for k, e in layouts.items()]
    ents = graphs.cut(S.entities(S.layouts(spark.createDataFrame(rows, "key string, text string"), "key", "text"), "key"))
    assert [(r.layout_id, r.idx, r["items"]) for r in flow.signs(ents).collect()] == [("sign#", 0, ["plate"])]
    assert sorted((r.layout_id, r.node) for r in flow.inner_inputs(ents).collect()) == [("deep#", "b:0:0"), ("deep#", "b:0:1")]

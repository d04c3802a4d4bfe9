import collections
import math
import random

import numpy as np
import pytest

from plotweave.operators import flow, graphs, sequential
from tests.test_layouts import entity, parsed

RECIPES = [("gear", "in", "plate"), ("gear", "out", "gear"), ("engine", "in", "gear"), ("engine", "in", "pipe"), ("engine", "out", "engine")]


LINE = [
    *[entity("transport-belt", x, 0, 4) for x in range(3)],  # 0 to 2
    entity("assembling-machine-1", 0, 2, size=(3, 3), recipe="gear"),  # 3
    *[entity("transport-belt", x, 6, 4) for x in range(3)],  # 4 to 6
    *[entity("inserter", 1, 1), entity("inserter", 1, 5)],  # take from above, drop below
]
SIDE = [
    *[entity("transport-belt", x, 1, 4) for x in range(3)],  # 0 to 2
    entity("transport-belt", 1, 0, 8),  # 3, from the north onto an eastward belt: its left
    entity("assembling-machine-1", 5, 5, size=(3, 3), recipe="engine"),
]
CURVE = [entity("transport-belt", 0, 0, 4), entity("transport-belt", 1, 0, 8), entity("underground-belt", 1, 1, 8, type="input"), entity("underground-belt", 1, 4, 8, type="output"), entity("transport-belt", 1, 5, 8)]
INPUTS = [("0#", "b:0:0", "plate"), ("0#", "b:0:1", "coal"), ("1#", "b:0:0", "a"), ("1#", "b:3:0", "b"), ("1#", "b:3:1", "c"), ("2#", "b:0:0", "a")]


@pytest.fixture(scope="module")
def flows(spark):
    """What reaches each place, and the problems, of the three layouts."""
    ents = graphs.cut(parsed(spark, LINE, SIDE, CURVE))
    recipes = spark.createDataFrame(RECIPES, "recipe string, side string, item string")
    known = graphs.cut(flow.simulate(ents, recipes, spark.createDataFrame(INPUTS, "layout_id string, node string, item string")))
    reached, problems = {k: set() for k in "012"}, {k: set() for k in "012"}
    for r in known.collect():
        reached[r.layout_id[0]].add((r.node, r.item))
    for r in flow.verdict(ents, recipes, known).collect():
        problems[r.layout_id[0]].add((r.problem, r.node, r.item))
    return reached, problems


def test_one_machine_line(flows):
    known, problems = flows[0]["0"], flows[1]["0"]
    assert {("b:2:0", "plate"), ("b:2:1", "coal"), ("i:3", "plate"), ("o:3", "gear"), ("b:5:1", "gear"), ("b:6:1", "gear")} <= known
    assert ("i:3", "coal") not in known and ("b:4:1", "gear") not in known and not problems


def test_starved_and_side_load(flows):
    problems = flows[1]["1"]
    assert ("starved", "i:4", "gear") in problems and ("starved", "i:4", "pipe") in problems
    assert {p[1] for p in problems if p[0] == "lane_mixed"} == {"b:1", "b:2"}  # a belt is named once


def test_curve_and_underground_keep_lanes(flows):
    known = flows[0]["2"]
    assert {("b:1:0", "a"), ("b:3:0", "a"), ("b:4:0", "a")} <= known and not any(n.endswith(":1") for n, _ in known)


def test_sequential():
    assert sequential.runs_of([1, 3, 5, 7, 9, 20]) == [(1, 2, 5)] and sequential.runs_of([1, 2]) == []
    assert sequential.runs_of([0, 5, 10, 6, 7]) == [(0, 5, 3)]  # of equally long runs the one that begins first
    assert sequential.runs_of([1, 2, 5, 6, 9, 10]) == [(1, 4, 3), (2, 4, 3)]
    poles = np.array([(6.0 * k, 0.0, 7.0) for k in range(4)] + [(100.0, 0.0, 7.0)])
    assert sorted(sequential.tree_of(poles)) == [(0, 1), (1, 2), (2, 3)]
    square = np.array([(0.0, 0.0, 9.0), (3.0, 4.0, 9.0), (5.0, 0.0, 9.0)])  # two wires of length 5: the straight one first
    assert sequential.tree_of(square)[0] == (1, 2) or sequential.tree_of(square) == [(1, 2), (0, 2)]
    star = np.array([(0.0, 0.0, 9.0)] + [(math.cos(k), math.sin(k), 1.0) for k in range(7)])
    degrees = collections.Counter(p for pair in sequential.tree_of(star) for p in pair)
    assert len(sequential.tree_of(star)) == 7 and max(degrees.values()) <= 7


def test_runs_against_every_progression():
    r = random.Random(2)
    for _ in range(200):
        values = sorted(r.sample(range(30), r.randrange(3, 14)))
        left, want = set(values), []
        while True:
            every = []
            for a in left:
                for step in range(1, 30):
                    n = 1
                    while a + n * step in left:
                        n += 1
                    if n >= 3:
                        every.append((-n, a, step))
            if not every:
                break
            n, a, step = min(every)
            want.append((a, step, -n))
            left -= {a + k * step for k in range(-n)}
        assert sequential.runs_of(values) == want


def test_periods(spark):
    """A furnace row of four cells with a head: entities count, not columns; belts don't make cells differ."""
    row = [entity("stone-furnace", 4 * k, 2, size=(2, 2)) for k in range(4)] + [entity("inserter", 4 * k, 1) for k in range(4)] + [entity("inserter", 4 * k, 4) for k in range(4)]
    belts = [entity("transport-belt", x, 0, 4) for x in range(-1, 16)] + [entity("transport-belt", x, 5, 4) for x in range(15)]
    few = [entity("pipe", 2 * k, 0) for k in range(5)]
    got = {r.layout_id: (r.period, r.repeats) for r in sequential.periods(parsed(spark, [*row, *belts], few, [*few, entity("pipe", 40, 0)])).collect()}
    assert got == {"0#": (4, 4), "2#": (2, 5)}


def test_greedy_pairs_and_poles(spark):
    ends = spark.createDataFrame([(1, i, "u", x, 0, 4, io, 5) for i, (x, io) in enumerate([(0, "input"), (1, "input"), (2, "output"), (3, "output"), (9, "input"), (20, "output")])], "layout_id int, idx int, name string, x int, y int, direction int, io_type string, reach int")
    assert sorted((r.entrance, r.exit) for r in sequential.greedy_pairs(ends).collect()) == [(0, 2), (1, 3)]
    poles = spark.createDataFrame([(1, k, 5.0 * k + 0.5, 0.5, 2.5, 7.5) for k in range(5)], "layout_id int, idx int, px double, py double, half double, wire double")
    machine = spark.createDataFrame([(1, 9, 1, 3, 3)], "layout_id int, x int, y int, w int, h int")
    assert sorted(r.idx for r in sequential.covering_poles(poles, machine).collect()) == [2]


def test_grouped(spark):
    df = spark.createDataFrame([(1, v) for v in (0, 2, 4, 6, 6)] + [(2, 5)], "k int, v int")
    assert [tuple(r) for r in sequential.arithmetic_runs(df, ["k"], "v").collect()] == [(1, 0, 2, 4)]

"""Operators on layouts with many points on one place: the same results, without pairs of points."""

import random

from pyspark.sql import functions as F

from plotweave.operators import layouts as A
from plotweave.operators import validator
from plotweave.plans import layout_queries as Q
from tests.test_layouts import BELTS, entity, parsed

SCHEMA = "layout_id int, idx int, x int, y int"


def points(seed, n=70, size=24):
    """Points of three layouts; some idx are on several places, some places have many points, some points have no place."""
    r = random.Random(seed)
    rows = [(k, r.randrange(n), r.randrange(size), r.randrange(size)) for k in range(3) for _ in range(n // 2)]
    return rows + [(0, 500 + k, 30, 30) for k in range(6)] + rows[:9] + [(0, 900, None, 1), (4, 901, 3, None), (5, 7, 1, 1)]


def near(p, q, distance, square):
    dx, dy = abs(p[2] - q[2]), abs(p[3] - q[3])
    return p[0] == q[0] and (max(dx, dy) <= distance if square else dx * dx + dy * dy <= distance * distance)


def components(rows, distance):
    rows = [p for p in rows if None not in p]
    root = {p[:2]: p[1] for p in rows}
    edges = [(p[:2], q[:2]) for p in rows for q in rows if near(p, q, distance, False)]
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return sorted((k, node, r) for (k, node), r in root.items())


def counts(rows, distance, square):
    rows, out = [p for p in rows if None not in p], {}
    for p in rows:
        for q in rows:
            if p[1] < q[1] and near(p, q, distance, square):
                n, largest = out.get(p[0], (0, 0))
                out[p[0]] = n + 1, max(largest, q[1])
    return sorted((k, *v) for k, v in out.items())


def test_components_and_counts_equal_those_of_all_pairs(spark):
    seen = set()
    for seed, distance in ((1, 2.0), (2, 3.0), (3, 4.0), (4, 2.5)):
        rows = points(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = sorted(tuple(r) for r in A.near_components(df, distance).select("layout_id", "node", "root").collect())
        assert got == components(rows, distance)
        seen.add(len({r[::2] for r in got}))
        for square in (False, True):
            assert sorted(tuple(r) for r in A.near_counts(df, distance, square=square).collect()) == counts(rows, distance, square)
    assert min(seen) > 5  # more than one component in a layout


def test_pairs_grow_with_places_only(spark, tmp_path, monkeypatch):
    """Four times as many poles and points on the same places: as many pairs."""
    made, plain = [], A.near_pairs

    def spied(*args, **options):
        made.append((found := plain(*args, **options)).count())
        return found

    monkeypatch.setattr(A, "near_pairs", spied)
    grown = []
    for times in (1, 4):
        li = spark.range(40 * times).select(
            (F.col("id") * 400).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.expr("if(id % 2 = 0, 'A', 'R')").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), (F.col("id") % 8).alias("l_partkey"), (F.col("id") % 4).alias("l_suppkey")
        )
        li.write.parquet(f"{tmp_path}/{times}/lineitem.parquet")
        for query in (Q.pole_components, Q.band_proximity_join):
            assert query(spark, f"{tmp_path}/{times}").count() == 1
        stacked = parsed(spark, [*BELTS, *(entity("small-electric-pole", 2 * k, 5) for k in range(3) for _ in range(times)), entity("small-electric-pole", 60, 60), entity("small-electric-pole", 60, 60)])
        assert [r.idx for r in validator.pole_islands(stacked.drop("reject")).collect()] == [3 + 3 * times]  # two poles there, three or more here
        grown.append(tuple(made))
        made.clear()
    assert grown[0] == grown[1] and len(grown[0]) == 3


def largest_step(df):
    """Most rows that a node of the plan made; runs it."""
    rows = df.collect()

    def made(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return made(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return made(node.plan())
        own, children = node.metrics().get("numOutputRows"), node.children()
        return max([own.get().value() if own.isDefined() else 0, *(made(children.apply(k)) for k in range(children.size()))])

    return rows, made(df._jdf.queryExecution().executedPlan())


def test_coverage_equals_that_of_all_pairs_and_joins_places_only(spark):
    r = random.Random(5)
    spots = [(k, r.randrange(40), r.randrange(40), r.choice((1, 2)), r.choice((1, 2))) for k in range(3) for _ in range(25)]
    # forty consumers and forty poles on each place; one idx has two places, one of them covered, or no place, or two sizes
    machines = [(s[0], 100 * k + j, *s[1:]) for k, s in enumerate(spots) for j in range(40)] + [(0, 9001, 60, 60, 1, 1), (0, 9001, 0, 0, 1, 1), (0, 9002, None, 3, 1, 1), (0, 9003, 2, 0, 1, 1), (0, 9003, 2, 0, 9, 9), (7, 1, 0, 0, 1, 1)]
    places = [(k, r.randrange(40) + 0.5, r.randrange(40) + 0.5, r.choice((2.5, 3.5))) for k in range(3) for _ in range(12)] + [(0, 0.5, 0.5, 0.5), (0, 8.5, 8.5, 0.5)]
    poles = [p for p in places for _ in range(40)]
    covers = lambda m, p: m[0] == p[0] and p[1] - p[3] < m[2] + m[4] and p[1] + p[3] > m[2] and p[2] - p[3] < m[3] + m[5] and p[2] + p[3] > m[3]
    want = [m for m in machines if None in m or not any(covers(m, p) for p in places)]
    df = A.unpowered(spark.createDataFrame(machines, "layout_id int, idx int, x int, y int, w int, h int"), spark.createDataFrame(poles, "layout_id int, px double, py double, half double"))
    got, most = largest_step(df.select("layout_id", "idx", "x", "y", "w", "h"))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and 0 < len(want) < len(machines)
    assert 0 < most <= len(machines)  # the pairs of entities would be 1,600 for each pair of places

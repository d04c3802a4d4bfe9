"""Local image descriptors against plain forms: bands against all Hamming distances, tiles against one piece, edited copies, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from plotweave.llm import images


def waves(n, seed=1):
    return [images.rendered(v) for v in np.random.default_rng(seed).normal(size=(n, 64))]


def table(spark, rows):
    return spark.createDataFrame([(i, None if g is None else bytearray(images.encode(g))) for i, g in rows], "id long, image binary")


def test_matches_are_those_of_all_pairs(spark):
    """200 images and 40 edited queries: the join on bands finds what comparing every pair finds."""
    grey = waves(200)
    queries = [(1000 + k, images.edited(grey[5 * k], k)) for k in range(40)]
    found = {(r.query, r.match): r.pairs for r in images.copies(table(spark, list(enumerate(grey))), table(spark, queries))[0].collect()}
    of = [images.describe(images.decode(images.encode(g))) for g in grey]
    want = {}
    for q, g in queries:
        d = images.describe(images.decode(images.encode(g)))
        for i, o in enumerate(of):
            n = images.agreeing(d, o)
            if n >= images.AGREE:
                want[(q, i)] = n
    assert found == want and {(1000 + k, 5 * k) for k in range(40)} == set(want)


def test_descriptors_within_the_distance_share_a_band():
    r = np.random.default_rng(2)
    for _ in range(500):
        a = r.integers(0, 2**32, 8, dtype=np.uint32)
        b = a.copy()
        for bit in r.choice(256, images.DISTANCE, replace=False):
            b[bit // 32] ^= np.uint32(1 << int(bit % 32))
        assert (a.view(np.uint64) == b.view(np.uint64)).any()  # the bands are pairs of words


def test_tiles_give_the_corners_of_one_piece(monkeypatch):
    grey = np.kron(waves(1, 5)[0], np.ones((2, 3)))
    whole = images.describe(grey)
    monkeypatch.setattr(images, "TILE", 50)
    tiled = images.describe(grey)
    key = lambda rows: sorted((float(x["x"]), float(x["y"]), float(x["scale"])) for x in rows)
    assert key(whole) == key(tiled) and len(whole) > 100
    order = lambda rows: rows[np.lexsort((rows["scale"], rows["y"], rows["x"]))]
    assert np.bitwise_count(order(whole)["bits"] ^ order(tiled)["bits"]).sum() <= 4


def test_a_small_crop_of_a_large_image_is_found(spark):
    parts = waves(24, 7)
    large = np.block([[parts[6 * i + j] for j in range(6)] for i in range(4)])
    crop = large[96:224, 200:328] * 0.9 + 5
    found = images.copies(table(spark, [(1, large), *((k + 2, g) for k, g in enumerate(waves(5, 9)))]), table(spark, [(7, crop)]))[0]
    assert [(r.query, r.match) for r in found.collect()] == [(7, 1)]


def test_edges(spark):
    g = waves(2, 3)
    plain, small, noise = np.full((96, 96), 7.0), g[0][:20, :20], np.zeros((0, 0))
    rows = [(1, g[0]), (2, g[0]), (3, g[1]), (None, g[0]), (4, None), (5, None), (6, plain), (7, small)]
    base = table(spark, rows).withColumn("corners", F.lit("clash")).withColumn("one", F.lit(1))
    base = base.union(base.filter("id = 3"))
    broken = spark.createDataFrame([(8, bytearray(b"P5 9")), (9, bytearray(b""))], "id long, image binary").withColumn("corners", F.lit("x")).withColumn("one", F.lit(2))
    queries = table(spark, [(20, images.edited(g[0], 0)), (40, images.edited(g[0], 0)), (60, plain), (80, None), (None, g[1]), (100, g[1])])
    found, members = images.copies(base.union(broken), queries)
    assert sorted((r.query, r.match) for r in found.collect()) == [(20, 1), (40, 1)]  # 100 is equal to 3, so no copy but its class
    assert sorted((r.id, r.rep) for r in members.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 4)]
    none = base.limit(0)
    assert images.copies(none, queries)[0].count() == 0 and images.copies(base, queries.limit(0))[0].count() == 0 and images.copies(none, queries)[1].count() == 0
    assert len(images.describe(noise)) == 0


def test_every_query_row_is_reported(spark):
    v = np.random.default_rng(4).normal(size=64).tolist()
    rows = [(i, v) for i in range(0, 200, 10)] + [(5, np.random.default_rng(5).normal(size=64).tolist()), (None, v), (7, None), (9, [])]
    got = images.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))).collect()
    assert sorted((r.a, r.b) for r in got if r.kind == "match") == [(i, 0) for i in range(0, 200, 20)]
    assert {(r.a, r.b) for r in got if r.kind == "member"} >= {(i, 0) for i in range(0, 200, 10)} | {(5, 5)}

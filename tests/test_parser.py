"""Settings of raw entities in each of their formats."""

import json

from pyspark.sql import functions as F

from plotweave.sources import entity_settings as E
from plotweave.sources import layout_strings as S
from tests.test_layouts import entity

KNOWN = E.Vocabulary(item=("iron-plate", "copper-plate", "efficiency-module", "speed-module", "stone", "wood"), recipe=("gear",), virtual=("signal-A",), fluid=("water",))


def rows(spark, bodies, version=2 << 48, **options):
    strings = spark.createDataFrame([(i, S.encode_one(json.dumps({"blueprint": {"version": version, **b}}))) for i, b in enumerate(bodies)], "key int, text string")
    return S.entities(S.layouts(strings, "key", "text"), "key", **options)


def every(spark, raws, version=2 << 48, **options):
    """(reject, extras) of each raw entity, parsed together."""
    return [(r.reject, dict(r.extras or {})) for r in sorted(rows(spark, [{"entities": raws}], version, known=KNOWN, **options).collect(), key=lambda r: r.idx)]


def one(spark, raw, version=2 << 48, **options):
    return every(spark, [raw], version, **options)[0]


def test_modules(spark):
    cases = [
        ([{"item": "speed-module", "count": 2}, {"item": "iron-plate", "count": 5}], (None, "speed-module=2")),
        ({"effectivity-module": 1, "speed-module": 1}, (None, "efficiency-module=1;speed-module=1")),
        ([{"id": {"name": "speed-module"}, "items": {"in_inventory": [{"inventory": 4, "stack": 0, "count": 1}, {"inventory": 4, "stack": 1}, {"inventory": 1, "stack": 0}]}}], (None, "speed-module=2")),
        ([{"id": {"name": "speed-module", "quality": "rare"}, "items": {"in_inventory": []}}], ("module quality", None)),
        ({"quality-module": 1}, ("unknown module", None)),
        ({"speed-module": 3}, ("too many modules", None)),
        ({"speed-module": 0}, (None, None)),
        (None, (None, None)),
    ]
    got = every(spark, [entity("assembling-machine-2", 0, 0, size=(3, 3), items=items) for items, _ in cases])
    assert [(reject, extras.get("modules")) for reject, extras in got] == [want for _, want in cases]


def test_requests(spark):
    boxes = {"sections": [{"index": 2, "filters": [{"index": 1, "name": "stone", "count": 3}]}, {"index": 1, "filters": [{"index": 1, "name": "iron-plate", "count": 2}]}, {"index": 3, "active": False, "filters": [{"index": 1, "name": "stone", "count": 9}]}], "trash_not_requested": True}
    cases = [
        ({"request_filters": [{"index": 2, "name": "iron-plate", "count": 5}, {"index": 1, "name": "raw-wood", "count": 1}], "request_from_buffers": True}, (None, {"requests": "wood=1;iron-plate=5", "request_from_buffers": "true"})),
        ({"request_filters": boxes}, (None, {"requests": "iron-plate=2;stone=3", "trash_not_requested": "true"})),
        ({"request_filters": [{"index": 1, "name": "stone"}, {"index": 2, "name": "stone"}]}, ("item requested twice", None)),
        ({"request_filters": [{"index": 1, "name": "unobtainium"}]}, ("unknown requested item", None)),
    ]
    got = every(spark, [*(entity("requester-chest", 0, 0, **more) for more, _ in cases), entity("iron-chest", 0, 0, request_filters=[{"index": 1, "name": "unobtainium"}])])
    assert [(r, None if r else x) for r, x in got] == [*(want for _, want in cases), (None, {})]


def test_filters_recipes_and_signals(spark):
    filters = [{"index": 2, "name": "stone"}, {"index": 1, "name": "iron-plate"}, {"name": "stone"}]
    new = {"sections": {"sections": [{"index": 1, "filters": [{"index": 2, "name": "iron-plate", "count": 4}, {"index": 1, "type": "virtual", "name": "signal-A", "count": 1}]}]}}
    old = {"filters": [{"index": 1, "count": 7, "signal": {"type": "item", "name": "raw-wood"}}]}
    split, make = (lambda **more: entity("splitter", 0, 0, size=(2, 1), **more)), (lambda **more: entity("assembling-machine-1", 0, 0, size=(3, 3), **more))
    hand, label = (lambda **more: entity("inserter", 0, 0, **more)), (lambda behaviour: entity("constant-combinator", 0, 0, control_behavior=behaviour))
    cases = [
        (hand(filters=filters), (None, {})), (hand(filters=filters, use_filters=True, filter_mode="blacklist"), (None, {"filters": "iron-plate;stone", "filter_mode": "blacklist"})),
        (hand(pickup_position=[0, 1]), "own pickup or drop position"), (hand(filters=[{"name": "x"}], use_filters=True), "unknown filter item"),
        (split(filter="stone", output_priority="left", input_priority="none"), (None, {"filter": "stone", "output_priority": "left"})),
        (split(filter={"name": "stone", "quality": "normal"}), (None, {"filter": "stone"})), (split(filter={"quality": "rare", "comparator": "="}), "quality filter"),
        (make(recipe="gear", mirror=True), (None, {"mirror": "true", "recipe": "gear"})), (make(recipe="no such"), "unknown recipe"),
        (label(new), (None, {"signals": "virtual:signal-A=1;item:iron-plate=4"})), (label(old), (None, {"signals": "item:wood=7"})),
        (label({"filters": [{"index": 1, "signal": {"type": "quality", "name": "x"}}]}), "label signal"),
        (entity("display-panel", 0, 0, text=" a\n b ", icon={"name": "stone"}), (None, {"icon": "item:stone", "text": "a b"})),
    ]
    got = every(spark, [raw for raw, _ in cases])
    assert [g if isinstance(want, tuple) else g[0] for g, (_, want) in zip(got, cases, strict=True)] == [want for _, want in cases]


def test_wires_versions_shifts_and_snapping(spark):
    label, lamp = entity("constant-combinator", 0, 0, entity_number=1), entity("pipe", 3, 0, entity_number=2)
    wired, copper = [{"entities": [label, lamp], "wires": [[1, 1, 2, 1]]}, {"entities": [label, lamp], "wires": [[1, 5, 2, 5]]}]
    older = {"entities": [{**label, "connections": {"1": {"green": [{"entity_id": 2}]}}}, lamp]}
    got = [(r.layout_id, r.idx, r.reject) for r in rows(spark, [wired, copper, older]).collect() if r.reject]
    assert sorted(got) == [("0#", 0, "circuit-wired"), ("2#", 0, "circuit-wired")]
    half = [{"name": "pipe", "position": {"x": x + 1.0, "y": 0.5}} for x in range(3)]
    assert [(r.x, r.reject) for r in rows(spark, [{"entities": half}], 17 << 32).orderBy("idx").collect()] == [(0, None), (1, None), (2, None)]
    assert {r.reject for r in rows(spark, [{"entities": half}]).collect()} == {"off_grid"}
    assert {r.reject for r in rows(spark, [{"entities": [*half, entity("pipe", 9, 0)]}], 17 << 32).collect()} == {"off_grid", None}
    assert [r for r, _ in every(spark, [entity("pipe", 0, 0, 3), entity("pipe", 0, 0, quality="rare")])] == ["direction", "quality"]
    assert one(spark, entity("assembling-machine-1", 0, 0, size=(3, 3), recipe="gear"), 1 << 48 | 1 << 32, changed_recipes={"1.1": ("gear",)})[0] == "legacy recipe"
    assert one(spark, entity("pipe", 0, 0), allowed=("lab",))[0] == "not allowed"
    ents = rows(spark, [{"entities": [entity("stone-furnace", 0, 0, 4, size=(2, 2)), entity("inserter", 5, 5, 4)]}]).orderBy("idx").collect()
    assert [r.direction for r in ents] == [0, 4]
    bodies = [{"label": "a\tb", "snap-to-grid": {"x": 4, "y": 6}, "absolute-snapping": True, "position-relative-to-grid": {"x": 1, "y": 2}}, {"snap-to-grid": {"x": 0, "y": 6}}, {}]
    strings = spark.createDataFrame([(i, S.encode_one(json.dumps({"blueprint": {"version": 2 << 48, **b}}))) for i, b in enumerate(bodies)], "key int, text string")
    heads = S.headers(S.layouts(strings, "key", "text"), "key").orderBy("layout_id").collect()
    assert (heads[0].label, tuple(heads[0].snap), heads[0].reject) == ("a b", (4, 6, True, 1, 2), None)
    assert [h.reject for h in heads] == [None, "invalid grid", None] and heads[2].snap is None


def test_buckets(spark):
    names = ["legacy recipe", "request quality or type", "label signal", "not allowed", "unknown entity", "unknown recipe", "circuit-wired", "off_grid", None]
    got = [r.b for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.reject_bucket(F.col("n")).alias("b")).collect()]
    assert got == ["legacy_recipe", "quality", "label_signal", "not_allowed", "unknown_entity", "base_game", "circuit-wired", "other", None]

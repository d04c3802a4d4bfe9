"""The geometry dimension: footprints, kinds and capabilities of entities, as a small table that joins broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Kind, footprint facing north (w, h), electric consumer, item interface, supply half-side, wire reach, underground reach.
_GROUPS = {
    "transport-belt": (("transport-belt", "fast-transport-belt", "express-transport-belt"), 1, 1, False, True),
    "splitter": (("splitter", "fast-splitter", "express-splitter"), 2, 1, False, True),
    "inserter": (("inserter", "long-handed-inserter", "fast-inserter", "bulk-inserter"), 1, 1, True, False),
    "container": (("wooden-chest", "iron-chest", "steel-chest", "passive-provider-chest", "active-provider-chest", "storage-chest", "buffer-chest", "requester-chest"), 1, 1, False, True),
    "furnace": (("stone-furnace", "steel-furnace"), 2, 2, False, True),
    "assembling-machine": (("assembling-machine-1", "assembling-machine-2", "assembling-machine-3", "chemical-plant", "centrifuge"), 3, 3, True, True),
    "wall": (("stone-wall",), 1, 1, False, False),
    "pipe": (("pipe", "pipe-to-ground", "heat-pipe"), 1, 1, False, False),
}
_SINGLES = [
    ("burner-inserter", "inserter", 1, 1, False, True), ("electric-furnace", "furnace", 3, 3, True, True), ("oil-refinery", "assembling-machine", 5, 5, True, True), ("lab", "lab", 3, 3, True, True),
    ("electric-mining-drill", "mining-drill", 3, 3, True, False), ("burner-mining-drill", "mining-drill", 2, 2, False, True), ("beacon", "beacon", 3, 3, True, True), ("boiler", "boiler", 3, 2, False, True),
    ("steam-engine", "generator", 3, 5, False, False), ("solar-panel", "solar-panel", 3, 3, False, False), ("accumulator", "accumulator", 2, 2, False, False), ("pump", "pump", 1, 2, True, False),
    ("small-lamp", "lamp", 1, 1, True, False), ("storage-tank", "storage-tank", 3, 3, False, False), ("radar", "radar", 3, 3, True, False), ("nuclear-reactor", "reactor", 5, 5, False, True),
    ("gun-turret", "ammo-turret", 2, 2, False, True), ("roboport", "roboport", 4, 4, True, True), ("offshore-pump", "offshore-pump", 1, 2, False, False),
    ("constant-combinator", "constant-combinator", 1, 1, False, False), ("display-panel", "display-panel", 1, 1, False, False), ("gate", "gate", 1, 1, False, False), ("land-mine", "land-mine", 1, 1, False, False),
    ("laser-turret", "electric-turret", 2, 2, True, False), ("flamethrower-turret", "fluid-turret", 2, 3, False, False), ("artillery-turret", "artillery-turret", 3, 3, False, True), ("rocket-silo", "rocket-silo", 9, 9, True, True),
    ("pumpjack", "mining-drill", 3, 3, True, False), ("heat-exchanger", "boiler", 3, 2, False, False), ("steam-turbine", "generator", 3, 5, False, False),
]
_POLES = [("small-electric-pole", 1, 2.5, 7.5), ("medium-electric-pole", 1, 3.5, 9.0), ("big-electric-pole", 2, 2.0, 30.0), ("substation", 2, 9.0, 18.0)]
_UNDERGROUND = [("underground-belt", 5), ("fast-underground-belt", 7), ("express-underground-belt", 9)]
SCHEMA = "name string, kind string, w0 int, h0 int, electric boolean, holds_items boolean, supply double, wire double, reach int"


def rows() -> list[tuple]:
    out = [(n, kind, w, h, e, i, None, None, None) for kind, (names, w, h, e, i) in _GROUPS.items() for n in names]
    out += [(n, k, w, h, e, i, None, None, None) for n, k, w, h, e, i in _SINGLES]
    out += [(n, "electric-pole", s, s, False, False, supply, wire, None) for n, s, supply, wire in _POLES]
    out += [(n, "underground-belt", 1, 1, False, True, None, None, r) for n, r in _UNDERGROUND]
    return out


def prototypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)

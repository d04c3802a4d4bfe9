"""Settings of raw entities as validated strings: modules, requests, filters, label signals, snapping, wires.

Raw entities are JSON; each setting has had up to three shapes over the versions. All shapes are read with from_json side by side, so that
parsing stays in the JVM; a shape that doesn't fit is null. Each function gives a struct<value, reject>: reject is the first reason
that the setting can't be used, or null.

Defined cases: an absent or null setting has a null value and no reason; JSON that has none of a setting's shapes counts as absent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that older versions gave to items and signals, and to entities.
ITEM_RENAMES = {
    "used-up-uranium-fuel-cell": "depleted-uranium-fuel-cell", "effectivity-module": "efficiency-module", "effectivity-module-2": "efficiency-module-2",
    "effectivity-module-3": "efficiency-module-3", "empty-barrel": "barrel", "raw-wood": "wood", "science-pack-1": "automation-science-pack",
    "science-pack-2": "logistic-science-pack", "science-pack-3": "chemical-science-pack", "high-tech-science-pack": "utility-science-pack",
}
ENTITY_RENAMES = {
    "stack-inserter": "bulk-inserter", "stack-filter-inserter": "bulk-inserter", "filter-inserter": "fast-inserter", "logistic-chest-active-provider": "active-provider-chest",
    "logistic-chest-passive-provider": "passive-provider-chest", "logistic-chest-storage": "storage-chest", "logistic-chest-buffer": "buffer-chest", "logistic-chest-requester": "requester-chest",
    "straight-rail": "legacy-straight-rail", "curved-rail": "legacy-curved-rail",
}
# The kinds of signals that a label may show, how many, modules, module slots, where an entity keeps its modules, chests with requests.
SIGNAL_KINDS = ("item", "fluid", "virtual", "entity", "recipe")
MAX_SIGNALS = 40
MODULES = tuple(f"{kind}-module{level}" for kind in ("speed", "productivity", "efficiency") for level in ("", "-2", "-3"))
MODULE_SLOTS = {
    "assembling-machine-2": 2, "assembling-machine-3": 4, "beacon": 2, "lab": 2, "electric-furnace": 2, "electric-mining-drill": 3, "chemical-plant": 3, "oil-refinery": 3, "centrifuge": 2, "pumpjack": 2, "rocket-silo": 4,
}
MODULE_INVENTORY = {"lab": 3, "beacon": 1, "electric-mining-drill": 2, "pumpjack": 2}
OTHER_INVENTORY = 4
REQUEST_CHESTS = ("requester-chest", "buffer-chest", "storage-chest")
LABELS = ("constant-combinator", "display-panel")


@dataclass(frozen=True)
class Vocabulary:
    """The names that exist; a kind that is None takes every name."""

    item: tuple[str, ...] | None = None
    fluid: tuple[str, ...] | None = None
    virtual: tuple[str, ...] | None = None
    entity: tuple[str, ...] | None = None
    recipe: tuple[str, ...] | None = None

    def has(self, kind: str, name: Column) -> Column:
        names = getattr(self, kind)
        return F.lit(True) if names is None else F.array_contains(F.split(F.lit("\n".join(names)), "\n"), name)


def lookup(pairs: dict, name: Column) -> Column:
    """The value of a name as a string, or null. The pairs are one literal, however many they are, so that expressions stay small."""
    return F.element_at(F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in pairs.items())), F.lit(";"), F.lit("=")), name)


def renamed(name: Column) -> Column:
    """The current name of an item, signal or entity."""
    return F.coalesce(lookup(ENTITY_RENAMES | ITEM_RENAMES, name), name)


def _setting(value: Column, reject: Column) -> Column:
    return F.struct(F.when(reject.isNull(), value).alias("value"), reject.alias("reject"))


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _reason(*cases: tuple[Column, str]) -> Column:
    out = _nothing()
    for condition, reason in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def _plain(quality: Column) -> Column:
    return quality.isNull() | (quality == "normal")


def _counted(pairs: Column) -> Column:
    """'name=count;...' of structs name, count."""
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["count"].cast("string"))), ";")
    return F.when(F.size(pairs) > 0, text)


def modules(raw: Column, name: Column) -> Column:
    """'name=count;...', sorted. raw: the JSON of items, as a list of {item, count}, a map, or requests with inventories."""
    slots = F.coalesce(lookup(MODULE_SLOTS, name).cast("int"), F.lit(0))
    inventory = F.coalesce(lookup(MODULE_INVENTORY, name).cast("int"), F.lit(OTHER_INVENTORY))
    listed = F.from_json(raw, "array<struct<item:string,count:int,id:struct<name:string,quality:string>,items:struct<in_inventory:array<struct<inventory:int,count:int>>>>>")
    mapped = F.from_json(raw, "map<string,int>")
    in_slots = lambda x: F.aggregate(
        F.filter(F.coalesce(x["items"]["in_inventory"], F.array().cast("array<struct<inventory:int,count:int>>")), lambda s: s["inventory"] == inventory), F.lit(0), lambda a, s: a + F.coalesce(s["count"], F.lit(1))
    )
    of_list = F.transform(listed, lambda x: F.struct(
        renamed(F.coalesce(x["item"], x["id"]["name"])).alias("name"), F.when(x["item"].isNotNull(), F.coalesce(x["count"], F.lit(1))).otherwise(in_slots(x)).alias("count"),
        F.coalesce(x["item"].isNull() & ~_plain(x["id"]["quality"]), F.lit(False)).alias("fine"),
    ))
    of_map = F.transform(F.map_entries(mapped), lambda e: F.struct(renamed(e["key"]).alias("name"), e["value"].alias("count"), F.lit(False).alias("fine")))
    is_list = F.startswith(F.ltrim(raw), F.lit("["))
    pairs = F.filter(F.when(is_list, of_list).otherwise(of_map), lambda p: F.contains(p["name"], F.lit("-module")))
    asked = F.filter(pairs, lambda p: F.coalesce(p["count"], F.lit(0)) != 0)
    names = F.array_sort(F.array_distinct(F.transform(asked, lambda p: p["name"])))
    summed = F.transform(names, lambda n: F.struct(n.alias("name"), F.aggregate(F.filter(asked, lambda p: p["name"] == n), F.lit(0), lambda a, p: a + p["count"]).alias("count")))
    total = F.aggregate(asked, F.lit(0), lambda a, p: a + p["count"])
    known = F.split(F.lit(" ".join(MODULES)), " ")
    reject = _reason((F.exists(pairs, lambda p: p["fine"]), "module quality"), (F.exists(asked, lambda p: ~F.array_contains(known, p["name"])), "unknown module"), (total > slots, "too many modules"))
    return F.when(slots > 0, _setting(_counted(summed), reject)).otherwise(_setting(_nothing(), _nothing()))


_REQUEST = "struct<index:int,name:string,count:int,quality:string,type:string>"


def requests(raw: Column, from_buffers: Column, known: Vocabulary) -> Column:
    """struct<value: struct<requests, request_from_buffers, trash_not_requested>, reject>; requests in the order of sections and slots."""
    listed = F.from_json(raw, f"array<{_REQUEST}>")
    boxed = F.from_json(raw, f"struct<sections:array<struct<index:int,active:boolean,filters:array<{_REQUEST}>>>,request_from_buffers:boolean,trash_not_requested:boolean>")
    is_list = F.startswith(F.ltrim(raw), F.lit("["))
    row = lambda section, f: F.struct(section.alias("section"), F.coalesce(f["index"], F.lit(0)).alias("index"), renamed(f["name"]).alias("name"), F.coalesce(f["count"], F.lit(0)).alias("count"), f["quality"].alias("quality"), f["type"].alias("type"))
    active = F.filter(boxed["sections"], lambda s: F.coalesce(s["active"], F.lit(True)))
    of_boxes = F.flatten(F.transform(active, lambda s: F.transform(F.coalesce(s["filters"], F.array().cast(f"array<{_REQUEST}>")), lambda f: row(F.coalesce(s["index"], F.lit(0)), f))))
    every = F.when(is_list, F.transform(listed, lambda f: row(F.lit(0), f))).otherwise(of_boxes)
    found = F.array_sort(F.filter(every, lambda f: F.coalesce(f["name"], F.lit("")) != ""))
    names = F.transform(found, lambda f: f["name"])
    reject = _reason(
        (F.exists(found, lambda f: ~_plain(f["quality"]) | ~(f["type"].isNull() | (f["type"] == "item"))), "request quality or type"),
        (F.exists(found, lambda f: ~known.has("item", f["name"])), "unknown requested item"), (F.size(F.array_distinct(names)) < F.size(names), "item requested twice"),
    )
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit("true"))
    buffers = F.coalesce(from_buffers, F.lit(False)) | F.coalesce(~is_list & boxed["request_from_buffers"], F.lit(False))
    value = F.struct(_counted(found).alias("requests"), flag(buffers).alias("request_from_buffers"), flag(~is_list & boxed["trash_not_requested"]).alias("trash_not_requested"))
    return _setting(value, reject)


def inserter_filters(raw: Column, raw_name: Column, use_filters: Column, mode: Column, known: Vocabulary) -> Column:
    """struct<value: struct<filters, filter_mode>, reject>: sorted items, where the inserter's filters are on."""
    listed = F.from_json(raw, "array<struct<name:string,quality:string>>")
    on = F.coalesce(use_filters, F.lit(False)) | F.contains(F.coalesce(raw_name, F.lit("")), F.lit("filter"))
    found = F.when(on, F.filter(listed, lambda f: F.coalesce(f["name"], F.lit("")) != ""))
    items = F.array_sort(F.array_distinct(F.transform(found, lambda f: renamed(f["name"]))))
    reject = _reason((F.exists(found, lambda f: ~_plain(f["quality"])), "filter quality"), (F.exists(items, lambda n: ~known.has("item", n)), "unknown filter item"))
    some = F.size(items) > 0
    return _setting(F.when(some, F.struct(F.array_join(items, ";").alias("filters"), F.when(mode == "blacklist", mode).alias("filter_mode"))), reject)


def _signal(kind: Column, name: Column, quality: Column, known: Vocabulary) -> tuple[Column, Column]:
    """'kind:name', and whether it is one that a label may show."""
    kind, name = F.coalesce(kind, F.lit("item")), renamed(F.coalesce(name, F.lit("")))
    exists = F.lit(False)
    for k in SIGNAL_KINDS:
        there = known.has(k, name) | known.has("item", name) if k == "entity" else known.has(k, name)
        exists = exists | ((kind == k) & there)
    return F.concat(kind, F.lit(":"), name), exists & _plain(quality)


def label_signals(raw: Column, known: Vocabulary) -> Column:
    """'kind:name=count;...' of a label's signals, in the order of sections and slots. raw: the JSON of the control behaviour, of either shape."""
    old = F.from_json(raw, "struct<filters:array<struct<index:int,count:int,signal:struct<type:string,name:string,quality:string>>>>")["filters"]
    new = F.from_json(raw, "struct<sections:struct<sections:array<struct<index:int,filters:array<struct<index:int,count:int,type:string,name:string,quality:string>>>>>>")["sections"]["sections"]

    def row(section, f, signal):
        sid, ok = _signal(signal["type"], signal["name"], signal["quality"], known)
        return F.struct(section.alias("section"), F.coalesce(f["index"], F.lit(0)).alias("index"), sid.alias("name"), F.coalesce(f["count"], F.lit(0)).alias("count"), ok.alias("ok"))

    none = F.array().cast("array<struct<section:int,index:int,name:string,count:int,ok:boolean>>")
    named = lambda x: F.coalesce(x["name"], F.lit("")) != ""
    first = F.coalesce(F.transform(F.filter(old, lambda f: named(f["signal"])), lambda f: row(F.lit(0), f, f["signal"])), none)
    second = F.coalesce(F.flatten(F.transform(new, lambda s: F.coalesce(F.transform(F.filter(s["filters"], named), lambda f: row(F.coalesce(s["index"], F.lit(0)), f, f)), none))), none)
    found = F.array_sort(F.concat(first, second))
    return _setting(_counted(found), _reason((F.exists(found, lambda f: ~f["ok"]), "label signal"), (F.size(found) > MAX_SIGNALS, "too many signals")))


def item_filter(raw: Column, known: Vocabulary) -> Column:
    """The item of a splitter's filter: a name, or an object with one."""
    boxed = F.from_json(raw, "struct<name:string,quality:string>")
    is_box = F.startswith(F.ltrim(raw), F.lit("{"))
    name = renamed(F.when(is_box, boxed["name"]).otherwise(raw))
    some = F.coalesce(name, F.lit("")) != ""
    reject = _reason((is_box & (~_plain(boxed["quality"]) | (boxed["name"].isNull() & boxed["quality"].isNotNull())), "quality filter"), (some & ~known.has("item", name), "unknown filter item"))
    return _setting(F.when(some, name), reject)


def clean_label(text: Column, limit: int = 200) -> Column:
    """One line of printable text."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{C}\p{Z}]", " "), " +", " ")), 1, limit)


def snapping(body: Column) -> Column:
    """struct<value: struct<w, h, absolute, dx, dy>, reject> of a layout's JSON; no value without a grid."""
    p = F.from_json(body, "`snap-to-grid` struct<x:int,y:int>, `absolute-snapping` boolean, `position-relative-to-grid` struct<x:int,y:int>")
    grid, absolute = p["snap-to-grid"], F.coalesce(p["absolute-snapping"], F.lit(False))
    w, h = (F.coalesce(grid[c], F.lit(0)) for c in "xy")
    away = lambda c: F.when(absolute, F.coalesce(p["position-relative-to-grid"][c], F.lit(0))).otherwise(0)
    value = F.struct(w.alias("w"), h.alias("h"), absolute.alias("absolute"), away("x").alias("dx"), away("y").alias("dy"))
    return _setting(F.when(grid.isNotNull(), value), _reason((grid.isNotNull() & ((F.least(w, h) < 1) | (F.greatest(w, h) > 10_000)), "invalid grid")))


def circuit_wired(body: Column) -> Column:
    """The distinct entity numbers that a red or green wire touches, in either format; copper wires don't count."""
    wires = F.from_json(body, "wires array<array<int>>")["wires"]
    signal = F.filter(F.coalesce(wires, F.array().cast("array<array<int>>")), lambda w: (F.size(w) == 4) & F.get(w, F.lit(1)).between(1, 4) & F.get(w, F.lit(3)).between(1, 4))
    ends = F.flatten(F.transform(signal, lambda w: F.array(w[0], w[2])))
    old = F.from_json(body, "entities array<struct<entity_number:int,connections:map<string,struct<red:array<string>,green:array<string>>>>>")["entities"]
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    touched = F.filter(F.coalesce(old, F.array().cast("array<struct<entity_number:int,connections:map<string,struct<red:array<string>,green:array<string>>>>>")), lambda e: F.exists(F.map_values(e["connections"]), lambda c: some(c["red"]) | some(c["green"])))
    return F.array_sort(F.array_distinct(F.concat(ends, F.transform(touched, lambda e: e["entity_number"]))))


#: What is read of a raw entity; settings stay JSON until their functions read them.
RAW = (
    "struct<entity_number:int,name:string,direction:int,quality:string,mirror:boolean,recipe:string,type:string,items:string,request_filters:string,request_from_buffers:boolean,"
    "filters:string,use_filters:boolean,filter_mode:string,control_behavior:string,text:string,icon:struct<type:string,name:string,quality:string>,input_priority:string,output_priority:string,filter:string,"
    "pickup_position:string,drop_position:string,position:struct<x:double,y:double>>"
)
#: The settings that are kept, and the characters that their values may have besides letters and digits.
KEYS = ("filter", "filter_mode", "filters", "icon", "input_priority", "io_type", "mirror", "modules", "output_priority", "recipe", "request_from_buffers", "requests", "signals", "text", "trash_not_requested")
LISTS = ("signals", "icon", "modules", "requests", "filters")


def settings(raw: Column, name: Column, kind: Column, known: Vocabulary = Vocabulary()) -> Column:  # noqa: B008
    """struct<extras: map of the settings that an entity has, in the order of their names; reject> of a raw entity (RAW)."""
    hand = kind == "inserter"
    filters = inserter_filters(raw["filters"], raw["name"], raw["use_filters"], raw["filter_mode"], known)
    asked = requests(raw["request_filters"], raw["request_from_buffers"], known)
    held, signals, flt = modules(raw["items"], name), label_signals(raw["control_behavior"], known), item_filter(raw["filter"], known)
    chest, label, panel = name.isin(*REQUEST_CHESTS), name == LABELS[0], name == LABELS[1]
    icon, icon_ok = _signal(raw["icon"]["type"], raw["icon"]["name"], raw["icon"]["quality"], known)
    has_icon = panel & (F.coalesce(raw["icon"]["name"], F.lit("")) != "")
    recipe = F.when((name != "rocket-silo") & (F.coalesce(raw["recipe"], F.lit("")) != ""), raw["recipe"])
    text = clean_label(raw["text"], 80)
    side = lambda c: F.when(c.isin("left", "right"), c)
    value = {
        "filter": flt["value"], "filter_mode": F.when(hand, filters["value"]["filter_mode"]), "filters": F.when(hand, filters["value"]["filters"]), "icon": F.when(has_icon, icon),
        "input_priority": side(raw["input_priority"]), "io_type": F.when(raw["type"] == "output", raw["type"]), "mirror": F.when(raw["mirror"], F.lit("true")), "modules": held["value"],
        "output_priority": side(raw["output_priority"]), "recipe": recipe, "request_from_buffers": F.when(chest, asked["value"]["request_from_buffers"]), "requests": F.when(chest, asked["value"]["requests"]),
        "signals": F.when(label, signals["value"]), "text": F.when(panel & (text != ""), text), "trash_not_requested": F.when(chest, asked["value"]["trash_not_requested"]),
    }
    odd = F.lit(False)
    for k, v in value.items():
        if k != "text":
            odd = odd | F.coalesce(v.rlike(r"[^\p{L}\p{N}\-_:;=]" if k in LISTS else r"[^\p{L}\p{N}\-_]"), F.lit(False))
    reject = F.coalesce(
        _reason((hand & (raw["pickup_position"].isNotNull() | raw["drop_position"].isNotNull()), "own pickup or drop position")), F.when(hand, filters["reject"]), held["reject"],
        F.when(chest, asked["reject"]), F.when(label, signals["reject"]), _reason((has_icon & ~icon_ok, "label signal"), (recipe.isNotNull() & ~known.has("recipe", recipe), "unknown recipe")),
        flt["reject"], _reason((odd, "suspicious value")),
    )
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in value.items())), lambda e: e["value"].isNotNull())
    return F.struct(F.map_from_entries(entries).alias("extras"), reject.alias("reject"))


def extras_key(extras: Column) -> Column:
    """The settings as one string that can be grouped and compared."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(extras)), lambda e: F.concat(e["key"], F.lit("\u0001"), e["value"])), "\u0002")

"""Lifting layouts to forms (belt lines, underground pairs, rows, single entities), their text, and the way back to entities, to verify them.

Entities: layout_id, idx, name, kind, x, y, direction, recipe, io_type, reach. Forms: layout_id, form, name, direction, recipe, io_type, x, y, count, dx, dy, where a pair's dx
and dy lead to its exit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import text as X
from plotweave.operators import graphs, sequential
from plotweave.operators import layouts as A

L = "layout_id"
#: Tiles of a run at least, and forms that a loop is written for.
RUN, LOOP = 3, 3
LABELS = ("constant-combinator", "display-panel")
_COLUMNS = (L, "form", "name", "direction", "recipe", "io_type", "x", "y", "count", "dx", "dy")


def _form(rows: DataFrame, form: str, **values: Column) -> DataFrame:
    defaults = {"count": F.lit(1), "dx": F.lit(0), "dy": F.lit(0), "recipe": F.col("recipe"), "io_type": F.col("io_type")} | values
    return rows.withColumns({"form": F.lit(form), **defaults}).select(*(F.col(c).cast("int") if c in ("x", "y", "count", "dx", "dy", "direction") else F.col(c) for c in _COLUMNS))


def lift(entities: DataFrame) -> DataFrame:
    """The forms of each layout: pairs first, then straight belt lines, then rows of equal entities along x and along y, then what is left, one by one."""
    ents = graphs.cut(entities.select(L, "idx", "name", "kind", "x", "y", "direction", "recipe", "io_type", "reach"))  # read by each kind of form
    free = ents.filter(~F.col("name").isin(*LABELS))
    pairs = graphs.cut(sequential.greedy_pairs(free.filter("kind = 'underground-belt'")))
    to = free.select(L, F.col("idx").alias("exit"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    paired = free.join(pairs.withColumnRenamed("entrance", "idx"), [L, "idx"]).join(to, [L, "exit"])
    out = _form(paired, "pair", dx=F.col("to_x") - F.col("x"), dy=F.col("to_y") - F.col("y"))
    rest = free.join(pairs.select(L, F.col("entrance").alias("idx")).union(pairs.select(L, "exit")), [L, "idx"], "left_anti")
    dx, dy = A.vector(F.col("direction"))
    runs = A.straight_runs(rest.filter("kind = 'transport-belt' and recipe is null"), RUN)
    vertical = F.col("direction") % 8 == 0
    backward = F.col("direction").isin(0, 12)
    begin = F.when(backward, F.col("first") + F.col("length") - 1).otherwise(F.col("first"))
    lines = runs.withColumns({"x": F.when(vertical, F.col("line")).otherwise(begin), "y": F.when(vertical, begin).otherwise(F.col("line")), "recipe": F.lit(None).cast("string"), "io_type": F.lit("input")})
    out = out.union(_form(lines, "belt_line", count=F.col("length"), dx=dx, dy=dy))
    at = F.explode(F.sequence(F.lit(0), F.col("length") - 1))
    on_line = lines.withColumn("k", at).select(L, "name", "direction", (F.col("x") + F.col("k") * dx).alias("x"), (F.col("y") + F.col("k") * dy).alias("y"))
    rest = rest.join(on_line, [L, "name", "direction", "x", "y"], "left_anti")
    keys = [L, "name", "direction", "recipe", "io_type"]
    known = rest.withColumns({"recipe": F.coalesce("recipe", F.lit("")), "io_type": F.coalesce("io_type", F.lit("input"))})
    rows = graphs.cut(sequential.grid_rows(known, keys, RUN)).withColumn("along", F.col("axis") == "x")
    rows = rows.withColumns({"x": F.when(F.col("along"), F.col("first")).otherwise(F.col("line")), "y": F.when(F.col("along"), F.col("line")).otherwise(F.col("first"))})
    step = {"dx": F.when(F.col("along"), F.col("step")).otherwise(0), "dy": F.when(F.col("along"), F.lit(0)).otherwise(F.col("step"))}
    out = out.union(_form(rows, "row", count=F.col("count"), recipe=F.nullif("recipe", F.lit("")), **step))
    in_row = rows.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")))).withColumns({"x": F.col("x") + F.col("k") * step["dx"], "y": F.col("y") + F.col("k") * step["dy"]})
    single = known.join(in_row.select(*keys, "x", "y"), [*keys, "x", "y"], "left_anti").withColumn("recipe", F.nullif("recipe", F.lit("")))
    return out.union(_form(single, "single")).union(_form(ents.filter(F.col("name").isin(*LABELS)), "label"))


def rebuilt(forms: DataFrame) -> DataFrame:
    """layout_id, name, x, y, direction, recipe, io_type of the entities that the forms stand for."""
    k = F.explode(F.sequence(F.lit(0), F.when(F.col("form") == "pair", 1).otherwise(F.col("count") - 1)))
    end = (F.col("form") == "pair") & (F.col("k") == 1)
    return forms.withColumn("k", k).select(
        L, "name", (F.col("x") + F.col("k") * F.col("dx")).alias("x"), (F.col("y") + F.col("k") * F.col("dy")).alias("y"), "direction", "recipe", F.when(end, "output").when(F.col("form") == "pair", "input").otherwise(F.col("io_type")).alias("io_type")
    )


def verified(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """layout_id, status: ok where the forms stand for exactly the layout's entities, else mismatch."""
    columns = [L, "name", "x", "y", "direction", "recipe", "io_type"]
    a = entities.select(L, "name", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("direction").cast("int").alias("direction"), "recipe", F.coalesce("io_type", F.lit("input")).alias("io_type"))
    differ = a.exceptAll(rebuilt(forms).select(columns)).union(rebuilt(forms).select(columns).exceptAll(a)).select(L).distinct().withColumn("differs", F.lit(True))
    return entities.select(L).distinct().join(differ, L, "left").select(L, F.when(F.col("differs"), "mismatch").otherwise("ok").alias("status"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def _tile(x: Column, y: Column) -> Column:
    return F.concat(F.lit("("), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(")"))


def code(forms: DataFrame) -> DataFrame:
    """layout_id, code: a script of the forms, kinds in a fixed order; forms of a kind that differ by place only are written as a loop where there are LOOP or more."""
    order = F.array_position(F.array(*map(F.lit, ("belt_line", "pair", "row", "single", "label"))), F.col("form"))
    compass = _quoted(X.direction_name(F.col("direction")))
    more = F.concat(F.when(F.col("direction") != 0, F.concat(F.lit(", direction="), compass)).otherwise(""), F.when(F.col("recipe").isNotNull(), F.concat(F.lit(", recipe="), _quoted(F.col("recipe")))).otherwise(""))
    loose = F.when(F.col("form").isin("single", "label") & (F.col("io_type") == "output"), F.lit(", io_type='output'")).otherwise("")
    start, end = _tile(F.col("x"), F.col("y")), _tile(F.col("x") + F.col("dx"), F.col("y") + F.col("dy"))
    entry = F.when(F.col("form") == "belt_line", F.concat(F.lit("("), start, F.lit(", "), F.col("count").cast("string"), F.lit(")"))).when(F.col("form") == "pair", F.concat(F.lit("("), start, F.lit(", "), end, F.lit(")"))).otherwise(start)
    names = F.when(F.col("form") == "belt_line", "start, length").when(F.col("form") == "pair", "start, end").otherwise("start")
    steps = F.concat(F.lit(", count="), F.col("count").cast("string"), F.lit(", step="), _tile(F.col("dx"), F.col("dy")))
    call = (
        F.when(F.col("form") == "belt_line", F.concat(F.lit("add_belt_line(bp, start, length, direction="), compass, F.lit(", belt_type="), _quoted(F.col("name")), F.lit(")")))
        .when(F.col("form") == "pair", F.concat(F.lit("add_underground_pair(bp, start, end, direction="), compass, F.lit(", belt_type="), _quoted(F.col("name")), F.lit(")")))
        .when(F.col("form") == "row", F.concat(F.lit("add_entity_row(bp, "), _quoted(F.col("name")), F.lit(", start=start"), steps, more, F.lit(")")))
        .otherwise(F.concat(F.lit("add_entity(bp, "), _quoted(F.col("name")), F.lit(", start"), more, loose, F.lit(")")))
    )
    grouped = forms.select(L, order.alias("o"), call.alias("call"), names.alias("names"), F.struct("y", "x", entry.alias("entry")).alias("e")).groupBy(L, "o", "call", "names").agg(F.array_sort(F.collect_list("e")).alias("es"))
    entries = F.transform("es", lambda e: e["entry"])
    loop = F.concat(F.lit("for "), F.col("names"), F.lit(" in ["), F.array_join(entries, ", "), F.lit("]:\n    "), F.col("call"))
    each = F.array_join(F.transform(entries, lambda e: F.concat(F.col("names"), F.lit(" = "), e, F.lit("\n"), F.col("call"))), "\n")
    text = F.when(F.size("es") >= LOOP, loop).otherwise(each)
    lines = grouped.select(L, F.struct("o", F.col("es")[0]["y"].alias("y"), F.col("es")[0]["x"].alias("x"), "call", text.alias("text")).alias("l")).groupBy(L).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    head = "from draftsman.blueprintable import Blueprint\nfrom draftsman_helpers import add_belt_line, add_entity, add_entity_row, add_underground_pair\n\nbp = Blueprint()\n"
    return lines.select(L, F.concat(F.lit(head), F.array_join(F.transform("ls", lambda x: x["text"]), "\n"), F.lit("\nprint(bp.to_string())\n")).alias("code"))


def numbered(forms: DataFrame) -> DataFrame:
    """Forms in a fixed order within their layout: n."""
    return forms.withColumn("n", F.row_number().over(Window.partitionBy(L).orderBy("form", "y", "x", "name", "direction")))

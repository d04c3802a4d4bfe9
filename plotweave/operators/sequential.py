"""Operators whose steps depend on one another within a layout: grouped maps, a layout (or a line of it) to a task."""

from __future__ import annotations

import bisect
import math
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

L = "layout_id"


def runs_of(values: list[int], least: int = 3) -> list[tuple[int, int, int]]:
    """(first, step, count) of arithmetic progressions that cover the values greedily: the longest first, then the one that begins first, then the smallest step."""
    left, out = sorted(set(values)), []
    while len(left) >= least:
        count: dict[tuple[int, int], int] = {}  # of the run from a value on, by step; filled from the largest value down
        best = (0, 0, 0)
        for i in range(len(left) - 1, -1, -1):
            for b in left[i + 1 :]:
                step = b - left[i]
                n = count[left[i], step] = 1 + count.get((b, step), 1)
                best = max(best, (n, -left[i], -step))
        n, first, step = best[0], -best[1], -best[2]
        if n < least:
            break
        out.append((first, step, n))
        taken = {first + k * step for k in range(n)}
        left = [v for v in left if v not in taken]
    return out


def arithmetic_runs(rows: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """keys, first, step, count of each group's runs."""
    names = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0][keys].tolist()
        return pd.DataFrame([(*head, *r) for r in runs_of(frame[value].tolist(), least)], columns=[*keys, "first", "step", "count"])

    return rows.select(*keys, value).distinct().groupBy(*keys).applyInPandas(work, f"{names}, first long, step long, count long")


def grid_rows(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, axis, line, first, step, count: runs along x in each line of y, then along y of what is left."""
    names = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        head, left, out = frame.iloc[0][keys].tolist(), {(int(x), int(y)) for x, y in zip(frame["x"], frame["y"], strict=True)}, []
        for axis in (0, 1):
            for line in sorted({p[1 - axis] for p in left}):
                for first, step, n in runs_of([p[axis] for p in left if p[1 - axis] == line], least):
                    out.append((*head, "xy"[axis], line, first, step, n))
                    left -= {(first + k * step, line) if axis == 0 else (line, first + k * step) for k in range(n)}
        return pd.DataFrame(out, columns=[*keys, "axis", "line", "first", "step", "count"])

    return rows.select(*keys, "x", "y").distinct().groupBy(*keys).applyInPandas(work, f"{names}, axis string, line long, first long, step long, count long")


def greedy_pairs(ends: DataFrame) -> DataFrame:
    """layout_id, entrance, exit: each entrance (io_type input), in the order of idx, takes the nearest free exit ahead of its name and direction within reach."""
    vertical = F.col("direction") % 8 == 0
    ahead = F.when(F.col("direction").isin(4, 8), 1).otherwise(-1)
    rows = ends.select(L, "name", "direction", F.when(vertical, F.col("x")).otherwise(F.col("y")).alias("line"), (ahead * F.when(vertical, F.col("y")).otherwise(F.col("x"))).alias("pos"), "idx", (F.col("io_type") == "output").alias("out"), F.coalesce("reach", F.lit(5)).alias("reach"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        free = sorted((int(r.pos), int(r.idx)) for r in frame[frame["out"]].itertuples())
        found = []
        for r in frame[~frame["out"]].sort_values("idx").itertuples():
            k = bisect.bisect_right(free, (int(r.pos), 2**62))
            if k < len(free) and free[k][0] - r.pos <= r.reach:
                found.append((frame[L].iloc[0], int(r.idx), free.pop(k)[1]))
        return pd.DataFrame(found, columns=[L, "entrance", "exit"])

    idx = ends.schema["idx"].dataType.simpleString()
    return rows.groupBy(L, "name", "direction", "line").applyInPandas(work, f"{L} {ends.schema[L].dataType.simpleString()}, entrance {idx}, exit {idx}")


#: Entities that a design has at least to be periodic, and the share of them that the repeating part holds.
PERIODIC, COVERAGE = 6, 0.4


def cells_at(keys: np.ndarray, x: np.ndarray, y: np.ndarray, belt: np.ndarray, period: int, offset: int) -> tuple[int, list[int], frozenset]:
    """(entities held, cells, content) of the best run of equal consecutive cells of one grid. Belts don't make cells differ; a cell's own belts are those of an
    inner cell of the run, or with two cells the halves that border one another."""
    cell = (x - offset) // period
    inner = x - offset - cell * period
    fixed: dict[int, set] = {int(m): set() for m in np.unique(cell)}
    belts: dict[int, set] = {}
    for k, m, dx, dy, is_belt in zip(keys.tolist(), cell.tolist(), inner.tolist(), y.tolist(), belt.tolist(), strict=True):
        (belts.setdefault(m, set()) if is_belt else fixed[m]).add((k, dx, dy))
    best = (0, [], frozenset())
    numbered = [(m, frozenset(fixed[m])) for m in sorted(fixed)]
    for (_, content), members in groupby(enumerate(numbered), key=lambda e: (e[1][0] - e[0], e[1][1])):
        run = [m for _, (m, _) in members]
        if not content or len(run) < 2:
            continue
        near = [b for b in belts.get(run[1], ()) if b[1] * 2 < period] + [b for b in belts.get(run[0], ()) if b[1] * 2 >= period]
        options = [(run[:2], content | set(near))] + ([(run, content | belts.get(run[1], set()))] if len(run) > 2 else [])
        for cells, whole in options:
            if len(cells) * len(whole) > best[0]:
                best = (len(cells) * len(whole), cells, frozenset(whole))
    return best


def best_period(frame: pd.DataFrame, coverage: float = COVERAGE) -> tuple[int, int, int, int] | None:
    """(period, start, repeats, entities of a cell): the smallest period whose best grid has two cells or more and holds enough of the entities.

    Of a period's grids the one is taken that holds the most, then the one whose lines cross the fewest footprints, then the first.
    """
    if len(frame) < PERIODIC:
        return None
    x, y, w = (frame[c].to_numpy(dtype=np.int64) for c in ("x", "y", "w"))
    keys, belt = pd.factorize(frame["key"])[0], frame["belt"].to_numpy(dtype=bool)
    low, high = int(x.min()), int((x + w).max())
    for period in range(1, (high - low) // 2 + 1):
        best = None
        for offset in range(low, low + period):
            held, run, content = cells_at(keys, x, y, belt, period, offset)
            crossed = int(((x + w - 1 - offset) // period - (x - offset) // period).sum())
            if held and (best is None or (held, -crossed) > best[:2]):
                best = (held, -crossed, offset + run[0] * period, len(run), len(content))
        if best is not None and best[0] >= coverage * len(frame):
            return period, best[2], best[3], best[4]
    return None


#: Kinds of entities that only decorate.
DECOR = ("lamp", "constant-combinator", "display-panel")


def periods(entities: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """layout_id, period, start, repeats, cell (entities of a cell) along x, of layouts that have a period."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "direction", "recipe", "io_type") if c in entities.columns]
    kind = F.col("kind") if "kind" in entities.columns else F.lit("")
    rows = entities.filter(~F.coalesce(kind.isin(*DECOR), F.lit(False))).select(L, F.concat_ws("|", *parts).alias("key"), "x", "y", (F.col("w") if "w" in entities.columns else F.lit(1)).alias("w"), F.coalesce(kind == "transport-belt", F.lit(False)).alias("belt"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        found = best_period(frame, coverage)
        return pd.DataFrame([(frame[L].iloc[0], *found)] if found else [], columns=[L, "period", "start", "repeats", "cell"])

    return rows.groupBy(L).applyInPandas(work, f"{L} {entities.schema[L].dataType.simpleString()}, period int, start int, repeats int, cell int")


def tree_of(points: np.ndarray, most: int = 5) -> list[tuple[int, int]]:
    """Places (a, b) of the points that are wired: the shortest forest, by distance, straight wires first among equal ones, then by place.

    points: x, y, reach. No point gets more wires than most, unless parts would stay apart. Candidates are swept along x, so only points within reach meet.
    """
    x, y, reach = points[:, 0], points[:, 1], points[:, 2]
    by_x = np.argsort(x, kind="stable")
    until = np.searchsorted(x[by_x], x[by_x] + reach.max(initial=0.0) + 1e-9, side="right")
    wires = []
    for at, end in enumerate(until.tolist()):
        i, others = by_x[at], by_x[at + 1 : end]
        dx, dy = x[others] - x[i], y[others] - y[i]
        apart = np.hypot(dx, dy)
        for j, d, bent in zip(others.tolist(), apart.tolist(), ((dx != 0) & (dy != 0)).tolist(), strict=True):
            if d <= min(reach[i], reach[j]) + 1e-9:
                wires.append((round(d, 6), bent, min(int(i), j), max(int(i), j)))
    part, degree, out = list(range(len(points))), [0] * len(points), []

    def part_of(k: int) -> int:
        while part[k] != k:
            part[k], k = part[part[k]], part[k]
        return k

    for limit in (most, math.inf):
        for _, _, a, b in sorted(wires):
            if max(degree[a], degree[b]) < limit and part_of(a) != part_of(b):
                part[part_of(a)] = part_of(b)
                degree[a], degree[b] = degree[a] + 1, degree[b] + 1
                out.append((a, b))
    return out


def wires(poles: DataFrame, most: int = 5) -> DataFrame:
    """layout_id, a, b: the wires that join each layout's poles (idx, px, py, wire)."""
    kinds = {c: poles.schema[c].dataType.simpleString() for c in (L, "idx")}

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        names = frame["idx"].tolist()
        found = tree_of(frame[["px", "py", "wire"]].to_numpy(dtype=float), most)
        return pd.DataFrame([(frame[L].iloc[0], *sorted((names[a], names[b]))) for a, b in found], columns=[L, "a", "b"])

    return poles.groupBy(L).applyInPandas(work, f"{L} {kinds[L]}, a {kinds['idx']}, b {kinds['idx']}")


def covering_poles(poles: DataFrame, consumers: DataFrame) -> DataFrame:
    """layout_id, idx of the poles that stay: those that cover a consumer, and of the others, the farthest from the consumers first, those without which
    the covering ones would fall into more networks. poles: idx, px, py, half, wire; consumers: x, y, w, h."""
    both = poles.select(L, F.lit(True).alias("pole"), "idx", "px", "py", "half", "wire").unionByName(
        consumers.select(L, F.lit(False).alias("pole"), F.lit(None).cast(poles.schema["idx"].dataType).alias("idx"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"), (F.col("w") / 2).alias("half"), (F.col("h") / 2).alias("wire"))
    )

    def parts(frame: pd.DataFrame, covering: set) -> int:
        """How many networks the covering poles fall into, wired through the given ones."""
        names, label = frame["idx"].tolist(), list(range(len(frame)))
        for i, j in tree_of(frame[["px", "py", "wire"]].to_numpy(dtype=float)) if len(frame) else ():
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
        return len({x for x, name in zip(label, names, strict=True) if name in covering})

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        held, used = frame[frame["pole"]].sort_values("idx"), frame[~frame["pole"]]
        ux, uy, uw, uh = (used[c].to_numpy(dtype=float) for c in ("px", "py", "half", "wire"))
        far, covering = [], set()
        for r in held.itertuples():
            dx, dy = np.abs(ux - r.px), np.abs(uy - r.py)
            if ((dx < uw + r.half) & (dy < uh + r.half)).any():
                covering.add(r.idx)
            else:
                far.append((-(np.hypot(dx, dy).min() if len(dx) else 0.0), r.idx))
        target = parts(held, covering)
        for _, idx in sorted(far):
            without = held[held["idx"] != idx]
            if parts(without, covering) <= target:
                held = without
        return pd.DataFrame({L: held[L], "idx": held["idx"]})

    kinds = {c: poles.schema[c].dataType.simpleString() for c in (L, "idx")}
    return both.groupBy(L).applyInPandas(work, f"{L} {kinds[L]}, idx {kinds['idx']}")

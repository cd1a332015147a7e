"""Outlines of cells as closed rings of corners, in order, holes included.

Every side of a pixel that another label lies behind is a directed edge with the cell on its right; which edge follows
is told by the three pixels around its end. Rings that lie in one tile are ordered by the task that holds it. Edges of the
others find their ring's first edge and their distance from it by pointer doubling over a table, so neither a cell nor an
image has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiled
from .graphs import _cut as _written

#: Neighbours by the bit that stands for them: the four sides in the order of edges (east along the top, south along the right, west, north), then the corners that each edge runs to.
SIDES = [(-1, 0), (0, 1), (1, 0), (0, -1)]
CORNERS = [(-1, 1), (1, 1), (1, -1), (-1, -1)]
STEPS = [(0, 1), (1, 0), (0, -1), (-1, 0)]
#: Largest label and side: an edge's number is (y, x, direction) in one long, labels pass through doubles with eight bits.
MOST_ID, MOST_SIDE = 1 << 44, 1 << 29


def _around(grid: np.ndarray) -> np.ndarray:
    """Label times 256 plus the bits of neighbours with the same label; 0 for background."""
    h, w = grid.shape[-2:]
    wide = np.pad(grid, [(0, 0)] * (grid.ndim - 2) + [(1, 1)] * 2)
    bits = np.zeros(grid.shape)
    for k, (dy, dx) in enumerate(SIDES + CORNERS):
        bits += (wide[..., 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] == grid) * float(1 << k)
    return np.where(grid != 0, grid * 256 + bits, 0.0)


def _edge(y: Column, x: Column, d: int) -> Column:
    return (y.cast("long") * (1 << 31) + x) * 4 + d


def edges(mask: DataFrame, by: Sequence[str] = (), tile: int = 512) -> DataFrame:
    """mask (by..., y, x, cell_id) to (by..., cell_id, edge, next, y, x, direction, turn): each pixel side that borders another label or background.

    y, x: the corner that the edge ends at; turn: the next edge has another direction. Pixels that only touch by a
    corner aren't joined. Background is 0 or missing; labels are from 1 to 2^44, rows and columns below 2^29.
    """
    px = mask.where("cell_id != 0").select(*by, "y", "x", F.col("cell_id").alias("value"))
    found = tiled.per_block(tiled.sized(px, by), lambda g: {"out": _around(g["value"])}, 1, by, {"value": 0.0}, {"out": "long"}, tile, keep="out")
    has = lambda k: F.call_function("getbit", F.col("out"), F.lit(k)) == 1
    each = []
    for d in range(4):
        ahead, corner = has((d + 1) % 4), has(4 + d)  # the pixel before the edge's end on the cell's side, and on the other side
        (sy, sx), (cy, cx) = STEPS[d], CORNERS[d]
        follow = F.when(~ahead, _edge(F.col("y"), F.col("x"), (d + 1) % 4)).when(~corner, _edge(F.col("y") + sy, F.col("x") + sx, d)).otherwise(_edge(F.col("y") + cy, F.col("x") + cx, (d + 3) % 4))
        end = [(0, 1), (1, 1), (1, 0), (0, 0)][d]
        fields = {"edge": _edge(F.col("y"), F.col("x"), d), "next": follow, "y": (F.col("y") + end[0]).cast("int"), "x": (F.col("x") + end[1]).cast("int"), "direction": F.lit(d), "turn": ~ahead | corner}
        each.append(F.when(~has(d), F.struct(*[v.alias(k) for k, v in fields.items()])))
    sides = found.select(*by, F.shiftright("out", 8).alias("cell_id"), F.explode(F.array_compact(F.array(*each))).alias("e"))
    return sides.select(*by, "cell_id", "e.*")


def _twice(links: DataFrame, by: Sequence[str], span: int) -> DataFrame:
    """Each edge's window of span edges joined with the window that follows it."""
    other = links.select(*by, F.col("edge").alias("next"), F.col("next").alias("next2"), F.col("first").alias("first2"), F.col("gap").alias("gap2"))
    near = F.col("first2") < F.col("first")
    return links.join(other, [*by, "next"]).select(*by, "edge", F.col("next2").alias("next"), F.least("first", "first2").alias("first"), F.when(near, F.col("gap2") + span).otherwise(F.col("gap")).alias("gap"))


def rings(sides: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """edges() (written) with ring, the least edge of the closed ring, and place, the edges from that one on.

    Windows double until no edge learns of a smaller one, which is when all know their ring's: as many rounds as the
    logarithm of the longest ring.
    """
    links, span = _written(sides.select(*by, "edge", "next", F.col("edge").alias("first"), F.lit(0).cast("long").alias("gap"))), 1
    while True:
        step = _written(_twice(_twice(links, by, span), by, 2 * span))
        span *= 4
        was = links.select(*by, "edge", F.col("first").alias("was"))
        settled = step.join(was, [*by, "edge"]).where("first != was").isEmpty()
        links = step
        if settled:
            break
    size = links.groupBy(*by, "first").agg(F.count("*").alias("n_edges"))
    placed = links.join(size, [*by, "first"]).select(*by, "edge", F.col("first").alias("ring"), ((F.col("n_edges") - F.col("gap")) % F.col("n_edges")).alias("place"))
    return sides.join(placed, [*by, "edge"])


def _in_partition(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Sides sorted by tile, with ring and place where the whole ring is among the tile's sides, null elsewhere."""
    ids, held = [*by, "ty", "tx"], []

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        """Pointer doubling within whole tiles, several at once."""
        tile = rows.groupby(ids, sort=False, dropna=False).ngroup().to_numpy()
        edge, follow = (rows[c].to_numpy() for c in ("edge", "next"))
        order = np.lexsort((edge, tile))
        # places of (tile, next) among the sorted (tile, edge)
        keys = np.rec.fromarrays([tile[order], edge[order]], names="t,e")
        at = np.searchsorted(keys, np.rec.fromarrays([tile, follow], names="t,e"))
        at[at == len(rows)] = 0
        found = (tile[order][at] == tile) & (edge[order][at] == follow)
        to = np.where(found, order[at], np.arange(len(rows)))
        whole, first, gap, span = found.copy(), np.arange(len(rows)), np.zeros(len(rows), np.int64), 1
        while True:  # as in rings(): windows double until no edge learns of a smaller one
            nearer = edge[first[to]] < edge[first]
            gap, both = np.where(nearer, gap[to] + span, gap), whole & whole[to]
            settled = not nearer.any() and (both == whole).all()
            first, whole, to, span = np.where(nearer, first[to], first), both, to[to], 2 * span
            if settled:
                break
        n = np.bincount(first[whole], minlength=len(rows))[first]
        out = rows.drop(columns=["ty", "tx"])
        out["ring"] = pd.array(np.where(whole, edge[first], 0), "Int64")
        out["place"] = pd.array(np.where(whole, (n - gap) % np.maximum(n, 1), 0), "Int64")
        out.loc[~whole, ["ring", "place"]] = pd.NA
        return out

    for rows in batches:
        if not len(rows):
            continue
        seen = pd.concat([held[-1].iloc[-1:] if held else rows.iloc[:1], rows])[ids]
        was, now = seen.iloc[:-1].reset_index(drop=True), seen.iloc[1:].reset_index(drop=True)
        new = np.flatnonzero(((was != now) & ~(was.isna() & now.isna())).any(axis=1).to_numpy())
        if not len(new):
            held.append(rows)
            continue
        done = pd.concat([*held, rows.iloc[: new[-1]]], ignore_index=True)
        if len(done):
            yield ordered(done)
        held = [rows.iloc[new[-1] :]]
    if held:
        yield ordered(pd.concat(held, ignore_index=True))


def outlines(mask: DataFrame, by: Sequence[str] = (), tile: int = 512) -> DataFrame:
    """rings() of a mask: a row per edge with by..., cell_id, ring, place, y, x, direction, turn. A task holds the sides of a tile."""
    names, fields = [*by, "cell_id", "edge", "next", "y", "x", "direction", "turn"], edges(mask, by, tile)
    sides = fields.select(*names, F.expr(f"shiftright(edge, 33) div {tile}").alias("ty"), F.expr(f"shiftright({(1 << 33) - 1} & edge, 2) div {tile}").alias("tx"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.select(*names).schema)
    ids = [*by, "ty", "tx"]
    found = sides.repartition(*ids).sortWithinPartitions(*ids).mapInPandas(lambda batches: _in_partition(batches, by), f"{kinds}, ring long, place long")
    found = _written(found)
    rest = found.where("ring is null").drop("ring", "place")
    done = found.where("ring is not null")
    return done if rest.isEmpty() else done.unionByName(rings(rest, by))


def corners(outline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The corners of rings: by..., cell_id, ring, place (their order), y, x. Straight runs have none."""
    return outline.where("turn").select(*by, "cell_id", "ring", "place", "y", "x")


def ring_measures(outline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., cell_id, ring, n_edges (the perimeter), n_corners, area (pixels inside; negative for holes) and hole.

    Areas of a cell's rings add up to its pixels.
    """
    back = [(F.col(k) - F.element_at(F.array(*[F.lit(s[i]) for s in STEPS]), F.col("direction") + 1)) for i, k in enumerate("yx")]
    twice = back[1] * F.col("y") - F.col("x") * back[0]
    out = outline.groupBy(*by, "cell_id", "ring").agg(F.count("*").alias("n_edges"), F.count_if("turn").alias("n_corners"), F.sum(twice.cast("long")).alias("twice"))
    return out.select(*by, "cell_id", "ring", "n_edges", "n_corners", F.expr("twice div 2").alias("area"), (F.col("twice") < 0).alias("hole"))


def polygons(outline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., cell_id, ring, hole, points (array of (y, x), in order): a row per ring, which has to fit in one."""
    points = corners(outline, by).groupBy(*by, "cell_id", "ring").agg(F.sort_array(F.collect_list(F.struct("place", "y", "x"))).alias("p"))
    holes = ring_measures(outline, by).select(*by, "ring", "hole")
    return points.join(holes, [*by, "ring"]).select(*by, "cell_id", "ring", "hole", F.transform("p", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))).alias("points"))


def cutting_shapes(shapes: DataFrame, sets: DataFrame, scale: int = 100) -> DataFrame:
    """Outer rings of polygons() (without by) for the cells of sets(name, well, cell_id): Name, CapID, PointCount and Point rows with X and Y.

    Coordinates are multiplied by scale, as cutters read whole numbers. A cell in two sets is cut twice; ids of sets
    without a shape give none.
    """
    point = F.transform("points", lambda p: F.struct((p["x"] * scale).cast("long").alias("X"), (p["y"] * scale).cast("long").alias("Y")))
    outer = shapes.where("not hole").select("cell_id", point.alias("Point"))
    return outer.join(sets.select("name", "well", "cell_id").distinct(), "cell_id").select("cell_id", F.col("name").alias("Name"), F.col("well").alias("CapID"), F.size("Point").alias("PointCount"), "Point")


def write_cutting_xml(shapes: DataFrame, path: str) -> None:
    """cutting_shapes() as XML files, an element Shape each."""
    shapes.write.format("xml").option("rootTag", "ImageData").option("rowTag", "Shape").save(path)

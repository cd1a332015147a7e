"""Segmentation and filters of whole images, exact, by tiles and lines that Spark deals out.

Kernels of a bounded reach run over tiles with halos. Distances run over bundles of columns, then of rows. What reaches
further (flooding, chosen peaks, labels) passes tile borders in rounds: each tile settles what it can from its neighbours'
last states, until no tile changes. So a task holds a tile or a bundle of lines, and results equal the whole-image
kernels in `functions.kernels` for every tile size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import tiling
from .graphs import _cut as _written

#: Side of a tile, and columns or rows that a task takes the distances of at once.
TILE, LINES = 512, 64
#: Pixels of a grid that is worked on in a stack with others of its size, and of a stack, at most.
SMALL, STACK = 4096, 1 << 19


def sized(px: DataFrame, by: Sequence[str]) -> DataFrame:
    """px with h and w, the image's size as its pixels show it. One row per image is joined."""
    ends = px.groupBy(*by).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
    return px.join(ends, list(by)) if by else px.crossJoin(F.broadcast(ends))  # one row


def _fields(px: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in px.schema if f.name in names)


def per_block(px: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], halo: int, by: Sequence[str], inputs: dict[str, float], outputs: dict[str, str], tile: int = TILE, keep: str | None = None) -> DataFrame:
    """A kernel over tiles with halos, cut at the image's ends: (by..., h, w, y, x, outputs...) of each tile's own pixels.

    px(by..., h, w, y, x, inputs...); inputs: columns and what stands for missing pixels; outputs: names and types. The
    kernel also gets `core`, the pixels that aren't halo. A partition's tiles come sorted; small ones of one size are stacked,
    so a kernel takes grids of two axes and of three. With keep, an output's name, only pixels where it isn't 0. A tile that no pixel reaches gives none. tile is raised to the halo.
    """
    tile = max(tile, halo, 1)
    columns = [*by, "h", "w"]

    ids = [*by, "ty", "tx"]

    def work(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        """Whole tiles, whose rows begin at starts."""
        heads = rows.iloc[starts]
        ty, tx, h, w = (heads[c].to_numpy().astype(np.int64) for c in ("ty", "tx", "h", "w"))
        y0, y1, x0, x1 = np.maximum(ty * tile - halo, 0), np.minimum((ty + 1) * tile + halo, h), np.maximum(tx * tile - halo, 0), np.minimum((tx + 1) * tile + halo, w)
        own = np.stack([ty * tile - y0, np.minimum((ty + 1) * tile, h) - y0, tx * tile - x0, np.minimum((tx + 1) * tile, w) - x0], 1)
        shapes, kind = np.unique(np.column_stack([y1 - y0, x1 - x0, own]), axis=0, return_inverse=True)
        kind = np.where((ty * tile < h) & (tx * tile < w), kind.ravel(), -1)  # others are only a halo of the image's last tiles
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        y, x, slot = rows["y"].to_numpy() - y0[group], rows["x"].to_numpy() - x0[group], np.zeros(len(starts), np.int64)
        for k, (height, width, a, b, c, d) in enumerate(shapes.tolist()):
            alike = np.flatnonzero(kind == k)
            size = height * width
            many = max(STACK // size, 1) if size <= SMALL else 1
            for at in range(0, len(alike), many):
                some = alike[at : at + many]
                slot[some] = np.arange(len(some))
                if len(some) == len(starts):
                    here = slice(None)
                elif len(some) == 1:
                    here = slice(starts[some[0]], starts[some[0] + 1] if some[0] + 1 < len(starts) else None)
                else:
                    taken = np.zeros(len(starts), bool)
                    taken[some] = True
                    here = taken[group]
                grids = {}
                for name, missing in inputs.items():
                    grids[name] = np.full((len(some), height, width), missing, np.float64)
                    grids[name][slot[group[here]], y[here], x[here]] = rows[name].to_numpy()[here]
                grids["core"] = np.zeros((len(some), height, width), bool)
                grids["core"][:, a:b, c:d] = True
                made = kernel(grids if size <= SMALL else {name: g[0] for name, g in grids.items()})
                made = {name: made[name].reshape(len(some), height, width)[:, a:b, c:d] for name in outputs}
                n, ys, xs = np.nonzero(made[keep]) if keep else (v.ravel() for v in np.indices((len(some), b - a, d - c)))
                out = {c_: heads[c_].to_numpy()[some[n]] for c_ in columns} | {"y": (ys + a + y0[some[n]]).astype(np.int32), "x": (xs + c + x0[some[n]]).astype(np.int32)}
                yield pd.DataFrame(out | {name: made[name][n, ys, xs].astype({"long": np.int64, "int": np.int32}.get(kind_, np.float64)) for name, kind_ in outputs.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last tile so far
        for rows in batches:
            if not len(rows):
                continue
            last = pd.concat([held[-1].iloc[-1:], rows])[ids] if held else pd.concat([rows.iloc[:1], rows])[ids]
            before, now = last.iloc[:-1].reset_index(drop=True), last.iloc[1:].reset_index(drop=True)
            new = np.flatnonzero(((before != now) & ~(before.isna() & now.isna())).any(axis=1).to_numpy())
            if len(new):
                done = pd.concat([*held, rows.iloc[: new[-1]]], ignore_index=True)
                ahead = sum(map(len, held))
                starts = np.unique(np.append(0, new[:-1] + ahead))
                if len(done):
                    yield from work(done, starts)
                held = [rows.iloc[new[-1] :]]
            else:
                held.append(rows)
        if held:
            yield from work(pd.concat(held, ignore_index=True), np.zeros(1, np.int64))

    shared = tiling.with_halo(px.select(*columns, "y", "x", *inputs), tile, halo).drop("core")
    kinds = "".join(f", {name} {kind}" for name, kind in outputs.items())
    return shared.repartition(*ids).sortWithinPartitions(*ids).mapInPandas(run, f"{_fields(px, columns)}, y int, x int{kinds}")


def distance(mask: DataFrame, by: Sequence[str] = (), lines: int = LINES) -> DataFrame:
    """mask(by..., h, w, y, x; the foreground) with depth, the Euclidean distance to the nearest pixel that isn't there.

    What lies outside the image isn't background; without any, the distance is h + w.
    """
    columns = [*by, "h", "w"]

    def along(name: str, across: str, kernel: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
            size = {"y": int(rows["h"].iloc[0]), "x": int(rows["w"].iloc[0])}
            size[across], base = min(lines, size[across]), {"y": 0, "x": 0}
            base[across] = int(rows[across].iloc[0]) // lines * lines
            grid = np.zeros((size["y"], size["x"]))
            grid[y - base["y"], x - base["x"]] = rows["depth"].to_numpy()
            out = rows[[*columns, "y", "x"]].copy()
            out[name] = kernel(grid, rows)[y - base["y"], x - base["x"]]
            return out

        return run

    kinds = f"{_fields(mask, columns)}, y int, x int, depth double"
    first = along("depth", "x", lambda g, rows: K.column_distance(g > 0, float(rows["h"].iloc[0] + rows["w"].iloc[0])))
    second = along("depth", "y", lambda g, rows: K.row_envelope(g))
    px = mask.select(*columns, "y", "x", F.lit(1.0).alias("depth"))
    px = px.groupBy(*by, F.expr(f"x div {lines}").alias("bundle")).applyInPandas(first, kinds)
    return px.groupBy(*by, F.expr(f"y div {lines}").alias("bundle")).applyInPandas(second, kinds)


def chosen_peaks(px: DataFrame, min_distance: int, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """px(by..., h, w, y, x, value) to (by..., h, w, y, x, value, rank): peaks that are min_distance apart, ranked from 1 on by value, then in reading order."""
    found = per_block(px, lambda g: {"value": g["value"], "peak": K.peaks(g["value"], min_distance)}, max(min_distance, 1), by, {"value": 0.0}, {"value": "double", "peak": "int"}, tile, keep="peak")
    now = _written(found.select(*by, "h", "w", "y", "x", "value", F.lit(0).alias("state")))
    side = max(tile, min_distance, 1)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """This tile's peaks, given the states so far of those around it."""
        given = np.where(~rows["core"] & (rows["state"] == 0), 2, rows["state"])
        states = K.choose_peaks(list(zip(rows["value"].tolist(), rows["y"].tolist(), rows["x"].tolist(), given.tolist(), strict=True)), min_distance)
        return rows.assign(state=np.array(states, np.int32))[rows["core"]][[*by, "h", "w", "y", "x", "value", "state"]]

    while not now.where("state = 0").isEmpty():
        now = _written(tiling.with_halo(now, side, max(min_distance, 1)).groupBy(*by, "ty", "tx").applyInPandas(settle, f"{_fields(now, [*by, 'h', 'w'])}, y int, x int, value double, state int"))
    order = Window.partitionBy(*by).orderBy(F.desc("value"), "y", "x")
    return now.where("state = 1").select(*by, "h", "w", "y", "x", "value", F.row_number().over(order).cast("long").alias("rank"))


def _until_settled(state: DataFrame, kernel: Callable, inputs: dict[str, float], column: str, by: Sequence[str], tile: int) -> DataFrame:
    """state with the column as it is when no tile's kernel changes it any more."""
    while True:
        new = per_block(state, kernel, 1, by, inputs, {column: "double"}, tile).select(*by, "y", "x", F.col(column).alias("new"))
        step = _written(state.join(new, [*by, "y", "x"]))
        changed = not step.where(F.col(column) != F.col("new")).isEmpty()
        state = step.drop(column).withColumnRenamed("new", column)
        if not changed:
            return state


def travel_time(px: DataFrame, seeds: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """px(by..., h, w, y, x, speed, ...) with time from the nearest seed(by..., y, x), infinite where none leads; as kernels.travel_time."""
    far = float("inf")
    state = px.join(seeds.select(*by, "y", "x", F.lit(0.0).alias("zero")), [*by, "y", "x"], "left").withColumn("time", F.coalesce("zero", F.lit(far))).drop("zero")
    return _until_settled(_written(state), lambda g: {"time": K.travel_time(g["speed"], g["time"])}, {"speed": 0.0, "time": far}, "time", by, tile)


def watershed(px: DataFrame, seeds: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Flood px(by..., h, w, y, x, height; the foreground) from seeds(by..., y, x, rank) to (by..., h, w, y, x, cell_id).

    As kernels.watershed with labels by rank; pixels that no flood reaches are left out, seeds outside px too. Three
    rounds of rounds: levels until they settle, then steps over plateaus, then labels along the ways of the flood.
    """
    own = [*by, "h", "w", "y", "x"]
    joined = px.join(seeds.select(*by, "y", "x", F.col("rank").cast("double").alias("label")), [*by, "y", "x"], "left")
    wall = float("inf")
    at_seed = lambda value: F.when(F.col("label").isNotNull(), value).otherwise(F.lit(wall))
    state = _written(joined.select(*own, F.col("height").cast("double").alias("height"), at_seed(F.col("height")).alias("level"), at_seed(F.lit(0.0)).alias("steps"), F.coalesce("label", F.lit(0.0)).alias("label")))

    state = _until_settled(state, lambda g: {"level": K.flood_levels(g["height"], g["level"])}, {"height": wall, "level": wall}, "level", by, tile)
    state = _until_settled(state, lambda g: {"steps": K.plateau_steps(g["level"], g["steps"])}, {"level": wall, "steps": wall}, "steps", by, tile)

    def label(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        parents = np.where(g["core"], K.flood_parents(g["level"], g["steps"]), -1)  # around the tile, labels are as they are
        return {"label": K.follow(parents, g["label"])}

    state = _until_settled(state, label, {"level": wall, "steps": wall, "label": 0.0}, "label", by, tile)
    return state.where("label != 0").select(*own, F.col("label").cast("long").alias("cell_id"))


def morphology(mask: DataFrame, kernel: Callable[[np.ndarray, int], np.ndarray], radius: int, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """The foreground mask(by..., h, w, y, x) after kernels.dilate or kernels.erode by a disk."""
    if radius < 1:
        return mask.select(*by, "h", "w", "y", "x")
    ones = mask.select(*by, "h", "w", "y", "x", F.lit(1.0).alias("on"))
    return per_block(ones, lambda g: {"on": kernel(g["on"].astype(np.int8), radius)}, radius, by, {"on": 0.0}, {"on": "int"}, tile, keep="on").drop("on")


def expand(mask: DataFrame, radius: int, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Labels mask(by..., h, w, y, x, cell_id) grown by radius, inside the image; as kernels.expand_labels."""
    return per_block(mask, lambda g: {"cell_id": K.expand_labels(g["cell_id"].astype(np.int64), radius)}, radius, by, {"cell_id": 0.0}, {"cell_id": "long"}, tile, keep="cell_id")


def by_size(px: DataFrame, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], tile: int) -> DataFrame:
    """Images of one tile by a single pass, larger ones by rounds over their tiles; px (h, w, ...) is a written table. Both give the same."""
    fits = (F.col("h") <= tile) & (F.col("w") <= tile)
    done = small(px.where(fits))
    return done if px.where(~fits).isEmpty() else done.unionByName(large(px.where(~fits)))


def label_mask(mask: DataFrame, dilation: int = 0, min_distance: int = 2, by: Sequence[str] = (), tile: int = TILE, lines: int = LINES) -> DataFrame:
    """Cells of a foreground mask(by..., h, w, y, x; a written table): distance peaks as centres, then watershed from them; as kernels.label_mask."""

    def whole(px: DataFrame) -> DataFrame:
        return per_block(px.withColumn("on", F.lit(1.0)), lambda g: {"cell_id": K.label_mask(g["on"], dilation, min_distance)}, 0, by, {"on": 0.0}, {"cell_id": "long"}, tile, keep="cell_id")

    return by_size(mask, whole, lambda px: _label_by_tiles(px, dilation, min_distance, by, tile, lines), tile)


def _label_by_tiles(mask: DataFrame, dilation: int, min_distance: int, by: Sequence[str], tile: int, lines: int) -> DataFrame:
    deep = _written(distance(mask, by, lines))
    seeds = chosen_peaks(deep.withColumnRenamed("depth", "value"), min_distance, by, tile)
    grown = morphology(mask, K.dilate, dilation, by, tile)
    height = grown.join(deep.select(*by, "y", "x", "depth"), [*by, "y", "x"], "left").withColumn("height", -F.coalesce("depth", F.lit(0.0)))
    return watershed(height.drop("depth"), seeds, by, tile)


def blur(px: DataFrame, sigma: float, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """px(by..., h, w, y, x, value) blurred, borders of the image repeated: (by..., h, w, y, x, out)."""
    reach = max(int(4 * sigma + 0.5), 1)
    return per_block(px, lambda g: {"out": K.gaussian_blur(g["value"], sigma)}, reach, by, {"value": 0.0}, {"out": "double"}, tile)

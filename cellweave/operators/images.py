"""Whole-image operators: segmentation and filters over tiles that Spark deals out, and small kernels over images, crops and pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import tiled
from .graphs import _cut as _written
from .labels import otsu_threshold


def per_image(px: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], by: str = "image_id", keep_zeros: bool = True, out: str = "out double") -> DataFrame:
    """kernel on each image's dense grid; (by, y, x, out), zeros left out if asked. For images that don't fit a task, use tiling.per_tile."""
    name, kind = out.split()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        grid = np.zeros((y.max() + 1, x.max() + 1))
        grid[y, x] = rows["value"].to_numpy()
        got = kernel(grid)
        ys, xs = np.indices(got.shape) if keep_zeros else np.nonzero(got)
        ys, xs = np.ravel(ys), np.ravel(xs)
        values = got[ys, xs]
        return pd.DataFrame({by: rows[by].iloc[0], "y": ys.astype(np.int32), "x": xs.astype(np.int32), name: values.astype(np.int64 if kind == "long" else np.float64)})

    return px.groupBy(by).applyInPandas(run, f"{by} {px.schema[by].dataType.simpleString()}, y int, x int, {name} {kind}")


def segment_threshold(px: DataFrame, threshold: float | None = None, speckle: int = 1, dilation: int = 0, min_distance: int = 2, by: str = "image_id", tile: int = tiled.TILE) -> DataFrame:
    """px(by, y, x, value) to (by, y, x, cell_id): labels by a global threshold (the image's Otsu threshold if none), opened by disks, then peaks and watershed.

    Images are cut into tiles whose borders don't show (see operators.tiled). An image is as large as its pixels show;
    missing pixels are 0. Empty input gives no labels.
    """
    px = tiled.sized(px.select(by, "y", "x", "value"), [by])
    limit = F.lit(threshold) if threshold is not None else F.col("threshold")
    if threshold is None:
        px = px.join(otsu_threshold(px, by=[by]), by)
    mask = px.where(F.col("value") > limit).select(by, "h", "w", "y", "x")
    if speckle:
        mask = tiled.morphology(tiled.morphology(mask, K.erode, speckle, [by], tile), K.dilate, speckle - 1, [by], tile)
    return tiled.label_mask(_written(mask), dilation, min_distance, [by], tile).drop("h", "w")


def segment_local(px: DataFrame, radius: int = 3, offset: float = 0.0, min_distance: int = 2, by: str = "image_id", tile: int = tiled.TILE) -> DataFrame:
    """Labels by a local median threshold, otherwise as segment_threshold."""
    px = tiled.sized(px.select(by, "y", "x", "value"), [by])
    mask = tiled.per_block(px, lambda g: {"on": K.local_threshold(g["value"], radius, offset)}, radius, [by], {"value": 0.0}, {"on": "int"}, tile, keep="on").drop("on")
    return tiled.label_mask(_written(mask), 0, min_distance, [by], tile).drop("h", "w")


def otsu(a: np.ndarray, bins: int = 512) -> float:
    """The threshold of one grid, as labels.otsu_threshold has it of a table."""
    counts, edges = np.histogram(a, bins)
    centre = (edges[:-1] + edges[1:]) / 2
    low, high = counts.cumsum(), counts[::-1].cumsum()[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m_low, m_high = (counts * centre).cumsum() / low, ((counts * centre)[::-1].cumsum() / counts[::-1].cumsum())[::-1]
        between = np.nan_to_num(low[:-1] * high[1:] * (m_low[:-1] - m_high[1:]) ** 2)
    return float(centre[between.argmax()])


def expand_nuclei(px: DataFrame, radius: int, by: str = "image_id", tile: int = tiled.TILE) -> DataFrame:
    """Label images (value = label) with each nucleus grown; grown labels stay inside the image."""
    mask = tiled.sized(px.select(by, "y", "x", F.col("value").cast("long").alias("cell_id")), [by])
    return tiled.expand(mask, radius, [by], tile).drop("h", "w")


def segment_cytosol(px: DataFrame, low: float = 0.02, high: float = 0.98, min_distance: int = 2, by: str = "image_id", tile: int = tiled.TILE) -> DataFrame:
    """Cytosols around nuclei: bright peaks are centres, travel time over the brightness is flooded from them."""
    px = tiled.sized(px.select(by, "y", "x", F.col("value").cast("double").alias("value")), [by])
    ends = px.groupBy(by).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q"))
    lo, span = F.col("q")[0], F.col("q")[1] - F.col("q")[0]
    unit = F.when(span > 0, (F.col("value") - lo) / span).otherwise(F.col("value") - lo)
    px = px.join(ends, by).select(by, "h", "w", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)).alias("value"))
    px = _written(px.join(otsu_threshold(px, by=[by]), by).withColumn("inside", (F.col("value") > F.col("threshold")).cast("double")).drop("threshold"))

    def whole(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        seeds, inside = K.ranked_maxima(g["value"], min_distance), g["inside"] > 0
        time = K.travel_time(g["value"] + 1e-3, np.where(seeds > 0, 0.0, np.inf))
        return {"cell_id": K.watershed_from(np.minimum(time, 1e9), K.ranks_of((seeds > 0) & inside, seeds), inside)}

    def rounds(px: DataFrame) -> DataFrame:
        seeds = _written(tiled.chosen_peaks(px, min_distance, [by], tile))
        timed = tiled.travel_time(px.withColumn("speed", F.col("value") + 1e-3), seeds, [by], tile)
        height = timed.where("inside > 0").withColumn("height", F.least("time", F.lit(1e9))).drop("value", "speed", "time", "inside")
        order = Window.partitionBy(by).orderBy("rank")
        kept = seeds.join(px.where("inside > 0").select(by, "y", "x"), [by, "y", "x"]).withColumn("rank", F.row_number().over(order).cast("long"))
        return tiled.watershed(height, kept, [by], tile)

    once = lambda px: tiled.per_block(px, whole, 0, [by], {"value": 0.0, "inside": 0.0}, {"cell_id": "long"}, tile, keep="cell_id")
    return tiled.by_size(px, once, rounds, tile).drop("h", "w")


def refine_upscaled(px: DataFrame, n: int, smoothing: int = 2, by: str = "image_id", tile: int = tiled.TILE) -> DataFrame:
    """Label images (value = label) n times as large, borders smoothed by opening; the disk shrinks until an image loses no label."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    big = px.select(by, "y", "x", F.col("value").cast("long").alias("cell_id")).where("cell_id != 0")
    big = big.withColumn("p", F.explode(steps)).withColumn("q", F.explode(steps)).select(by, (F.col("y") * n + F.col("p")).cast("int").alias("y"), (F.col("x") * n + F.col("q")).cast("int").alias("x"), "cell_id")
    big = _written(tiled.sized(big, [by]))

    def opened(k: int) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
        def kernel(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            labels = g["cell_id"].astype(np.int64)
            core = np.where(K.erode((labels > 0).astype(np.int8), k) > 0, labels, 0)
            return {"cell_id": K.expand_labels(core, k + 1) * (labels > 0)}

        return kernel

    tries = big.withColumn("k", F.lit(0))
    for k in range(1, smoothing + 1):
        tries = tries.unionByName(tiled.per_block(big, opened(k), 2 * k + 1, [by], {"cell_id": 0.0}, {"cell_id": "long"}, tile, keep="cell_id").withColumn("k", F.lit(k)))
    tries = _written(tries)
    found = tries.groupBy(by, "k", "cell_id").agg(F.lit(1).alias("one")).groupBy(by, "k").agg(F.count("one").alias("n"))
    whole = found.where("k = 0").select(by, F.col("n").alias("all"))
    best = found.join(whole, by).where(F.col("n") == F.col("all")).groupBy(by).agg(F.max("k").alias("k"))
    return tries.join(best, [by, "k"]).select(by, "y", "x", "cell_id")


def blur(px: DataFrame, sigma: float, by: str = "image_id", tile: int = tiled.TILE) -> DataFrame:
    """(by, y, x, out): blurred over tiles with halos; borders of the image are repeated."""
    return tiled.blur(tiled.sized(px.select(by, "y", "x", "value"), [by]), sigma, [by], tile).drop("h", "w")


def rotate(px: DataFrame, choices: int, seed: int) -> DataFrame:
    """Each image by one of `choices` equally spaced angles, drawn from its id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1))
        grid[rows["y"], rows["x"]] = rows["value"]
        k = int((int(rows["image_id"].iloc[0]) + seed) * 2654435761 % (1 << 32)) % choices
        rows = rows[["image_id", "y", "x"]].copy()
        rows["out"] = K.rotate(grid, 360 * k / choices)[rows["y"], rows["x"]]
        return rows

    return px.select("image_id", "y", "x", F.col("value").cast("double").alias("value")).groupBy("image_id").applyInPandas(run, f"image_id {px.schema['image_id'].dataType.simpleString()}, y int, x int, out double")


def illumination(px: DataFrame, sigma: float = 2.0, double: bool = False, by: str = "image_id", tile: int = tiled.TILE) -> DataFrame:
    """(by, y, x, out): unit range, then dark parts lifted by the inverted blurred background; optionally bright parts lowered by it too."""
    px = tiled.sized(px.select(by, "y", "x", F.col("value").cast("double").alias("value")), [by])
    ends = px.groupBy(by).agg(F.min("value").alias("lo"), (F.max("value") - F.min("value")).alias("span"))
    unit = _written(px.join(ends, by).withColumn("value", F.when(F.col("span") > 0, (F.col("value") - F.col("lo")) / F.col("span")).otherwise(0.0)).drop("lo", "span"))
    back = _written(unit.select(by, "y", "x", "value").join(tiled.blur(unit, sigma, [by], tile).drop("h", "w"), [by, "y", "x"]))
    lit = back.join(back.groupBy(by).agg(F.min("out").alias("dim"), F.max("out").alias("bright")), by)
    v, b = F.col("value"), F.col("out")
    out = v + F.when(v < b, F.col("bright") - b).otherwise(0.0)
    if double:
        out = out - F.when(v > b, b - F.col("dim")).otherwise(0.0)
    return lit.select(by, "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)).alias("out"))


def cell_crops(crops: DataFrame, half: int, sigma: float = 1.0) -> DataFrame:
    """Crops (cell_id, y, x, own, value) with their mask's holes filled, the mask blurred, and values under it."""
    side = 2 * half

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, value = np.zeros((side, side)), np.zeros((side, side))
        own[rows["y"], rows["x"]] = rows["own"]
        value[rows["y"], rows["x"]] = rows["value"]
        soft = K.gaussian_blur(K.fill_holes(own > 0).astype(float), sigma)
        y, x = np.indices((side, side)).reshape(2, -1)
        return pd.DataFrame({"cell_id": rows["cell_id"].iloc[0], "y": y.astype(np.int32), "x": x.astype(np.int32), "mask": soft.ravel(), "value": (soft * value).ravel()})

    return crops.groupBy("cell_id").applyInPandas(run, "cell_id long, y int, x int, mask double, value double")


def register_pairs(pairs: DataFrame, side: int, upsample: int = 10) -> DataFrame:
    """pairs (a, b, source, target: arrays of side * side values) to (a, b, dy, dx, error): shift of target on source, and what differs after it."""

    def run(batches):
        for rows in batches:
            out = []
            for s, t in zip(rows["source"], rows["target"], strict=True):
                s, t = np.asarray(s, float).reshape(side, side), np.asarray(t, float).reshape(side, side)
                shift = K.phase_shift(s, t, upsample)
                moved = K.apply_shift(t, shift)
                out.append((*shift, float(np.sqrt(((moved - s) ** 2).mean()))))
            yield pd.DataFrame({"a": rows["a"], "b": rows["b"], "dy": [o[0] for o in out], "dx": [o[1] for o in out], "error": [o[2] for o in out]})

    return pairs.mapInPandas(run, "a long, b long, dy double, dx double, error double")


def max_error(errors: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Largest registration error that still counts: a low quantile of the errors of tiles that don't touch."""
    return errors.agg(F.percentile("error", F.lit(alpha)).alias("max_error"))


def usable_edges(edges: DataFrame, limit: float, max_shift: float) -> DataFrame:
    """Edges with an error of infinity where it is above the limit or the shift too far."""
    bad = (F.col("error") > limit) | (F.abs("dy") > max_shift) | (F.abs("dx") > max_shift)
    return edges.withColumn("error", F.when(bad, float("inf")).otherwise(F.col("error")))


def parse_names(names: Sequence[str]) -> list[str]:
    """Channel names of files: the first number in each path."""
    import re

    return [(re.search(r"\d+", n) or [n])[0] for n in names]

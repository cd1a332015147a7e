"""Stitching in one flow: neighbouring tiles are registered on their overlaps, placed over the graph of neighbours, and blended on one canvas.

A task holds the two overlaps of a pair, or the pixels of a few canvas rows; images of any size are rows of tables.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import graphs
from .graphs import _cut as _written
from .pixels import rescale_unit, to_uint


def neighbours(nominal: DataFrame, height: int, width: int, least: int = 4) -> DataFrame:
    """nominal(tile, y, x) to (a, b, oy, ox): pairs of tiles, a < b, whose nominal windows share at least `least` rows and columns; o: b's place from a.

    Tiles meet in buckets of a tile's size, so each is compared with those around it only.
    """
    at = nominal.select("tile", F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x"))
    keyed = at.withColumns({"by": F.floor(F.col("y") / height), "bx": F.floor(F.col("x") / width)})
    near = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
    other = keyed.withColumn("o", near).select(F.col("tile").alias("b"), F.col("y").alias("y2"), F.col("x").alias("x2"), (F.col("by") + F.col("o.p")).alias("by"), (F.col("bx") + F.col("o.q")).alias("bx"))
    oy, ox = F.col("y2") - F.col("y"), F.col("x2") - F.col("x")
    met = keyed.join(other, ["by", "bx"]).where((F.col("tile") < F.col("b")) & (F.abs(oy) <= height - least) & (F.abs(ox) <= width - least))
    return met.select(F.col("tile").alias("a"), "b", oy.alias("oy"), ox.alias("ox"))


def register(px: DataFrame, pairs: DataFrame, height: int, width: int, upsample: int = 1) -> DataFrame:
    """px(tile, y, x, value) of the reference channel and pairs to (a, b, dy, dx, error): b's place from a, and how much the overlaps differ after the shift (of where both have pixels, as a share of their spread)."""

    def side(tile: str, which: int) -> DataFrame:
        """Pixels of one tile that lie in the other, in the overlap's own rows and columns."""
        rows = pairs.join(px.withColumnRenamed("tile", tile), tile)
        sign = 1 if which == 0 else -1
        y0, x0 = F.greatest(sign * F.col("oy"), F.lit(0)), F.greatest(sign * F.col("ox"), F.lit(0))
        y1, x1 = F.least(sign * F.col("oy"), F.lit(0)) + height, F.least(sign * F.col("ox"), F.lit(0)) + width
        inside = rows.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
        return inside.select("a", "b", "oy", "ox", F.lit(which).alias("side"), (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), F.col("value").cast("double").alias("value"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        oy, ox = int(rows["oy"].iloc[0]), int(rows["ox"].iloc[0])
        both = np.zeros((2, height - abs(oy), width - abs(ox)))
        both[rows["side"], rows["y"], rows["x"]] = rows["value"]
        dy, dx = K.phase_shift(both[0] - both[0].mean(), both[1] - both[1].mean(), upsample)
        p, q = round(dy), round(dx)
        moved = K.shifted(both[1], -p, -q, np.nan)
        spread = both[0].std() + both[1].std()
        error = float(np.sqrt(np.nanmean((moved - both[0]) ** 2)) / spread) if spread > 0 and abs(p) < both.shape[1] and abs(q) < both.shape[2] else float("inf")
        return pd.DataFrame({"a": [int(rows["a"].iloc[0])], "b": [int(rows["b"].iloc[0])], "dy": [oy + dy], "dx": [ox + dx], "error": [error]})

    return side("a", 0).unionByName(side("b", 1)).groupBy("a", "b").applyInPandas(run, "a long, b long, dy double, dx double, error double")


def places(edges: DataFrame, nominal: DataFrame, most_error: float = 0.5, most_shift: float | None = None) -> DataFrame:
    """(tile, y, x), from 0 on: along the cheapest registered ways from each component's centre; components that no good overlap joins are placed by the map of the largest.

    Overlaps that differ by more than most_error, or lead further than most_shift from nominal, aren't used.
    """
    at = nominal.select(F.col("tile").alias("node"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    ends = [at.select(F.col("node").alias(k), F.col("y").alias(f"y{k}"), F.col("x").alias(f"x{k}")) for k in "ab"]
    good = edges.where(F.col("error") <= most_error)
    if most_shift is not None:
        off = [F.abs(F.col(f"d{c}") - (F.col(f"{c}b") - F.col(f"{c}a"))) for c in "yx"]
        good = good.join(ends[0], "a").join(ends[1], "b").where((off[0] <= most_shift) & (off[1] <= most_shift))
    good = _written(good.select("a", "b", "dy", "dx", "error"))
    nodes = _written(at.select("node"))
    parts = _written(graphs.components(nodes, good))
    found = _written(graphs.positions(good, graphs.centre_nodes(nodes, good, parts)))
    return graphs.fit_positions(found, at).select(F.col("node").alias("tile"), "y", "x")


def blend(px: DataFrame, at: DataFrame, height: int, width: int) -> DataFrame:
    """px(tile, c, y, x, value) on the canvas: (c, y, x, value), the mean of all tiles there, each weighted by its distance to its own border."""
    near = lambda c, n: F.least(F.col(c) + 1, F.lit(n) - F.col(c))
    weight = F.least(near("y", height), near("x", width))
    placed = px.withColumn("w", weight).join(at.select("tile", F.round("y").cast("int").alias("oy"), F.round("x").cast("int").alias("ox")), "tile")
    total = placed.groupBy("c", (F.col("y") + F.col("oy")).alias("y"), (F.col("x") + F.col("ox")).alias("x")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("wv"))
    return total.select("c", "y", "x", (F.col("wv") / F.col("w")).alias("value"))


def rescale_channels(px: DataFrame, ranges: Mapping[int, tuple[float, float]] | None = None, default: tuple[float, float] = (1.0, 99.0)) -> DataFrame:
    """px(c, ..., value) as 16 bits, each channel between its own percentiles (0 to 100); channels without a range take the default."""
    rows = [(int(c), lo, hi) for c, (lo, hi) in (ranges or {}).items()]
    spark = px.sparkSession
    asked = px.select("c").distinct().join(spark.createDataFrame(rows, "c int, lo double, hi double"), "c", "left")
    asked = asked.select("c", F.coalesce("lo", F.lit(default[0])).alias("lo"), F.coalesce("hi", F.lit(default[1])).alias("hi"))
    kinds = [(r["lo"], r["hi"]) for r in asked.select("lo", "hi").distinct().collect()]  # as many as ranges are given
    shares = sorted({k / 100 for pair in kinds for k in pair})
    if not shares:
        return px.withColumn("value", F.lit(0))
    found = px.groupBy("c").agg(F.percentile(F.col("value").cast("double"), F.array(*map(F.lit, shares))).alias("q")).join(asked, "c")
    pick = lambda column: F.coalesce(*[F.when(F.col(column) / 100 == s, F.col("q")[k]) for k, s in enumerate(shares)])
    bounds = found.select("c", pick("lo").alias("low"), pick("hi").alias("high"))
    return px.join(bounds, "c").withColumn("value", to_uint(rescale_unit(F.col("value").cast("double"), F.col("low"), F.col("high")), 65535)).drop("low", "high")


def stitch(px: DataFrame, nominal: DataFrame, height: int, width: int, reference: int = 0, upsample: int = 1, most_error: float = 0.5, most_shift: float | None = None) -> tuple[DataFrame, DataFrame]:
    """px(tile, c, y, x, value) of tiles of one size and nominal(tile, y, x) to the canvas (c, y, x, value) and the tiles' places (tile, y, x).

    The reference channel is registered; all are placed alike. Tiles without a good overlap keep their place from nominal.
    """
    pairs = _written(neighbours(nominal, height, width))
    edges = _written(register(px.where(F.col("c") == reference).select("tile", "y", "x", "value"), pairs, height, width, upsample))
    at = _written(places(edges, nominal, most_error, most_shift))
    return blend(px, at, height, width), at

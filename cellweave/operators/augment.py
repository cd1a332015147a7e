"""Chains of random transforms of single-cell images, drawn for each cell from a counter and not from a generator's state.

A draw is a hash of seed, epoch, the transform's place in the chain, and the cell, so it is the same whatever the
partitions, the order of rows or the retries, and another epoch gives other draws. Transforms are column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A transform takes the crops(cell_id, y, x, value, ...), their side and a function that gives draws in [0, 1) by number.
Transform = Callable[[DataFrame, int, Callable[..., Column]], DataFrame]


def uniform(*key: Column) -> Column:
    """In [0, 1): the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[k.cast("string") for k in key]).cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)


def flip(share: float = 0.5) -> Transform:
    """Left to right, for this share of cells."""

    def run(px: DataFrame, side: int, draw: Callable[..., Column]) -> DataFrame:
        return px.withColumn("x", F.when(draw(0) < share, side - 1 - F.col("x")).otherwise(F.col("x")).cast("int"))

    return run


def quarter_turns() -> Transform:
    """By 0 to 3 quarter turns."""

    def run(px: DataFrame, side: int, draw: Callable[..., Column]) -> DataFrame:
        k, y, x, last = F.floor(draw(0) * 4), F.col("y"), F.col("x"), side - 1
        turned = F.when(k == 0, F.struct(y.alias("y"), x.alias("x"))).when(k == 1, F.struct((last - x).alias("y"), y.alias("x"))).when(k == 2, F.struct((last - y).alias("y"), (last - x).alias("x"))).otherwise(F.struct(x.alias("y"), (last - y).alias("x")))
        return px.withColumn("_turned", turned).withColumns({"y": F.col("_turned.y").cast("int"), "x": F.col("_turned.x").cast("int")}).drop("_turned")

    return run


def scale(low: float, high: float) -> Transform:
    """Values times a factor between low and high, one a cell."""

    def run(px: DataFrame, side: int, draw: Callable[..., Column]) -> DataFrame:
        return px.withColumn("value", F.col("value") * (low + (high - low) * draw(0)))

    return run


def noise(sigma: float) -> Transform:
    """Gaussian noise, drawn for each pixel."""

    def run(px: DataFrame, side: int, draw: Callable[..., Column]) -> DataFrame:
        at = [F.col(c) for c in ("c", "y", "x") if c in px.columns]
        normal = F.sqrt(-2 * F.log(1 - draw(0, *at))) * F.cos(2 * math.pi * draw(1, *at))
        return px.withColumn("value", F.col("value") + sigma * normal)

    return run


def apply_chain(px: DataFrame, transforms: Sequence[Transform], side: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """px(cell_id, [c,] y, x, value) of square crops after all transforms in order; rows and other columns stay.

    Every draw depends on seed, epoch, place in the chain and cell_id (null ids draw alike); an empty chain changes nothing.
    """
    out = px
    for place, transform in enumerate(transforms):
        draw = lambda k, *more, place=place: uniform(F.lit(seed), F.lit(epoch), F.lit(place), F.lit(k), F.coalesce(F.col("cell_id").cast("string"), F.lit("")), *more)
        out = transform(out, side, draw)
    return out

"""Single-cell sets and the features of each cell: crops, per-mask statistics, lookups by id, and the inference surface."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("mean", "median", "quant75", "quant25", "summed_intensity", "summed_intensity_area_normalized")


def feature_names(masks: Sequence[str], channels: Sequence[str]) -> list[str]:
    """<mask>_area of each mask, then <channel>_<statistic>_<mask>, channel by channel."""
    return [f"{m}_area" for m in masks] + [f"{c}_{s}_{m}" for c in channels for m in masks for s in STATS]


def cell_statistics(cells: DataFrame, masks: Sequence[str], channels: Sequence[str], by: Sequence[str] = ("cell_id",), digits: int | None = None) -> DataFrame:
    """One row per cell from its pixels (by..., one boolean column per mask, one value column per channel).

    With a nucleus and a cytosol (the two first masks) the cytosol alone is a third: pixels of exactly one of them. Empty
    masks have area 0, sum 0 and null means. One grouping of one shuffle by cell; digits rounds for comparisons.
    """
    named = {m: F.col(m) for m in masks}
    if len(masks) == 2:
        named[f"{masks[1]}_only"] = F.col(masks[0]) != F.col(masks[1])
    exact = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    aggs: list[Column] = [F.count_if(on).alias(f"{m}_area") for m, on in named.items()]
    for channel in channels:
        v = F.col(channel).cast("double")
        for m, on in named.items():
            inside = F.when(on, v)
            total = F.coalesce(F.sum(inside), F.lit(0.0))
            stats = (F.avg(inside), F.percentile(inside, F.lit(0.5)), F.percentile(inside, F.lit(0.75)), F.percentile(inside, F.lit(0.25)), total, total / F.nullif(F.count_if(on), F.lit(0)))
            aggs += [exact(s).alias(f"{channel}_{name}_{m}") for name, s in zip(STATS, stats, strict=True)]
    return cells.groupBy(*by).agg(*aggs)


def tile_range_join(px: DataFrame, centers: DataFrame, half: int) -> DataFrame:
    """Pixels in the window [centre - half, centre + half) of each centre (cell_id, cy, cx): an equi-join on tiles of the window's size, then the exact range."""
    tile = 2 * half
    reach = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    asked = centers.withColumn("d", reach).select(*centers.columns, (F.floor((F.col("cy") - half) / tile) + F.col("d.a")).cast("int").alias("ty"), (F.floor((F.col("cx") - half) / tile) + F.col("d.b")).cast("int").alias("tx"))
    tiled = px.withColumn("ty", F.floor(F.col("y") / tile).cast("int")).withColumn("tx", F.floor(F.col("x") / tile).cast("int"))
    near = tiled.join(asked, ["ty", "tx"])
    inside = (F.col("y") >= F.col("cy") - half) & (F.col("y") < F.col("cy") + half) & (F.col("x") >= F.col("cx") - half) & (F.col("x") < F.col("cx") + half)
    return near.where(inside).drop("ty", "tx")


def rounded_centers(centers: DataFrame) -> DataFrame:
    """Centres at whole pixels, halves to even."""
    return centers.select("cell_id", F.rint("y").cast("int").alias("cy"), F.rint("x").cast("int").alias("cx"))


def inside_border(centers: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """Centres further than half from all borders."""
    return centers.where((F.col("cy") > half) & (F.col("cy") < height - half) & (F.col("cx") > half) & (F.col("cx") < width - half))


def extract_cells(px: DataFrame, mask: DataFrame, centers: DataFrame, half: int) -> DataFrame:
    """Single-cell images (cell_id, y, x, own, value): each window with y and x from its corner, own marks the cell's pixels, values elsewhere are 0."""
    crop = tile_range_join(px, centers, half)
    own = mask.select("y", "x", F.col("cell_id").alias("owner"))
    cut = crop.join(own, ["y", "x"], "left").withColumn("own", F.coalesce(F.col("owner") == F.col("cell_id"), F.lit(False)))
    return cut.select("cell_id", (F.col("y") - F.col("cy") + half).cast("int").alias("y"), (F.col("x") - F.col("cx") + half).cast("int").alias("x"), "own", F.when(F.col("own"), F.col("value")).otherwise(0).alias("value"))


def lookup(table: DataFrame, ids: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows of the ids asked for, in their order (column position); an id without rows fails the query."""
    out = ids.join(table, key, "left")
    known = F.col([c for c in table.columns if c != key][0])
    return out.withColumn(key, F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col(key))).cast("long")).otherwise(F.col(key))).orderBy("position")


def attach_coordinates(features: DataFrame, centers: DataFrame, region: str) -> DataFrame:
    return features.join(centers.select("cell_id", "y", "x"), "cell_id", "left").withColumn("region", F.lit(region))


def infer(images: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A model over batches of single-cell images: model gets and returns a pandas frame; it is loaded once per worker if it is a callable object."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, schema)


def log_transform(value: Column) -> Column:
    return F.log(value + 1e-9)

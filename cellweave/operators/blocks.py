"""Block and neighbourhood operators that are plain grouping: downsampling, pyramids, backgrounds, focus stacking, mosaics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_mean(px: DataFrame, n: int, by: Sequence[str] = (), padded: bool = False, column: str = "value") -> DataFrame:
    """Mean of n x n blocks; padded blocks at the far borders count missing pixels as 0."""
    mean = F.sum(column) / (n * n) if padded else F.avg(column)
    return px.groupBy(*by, F.expr(f"y div {n}").cast("int").alias("y"), F.expr(f"x div {n}").cast("int").alias("x")).agg(mean.alias(column))


def downsample(px: DataFrame, n: int, by: Sequence[str] = (), padded: bool = False, top: int = 65535, column: str = "value") -> DataFrame:
    """Block means stretched so that the largest becomes `top`; an image of zeros stays zero."""
    small = block_mean(px, n, by, padded, column)
    most = small.groupBy(*by).agg(F.max(column).alias("most"))
    joined = small.join(most, list(by)) if by else small.crossJoin(F.broadcast(most))  # one row
    return joined.withColumn(column, F.when(F.col("most") > 0, (F.col(column) / F.col("most") * top)).otherwise(0.0).cast("int")).drop("most")


def stride(px: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Every n-th pixel; the last row and column are never taken."""
    return px.where((F.col("y") % n == 0) & (F.col("x") % n == 0) & (F.col("y") < height - 1) & (F.col("x") < width - 1)).withColumns({"y": F.expr(f"y div {n}").cast("int"), "x": F.expr(f"x div {n}").cast("int")})


def upscale(mask: DataFrame, n: int) -> DataFrame:
    """Each pixel as an n x n block."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    wide = mask.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return wide.withColumns({"y": (F.col("y") * n + F.col("dy")).cast("int"), "x": (F.col("x") * n + F.col("dx")).cast("int")}).drop("dy", "dx")


def background_corrected(px: DataFrame, size: int, height: int, width: int, by: Sequence[str] = (), scale: bool = False, column: str = "value") -> DataFrame:
    """Whole size x size blocks less their median, not below 0, where their largest value is positive; optionally over the block's spread first. Remainder strips stay."""
    whole = (F.col("y") < height // size * size) & (F.col("x") < width // size * size)
    tiled = px.withColumns({"ty": F.expr(f"y div {size}"), "tx": F.expr(f"x div {size}"), "whole": whole})
    v = F.col(column).cast("double")
    block = tiled.where("whole").groupBy(*by, "ty", "tx").agg(F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("most"), F.stddev_pop(v).alias("spread"))
    joined = tiled.join(block, [*by, "ty", "tx"], "left")
    unit = F.coalesce(F.nullif(F.col("spread"), F.lit(0.0)), F.lit(1.0)) if scale else F.lit(1.0)
    fixed = F.greatest((v - F.col("median")) / unit, F.lit(0.0))
    return joined.withColumn("corrected", F.when(F.col("whole") & (F.col("most") > 0), fixed).otherwise(v)).select(*px.columns, "corrected")


def pyramid(px: DataFrame, factors: Sequence[int] = (2, 4, 8), by: Sequence[str] = (), column: str = "value") -> DataFrame:
    """Level 0 as it is, and a level of block means for each factor, with a column scale."""
    out = px.select(*by, "y", "x", F.col(column).cast("double").alias(column)).withColumn("scale", F.lit(0))
    for k, factor in enumerate(factors, 1):
        out = out.unionByName(block_mean(px, factor, by, column=column).withColumn("scale", F.lit(k)))
    return out


def label_pyramid(mask: DataFrame, factors: Sequence[int] = (2, 4, 8)) -> DataFrame:
    """Labels by nearest neighbour: the pixel at each block's corner."""
    out = mask.withColumn("scale", F.lit(0))
    for k, f in enumerate(factors, 1):
        corner = mask.where((F.col("y") % f == 0) & (F.col("x") % f == 0))
        out = out.unionByName(corner.withColumns({"y": F.expr(f"y div {f}").cast("int"), "x": F.expr(f"x div {f}").cast("int"), "scale": F.lit(k)}))
    return out


def neighbours(px: DataFrame, offsets: Sequence[tuple[int, int]], by: Sequence[str] = (), column: str = "value") -> DataFrame:
    """(by..., y, x, dy, dx, value): each pixel's neighbours at the offsets that exist. Each pixel is sent to those that it neighbours; one shuffle follows in the caller's grouping."""
    spread = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets]))
    sent = px.select(*by, F.col("y").alias("fy"), F.col("x").alias("fx"), F.col(column).alias("value"), spread.alias("o"))
    return sent.select(*by, (F.col("fy") - F.col("o.dy")).cast("int").alias("y"), (F.col("fx") - F.col("o.dx")).cast("int").alias("x"), "o.dy", "o.dx", "value")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def _filtered(px: DataFrame, radius: int, height: int, width: int, by: Sequence[str], agg) -> DataFrame:
    near = neighbours(px, disk(radius), by).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return near.groupBy(*by, "y", "x").agg(agg.alias("value"))


def median_filter(px: DataFrame, radius: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Median over a disk, of the pixels inside the image."""
    return _filtered(px, radius, height, width, by, F.percentile(F.col("value").cast("double"), F.lit(0.5)))


def dilate(px: DataFrame, radius: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Largest value over a disk."""
    return _filtered(px, radius, height, width, by, F.max("value"))


def erode(px: DataFrame, radius: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Least value over a disk, inside the image."""
    return _filtered(px, radius, height, width, by, F.min("value"))


# Sobel weights by offset.
SOBEL = {(-1, -1): (-1, -1), (-1, 0): (-2, 0), (-1, 1): (-1, 1), (0, -1): (0, -2), (0, 1): (0, 2), (1, -1): (1, -1), (1, 0): (2, 0), (1, 1): (1, 1)}


def sobel(px: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Squared gradient magnitude (weights a quarter of Sobel's) of interior pixels: column edge."""
    near = neighbours(px, list(SOBEL), by).where(F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2))
    weight = F.create_map(*[x for (a, b), w in SOBEL.items() for x in (F.lit(a * 3 + b), F.struct(F.lit(w[0]).alias("y"), F.lit(w[1]).alias("x")))])[F.col("dy") * 3 + F.col("dx")]
    gy, gx = F.sum(F.col("value") * weight["y"]), F.sum(F.col("value") * weight["x"])
    return near.groupBy(*by, "y", "x").agg(((gy * gy + gx * gx) / 16).alias("edge"))


def focus_stack(stack: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Of stack(by..., z, y, x, value) at each interior pixel the value of the plane with the strongest edge; the first of ties."""
    edges = sobel(stack, height, width, [*by, "z"])
    joined = stack.join(edges, [*by, "z", "y", "x"])
    return joined.groupBy(*by, "y", "x").agg(F.max_by("value", F.struct("edge", -F.col("z"))).alias("value"))


def assemble(tiles: DataFrame, positions: DataFrame, blend: str = "avg") -> DataFrame:
    """Tile pixels (tile_id, y, x, value) at their tiles' positions (tile_id, oy, ox); overlaps are averaged or the largest taken."""
    placed = tiles.join(positions, "tile_id").select((F.col("y") + F.col("oy")).cast("int").alias("y"), (F.col("x") + F.col("ox")).cast("int").alias("x"), "value")
    return placed.groupBy("y", "x").agg((F.avg if blend == "avg" else F.max)("value").alias("value"))

"""Per-pixel operators over pixel(image_id, y, x, ..., value): normalisation, projections, composites, channels.

Every operator is a plan of built-in functions; quantiles are exact and interpolated (``percentile``). Where an image is
the group, aggregation runs in two steps (partial, then per image), so one large image doesn't meet in one task except
for its quantiles, which need its distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UINT16, UINT8 = 65535, 255


def rescale_unit(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low), clipped to [0, 1]; where the range is empty the difference alone is clipped."""
    span = high - low
    return F.least(F.greatest(F.when(span == 0, value - low).otherwise((value - low) / F.nullif(span, F.lit(0.0))), F.lit(0.0)), F.lit(1.0))


def to_uint(value: Column, top: int = UINT16) -> Column:
    """[0, 1] to an integer range, truncated; outside it the query fails."""
    checked = F.when((value < 0) | (value > 1), F.raise_error(F.lit("values have to lie in [0, 1]")).cast("double")).otherwise(value)
    return (checked * top).cast("int")


def normalize_range(px: DataFrame, low: float, high: float, top: int | None = UINT16, column: str = "value") -> DataFrame:
    """Fixed bounds; `top` gives integers, None keeps fractions."""
    if high <= low:
        raise ValueError("the upper bound has to be above the lower one")
    unit = rescale_unit(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)))
    return px.withColumn("normalized", unit if top is None else to_uint(unit, top))


def quantile_bounds(px: DataFrame, by: Sequence[str], low: float = 0.001, high: float = 0.999, column: str = "value", truncate: bool = False) -> DataFrame:
    """Bounds per group: (by..., low, high)."""
    q = F.percentile(F.col(column).cast("double"), F.array(F.lit(low), F.lit(high)))
    out = px.groupBy(*by).agg(q.alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return out.select(*by, (F.floor(lo).cast("double") if truncate else lo).alias("low"), (F.floor(hi).cast("double") if truncate else hi).alias("high"))


def normalize_quantiles(px: DataFrame, by: Sequence[str] = ("image_id",), low: float = 0.001, high: float = 0.999, column: str = "value", truncate: bool = False) -> DataFrame:
    """Each group between its own quantiles, clipped to [0, 1]."""
    bounds = quantile_bounds(px, by, low, high, column, truncate)
    unit = rescale_unit(F.col(column).cast("double"), F.col("low"), F.col("high"))
    return px.join(bounds, list(by)).withColumn("normalized", unit).drop("low", "high")


def normalize_with_bounds(px: DataFrame, bounds: DataFrame, by: Sequence[str], column: str = "value") -> DataFrame:
    """Bounds from a table (by..., low, high); groups that it lacks keep null."""
    return px.join(bounds, list(by), "left").withColumn("normalized", rescale_unit(F.col(column).cast("double"), F.col("low"), F.col("high"))).drop("low", "high")


def rescale_with_cutoff(px: DataFrame, by: Sequence[str], low: float, high: float, cutoff: float, top: int | None = UINT16, column: str = "value") -> DataFrame:
    """Percentiles (0 to 100) over the values below the cutoff, but only in groups whose largest value exceeds it."""
    v = F.col(column).cast("double")
    at = F.array(F.lit(low / 100), F.lit(high / 100))
    cut = F.percentile(F.when(v < cutoff, v), at)
    bounds = px.groupBy(*by).agg(F.when(F.max(v) > cutoff, cut).otherwise(F.percentile(v, at)).alias("q"))
    unit = rescale_unit(v, F.col("q")[0], F.col("q")[1])
    return px.join(bounds, list(by)).withColumn("normalized", unit if top is None else to_uint(unit, top)).drop("q")


def min_max(px: DataFrame, by: Sequence[str] = ("image_id",), column: str = "value") -> DataFrame:
    """Least to 0 and largest to 1; constant groups stay as they are."""
    v = F.col(column).cast("double")
    ends = px.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (v - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(v)
    return px.join(ends, list(by)).withColumn("normalized", scaled).drop("low", "high")


def max_projection(px: DataFrame, keep: Sequence[str], column: str = "value", floor: float | None = None) -> DataFrame:
    """Largest value over the axes not in `keep` (z for a stack, channels for a projection that starts at `floor`)."""
    top = F.max(column)
    return px.groupBy(*keep).agg((F.greatest(F.lit(floor), top) if floor is not None else top).alias(column))


def select_channels(px: DataFrame, channels: Sequence[int]) -> DataFrame:
    """Chosen channels, numbered anew in the order given; channels that don't exist are an error of the caller's list."""
    order = {c: k for k, c in enumerate(channels)}
    mapping = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return px.where(F.col("c").isin(list(order))).withColumn("c", mapping[F.col("c")])


def repeat_channel(px: DataFrame, n: int) -> DataFrame:
    """One channel as n equal ones."""
    return px.drop("c").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def subtract_from_labels(px: DataFrame, number: int, column: str = "cell_id") -> DataFrame:
    return px.withColumn(column, F.when(F.col(column) != 0, F.col(column) - number).otherwise(F.col(column)))


def colorize(px: DataFrame, color: Sequence[float], clip: float = 0.1, by: Sequence[str] = ("image_id",), column: str = "value") -> DataFrame:
    """Shift by the clip percentile, divide by percentile 100 - clip of what is left, clip to [0, 1], times each colour part: columns r, g, b."""
    v = F.col(column).cast("double")
    base = px.groupBy(*by).agg(F.percentile(v, F.lit(clip / 100)).alias("base"))
    shifted = px.join(base, list(by)).withColumn("shifted", v - F.col("base"))
    top = shifted.groupBy(*by).agg(F.percentile("shifted", F.lit(1 - clip / 100)).alias("top"))
    unit = F.least(F.greatest(F.col("shifted") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return shifted.join(top, list(by)).select(*px.columns, *[(unit * part).alias(n) for part, n in zip(color, "rgb", strict=True)])


def composite(layers: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Colour layers summed and clipped to 1."""
    return layers.groupBy(*keep).agg(*[F.least(F.sum(c), F.lit(1.0)).alias(c) for c in "rgb"])


def remap_channels(px: DataFrame, order: Sequence[int]) -> DataFrame:
    """Channel order[k] becomes channel k."""
    mapping = F.create_map(*[F.lit(x) for k, c in enumerate(order) for x in (c, k)])
    return px.withColumn("c", mapping[F.col("c")])


def gaussian_noise(px: DataFrame, sigma: float, seed: int, column: str = "value", mean: float = 0.5, spread: float = 1.0) -> DataFrame:
    """Values times a clamped normal draw added, clamped to [0, 1]; repeatable for one partitioning only."""
    draw = F.least(F.greatest(F.randn(seed) * spread + mean, F.lit(0.0)), F.lit(1.0))
    v = F.col(column).cast("double")
    return px.withColumn(column, F.least(F.greatest(v + draw * sigma * v, F.lit(0.0)), F.lit(1.0)))


def rotate_right_angle(px: DataFrame, quarter_turns: Column | int, side: int) -> DataFrame:
    """Square images turned counter-clockwise by quarter turns: a swap of coordinates."""
    k = F.lit(quarter_turns) if isinstance(quarter_turns, int) else quarter_turns
    k, y, x, far = F.pmod(k, F.lit(4)), F.col("y"), F.col("x"), F.lit(side - 1)
    new_y = F.when(k == 0, y).when(k == 1, far - x).when(k == 2, far - y).otherwise(x)
    new_x = F.when(k == 0, x).when(k == 1, y).when(k == 2, far - x).otherwise(far - y)
    return px.withColumns({"y": new_y, "x": new_x})

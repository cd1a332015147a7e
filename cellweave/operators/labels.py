"""Label masks as sparse pixels (y, x, cell_id), background left out: edges, relabelling, filters and per-label measures."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import running_sum
from . import mixture

NEIGHBOURS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def edge_labels(mask: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Labels that touch a border of the image (of each group's)."""
    border = F.col("y").isin(0, height - 1) | F.col("x").isin(0, width - 1)
    return mask.where(border & (F.col("cell_id") != 0)).select(*by, "cell_id").distinct()


def remove_labels(mask: DataFrame, ids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pixels of all other labels."""
    return mask.join(ids.select(*by, "cell_id").distinct(), [*by, "cell_id"], "left_anti")


def remove_edge_labels(mask: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    return remove_labels(mask, edge_labels(mask, height, width, by), by)


def shift_labels(mask: DataFrame, shift: int, height: int, width: int, remove_edges: bool = False) -> DataFrame:
    """All labels plus shift; with remove_edges without those that touch a border."""
    kept = remove_edge_labels(mask, height, width) if remove_edges else mask
    return kept.withColumn("cell_id", F.when(F.col("cell_id") != 0, F.col("cell_id") + shift).otherwise(F.col("cell_id")))


def compact_after_removal(mask: DataFrame, removed: DataFrame) -> DataFrame:
    """Removed labels dropped and each other label lowered by the number of removed ones below it."""
    gone = removed.select("cell_id").distinct()
    ids = mask.select("cell_id").distinct().withColumn("gone", F.lit(0)).unionByName(gone.withColumn("gone", F.lit(1)))
    ids = ids.groupBy("cell_id").agg(F.max("gone").alias("gone"))
    new = running_sum(ids, "cell_id", "gone").withColumn("new_id", F.col("cell_id") - F.col("before")).where("gone = 0")
    return mask.join(new.select("cell_id", "new_id"), "cell_id").drop("cell_id").withColumnRenamed("new_id", "cell_id").select(mask.columns)


def dense_labels(mask: DataFrame) -> DataFrame:
    """Labels renumbered 1..n in their order, as column new_id. The ranking runs over distinct labels only, in slices."""
    ids = running_sum(mask.where("cell_id != 0").select("cell_id").distinct(), "cell_id")
    return mask.join(ids.select("cell_id", (F.col("before") + 1).cast("long").alias("new_id")), "cell_id")


def centroids(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """cell_id, y, x (means), n (pixels)."""
    return mask.where("cell_id != 0").groupBy(*by, "cell_id").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("n"))


def label_sizes(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return mask.where("cell_id != 0").groupBy(*by, "cell_id").agg(F.count("*").alias("n"))


def size_filter(mask: DataFrame, low: float, high: float) -> DataFrame:
    """Labels of low to high pixels, both included."""
    return remove_labels(mask, label_sizes(mask).where((F.col("n") < low) | (F.col("n") > high)))


def size_thresholds(sizes: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row (low, high): the central interval of a normal fit to log sizes (the one-component mixture in closed form)."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    fit = sizes.agg(F.avg(F.log("n")).alias("mu"), F.sqrt(F.var_pop(F.log("n")) + 1e-6).alias("sigma"))
    return fit.select(F.exp(F.col("mu") - z * F.col("sigma")).alias("low"), F.exp(F.col("mu") + z * F.col("sigma")).alias("high"))


def size_outliers(mask: DataFrame, confidence: float = 0.95, lower: bool = True, upper: bool = True, components: int = 1, keep: str = "largest", **how) -> DataFrame:
    """Labels (cell_id, n) outside the fitted interval; either side can be left open.

    With more components than one the interval is that of the kept population of a mixture fitted to log sizes: the
    largest, smallest, mostcommon or leastcommon; how: settings of mixture.fit().
    """
    sizes = label_sizes(mask)
    if components == 1 and not how:
        row = size_thresholds(sizes, confidence).first()
        limits = (row["low"], row["high"]) if row and row["low"] is not None else None
    else:
        limits = mixture.thresholds(sizes, components, keep, confidence, **how)
    low, high = limits or (-math.inf, math.inf)
    outside = F.lit(False)
    if lower:
        outside = outside | (F.col("n") < low)
    if upper:
        outside = outside | (F.col("n") > high)
    return sizes.where(outside)


def filter_sizes(mask: DataFrame, limits: tuple[float | None, float | None] | None = None, **how) -> DataFrame:
    """The mask without labels beyond the limits (None: open), or, without limits, beyond a fitted interval (see size_outliers)."""
    if limits is None:
        return remove_labels(mask, size_outliers(mask, **how))
    low, high = (d if x is None else x for x, d in zip(limits, (-math.inf, math.inf), strict=True))
    return size_filter(mask, low, high)


def mixture_index(components: DataFrame, which: str) -> DataFrame:
    """Component (k, mean, weight) with the largest or smallest mean, or the most or least weight; the first of ties."""
    column = "mean" if which in ("largest", "smallest") else "weight"
    best = F.max_by if which in ("largest", "most") else F.min_by
    sign = -1 if which in ("largest", "most") else 1
    return components.agg(best("k", F.struct(F.col(column), sign * F.col("k"))).alias("k"))


def contact_proportion(dense: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Per label of a mask that holds its background too: (1 + neighbours that are background) / (1 + neighbours with another label), over interior pixels."""
    interior = dense.where(F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2))
    asked = interior.select(*by, "cell_id", F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in NEIGHBOURS])).alias("at")).select(*by, "cell_id", "at.y", "at.x")
    other = dense.select(*by, "y", "x", F.col("cell_id").alias("neighbour"))
    met = asked.join(other, [*by, "y", "x"])
    counts = met.groupBy(*by, "cell_id").agg(F.count_if(F.col("neighbour") == 0).alias("background"), F.count_if(F.col("neighbour") != F.col("cell_id")).alias("foreign"))
    ids = dense.select(*by, "cell_id").distinct()
    share = (1 + F.coalesce("background", F.lit(0))) / (1 + F.coalesce("foreign", F.lit(0)))
    return ids.join(counts, [*by, "cell_id"], "left").select(*by, "cell_id", share.alias("proportion"))


def contact_filter(dense: DataFrame, height: int, width: int, threshold: float) -> DataFrame:
    """Labels whose contact with the background falls below the threshold become background."""
    low = contact_proportion(dense, height, width).where(F.col("proportion") < threshold).select("cell_id", F.lit(True).alias("low"))
    return dense.join(low, "cell_id", "left").withColumn("cell_id", F.when(F.col("low"), F.lit(0)).otherwise(F.col("cell_id"))).select(dense.columns)


def otsu_threshold(px: DataFrame, bins: int = 512, by: Sequence[str] = (), column: str = "value") -> DataFrame:
    """Global Otsu threshold: the first bin centre with the largest variance between classes.

    Bins without values are left out: their variance is that of the bin before them, which comes first.
    """
    v = F.col(column).cast("double")
    ends = px.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    joined = px.join(ends, list(by)) if by else px.crossJoin(F.broadcast(ends))  # ends is one row
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.least(F.floor((v - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = joined.groupBy(*by, "lo", "hi", F.coalesce(k, F.lit(0)).alias("k")).agg(F.count("*").alias("n"))
    full = counts.withColumn("centre", F.col("lo") + (F.col("k") + 0.5) * width)
    keys = list(by) or [F.lit(0)]
    up = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    n, weighted = F.col("n"), F.col("n") * F.col("centre")
    low_n, high_n = F.sum(n).over(up), F.sum(n).over(down)
    spread = low_n * high_n * F.pow(F.sum(weighted).over(up) / F.nullif(low_n, F.lit(0)) - F.sum(weighted).over(down) / F.nullif(high_n, F.lit(0)), F.lit(2.0))
    scored = full.select(*by, "k", "centre", spread.alias("spread"))  # the last bin has none; it counts only in images of one value
    return scored.groupBy(*by).agg(F.max_by("centre", F.struct("spread", -F.col("k"))).alias("threshold"))


def any_nonzero(px: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return px.groupBy(*by).agg(F.bool_or(F.col(column) != 0).alias("any"))


def all_nonzero(px: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return px.groupBy(*by).agg(F.bool_and(F.col(column) != 0).alias("all"))


def recode_selected(mask: DataFrame, ids: DataFrame) -> DataFrame:
    """kept: 2 for the chosen labels, 1 for the others."""
    chosen = ids.select("cell_id").distinct().withColumn("chosen", F.lit(True))
    return mask.join(chosen, "cell_id", "left").withColumn("kept", F.when(F.col("chosen"), 2).otherwise(1)).drop("chosen")


def outlines(mask: DataFrame) -> DataFrame:
    """cell_id and its pixels as sorted (y, x) pairs. A cell's pixels are one row, as they are for cutting it out."""
    return mask.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("outline"))


def match_nuclei(nuclei: DataFrame, cytosol: DataFrame, share: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(nucleus_id, cytosol_id) of nuclei that lie wholly on cytosol: the least cytosol that holds `share` of the nucleus."""
    other = cytosol.where("cell_id != 0").select(*by, "y", "x", F.col("cell_id").alias("cytosol_id"))
    met = nuclei.where("cell_id != 0").withColumnRenamed("cell_id", "nucleus_id").join(other, [*by, "y", "x"], "left")
    pairs = met.groupBy(*by, "nucleus_id", "cytosol_id").agg(F.count("*").alias("n"))
    whole = pairs.groupBy(*by, "nucleus_id").agg(F.sum("n").alias("size"), F.bool_and(F.col("cytosol_id").isNotNull()).alias("inside"))
    fit = pairs.join(whole, [*by, "nucleus_id"]).where(F.col("inside") & (F.col("n") >= share * F.col("size")))
    return fit.groupBy(*by, "nucleus_id").agg(F.min("cytosol_id").alias("cytosol_id"))


def one_to_one(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matches whose cytosol has one nucleus; all nuclei of other cytosols go."""
    single = matches.groupBy(*by, "cytosol_id").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return matches.join(single, [*by, "cytosol_id"])


def multinucleated(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return matches.groupBy(*by, "cytosol_id").agg(F.count("*").alias("n_nuclei")).where("n_nuclei > 1")


def unassigned(cytosol: DataFrame, matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cytosols without a nucleus."""
    ids = cytosol.where("cell_id != 0").select(*by, F.col("cell_id").alias("cytosol_id")).distinct()
    return ids.join(matches, [*by, "cytosol_id"], "left_anti")


def relabel_cytosol(cytosol: DataFrame, lookup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cytosol pixels under their nucleus' label; those without one go."""
    return cytosol.join(lookup.withColumnRenamed("cytosol_id", "cell_id"), [*by, "cell_id"]).drop("cell_id").withColumnRenamed("nucleus_id", "cell_id").select(cytosol.columns)

"""Samples and splits that don't depend on partitioning: rows are ordered by an arithmetic hash of their id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import running_sum

# Multiplicative hashing modulo 2^32.
FACTOR, MODULUS = 2654435761, 1 << 32


def shuffle_key(key: str | Column, seed: int = 0) -> Column:
    """A number in [0, 2^32) that orders ids at random but repeatably."""
    k = F.col(key) if isinstance(key, str) else key
    return ((k + seed) * FACTOR) % MODULUS


def sample_n(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement (top-n of the hash order, so each task keeps n at most)."""
    return rows.orderBy(shuffle_key(key, seed), key).limit(n)


def _ranked(rows: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    if by:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(shuffle_key(key, seed), key)))
    hashed = rows.withColumn("_order", shuffle_key(key, seed) * 4096.0 + F.pmod(F.col(key), F.lit(4096)))
    return running_sum(hashed, "_order", ties=[key]).withColumn("rank", (F.col("before") + 1).cast("int")).drop("before", "_order")


def split_fractions(rows: DataFrame, fractions: Sequence[float], names: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """Column split by fractions that sum to 1: sizes are floors, what is left goes to the first splits one by one."""
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions have to sum to 1")
    total = rows.count()
    sizes = [int(total * f) for f in fractions]
    for k in range(total - sum(sizes)):
        sizes[k % len(sizes)] += 1
    return split_sizes(rows, sizes, names, key, seed)


def split_sizes(rows: DataFrame, sizes: Sequence[int], names: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """Column split: the first sizes[0] of the hash order, the next sizes[1], ...; rows beyond are left out."""
    ranked, case, end = _ranked(rows, key, seed), F.lit(None).cast("string"), 0
    ends = []
    for size, name in zip(sizes, names, strict=True):
        end += size
        ends.append((end, name))
    for limit, name in reversed(ends):
        case = F.when(F.col("rank") <= limit, name).otherwise(case)
    return ranked.withColumn("split", case).where("split is not null").drop("rank")


def balanced_per_class(rows: DataFrame, label: str, source: str, key: str, per_class: int, seed: int = 0) -> DataFrame:
    """per_class rows of each label, from its sources in proportion to their sizes (halves to even; floors where all labels have one source); labels that are too small fail."""
    sizes = rows.groupBy(label, source).agg(F.count("*").alias("n"))
    totals = sizes.groupBy(label).agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    single = totals.agg(F.max("sources")).first()[0] == 1
    exact = F.lit(per_class) * F.col("n") / F.col("total")
    quota = sizes.join(totals, label).withColumn("quota", F.when(F.col("total") < per_class, F.raise_error(F.lit("a class has too few rows")).cast("double")).otherwise(F.floor(exact) if single else F.rint(exact)).cast("long"))
    ranked = _ranked(rows, key, seed, [label, source])
    return ranked.join(quota.select(label, source, "quota"), [label, source]).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def batches(rows: DataFrame, key: str, workers: int, least: int = 100, most: int = 1000) -> DataFrame:
    """save_index and batch: rows numbered by key and cut into batches of clamp(ceil(n / workers), least, most)."""
    size = min(max(-(-rows.count() // workers), least), most)
    return running_sum(rows, key, name="save_index").withColumn("batch", F.expr(f"save_index div {size}"))


def best_checkpoint(files: DataFrame, how: str = "max", column: str = "name") -> DataFrame:
    """The file with the largest or least epoch in its name, or the last by name."""
    epoch = F.regexp_extract(column, r"epoch=(\d+)", 1).cast("int")
    if how == "latest":
        return files.agg(F.max(column).alias("name"))
    best = F.max_by if how == "max" else F.min_by
    return files.agg(best(column, F.struct(epoch, F.col(column))).alias("name"))

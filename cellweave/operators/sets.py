"""Set operations on ids, with column cell_id, and checks that compare id sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids(mask: DataFrame, column: str = "cell_id") -> DataFrame:
    """Distinct ids without background."""
    return mask.where(F.col(column) != 0).select(F.col(column).alias("cell_id")).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).unionByName(difference(b, a))


def update(a: DataFrame, minus: DataFrame, plus: DataFrame) -> DataFrame:
    """(a - minus) with plus."""
    return union(difference(a, minus), plus)


def restrict(mask: DataFrame, kept: DataFrame) -> DataFrame:
    """Pixels of kept ids."""
    return mask.join(kept.select("cell_id").distinct(), "cell_id", "left_semi")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids only in a, only in b, in both."""
    joined = a.distinct().withColumn("in_a", F.lit(1)).join(b.distinct().withColumn("in_b", F.lit(1)), "cell_id", "full_outer")
    return joined.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"))

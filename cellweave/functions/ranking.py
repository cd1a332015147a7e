"""Global running sums and ranks without a window over everything: slices of the order are summed first, then each slice runs on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a slice is meant to hold, and the fewest and most slices.
SLICE_ROWS, LEAST, MOST = 250_000, 64, 4096
_STEP = 64


def _place(order: str, bounds: list) -> Column:
    """How many bounds are at or below the value: first among every 64th, then among the 64 after it."""
    fine = [F.array(*[F.lit(b) for b in bounds[k : k + _STEP]]) for k in range(0, len(bounds), _STEP)]

    def place(v: Column) -> Column:
        first = F.lit(0)
        for b in bounds[_STEP - 1 :: _STEP]:
            first = first + (F.lit(b) <= v).cast("int")
        near = F.get(F.array(*fine), first) if len(fine) > 1 else fine[0]
        return first * _STEP * int(len(fine) > 1) + F.coalesce(F.size(F.filter(near, lambda b: b <= v)), F.lit(0))

    return F.transform(F.array(F.col(order)), place)[0]  # bound once: an expression behind `order` isn't worked out again for each bound


def running_sum(rows: DataFrame, order: str, value: str | None = None, name: str = "before", slices: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """rows with the sum of `value` (or the number) of rows that come earlier by the numeric column `order`, then by ties, which leave none.

    Slice bounds are approximate quantiles, as many as the number of rows asks for; sums by slice are one row each.
    """
    at = [k / MOST for k in range(1, MOST)]
    shape = rows.agg(F.count("*").alias("n"), F.percentile_approx(order, at, 40_000).alias("q")).first()
    slices = slices or min(MOST, max(LEAST, shape["n"] // SLICE_ROWS))
    bounds = sorted(set((shape["q"] or [])[MOST // slices - 1 :: MOST // slices]))
    v = F.col(value) if value else F.lit(1)
    cut = rows.withColumn("_slice", _place(order, bounds) if bounds else F.lit(0))
    sums = cut.groupBy("_slice").agg(F.sum(v).alias("_total"))
    bases = sums.select("_slice", (F.sum("_total").over(Window.orderBy("_slice")) - F.col("_total")).alias("_base"))  # MOST + 1 rows at most
    within = F.sum(v).over(Window.partitionBy("_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(bases), "_slice").withColumn(name, F.col("_base") + F.col("_within")).drop("_slice", "_base", "_within")

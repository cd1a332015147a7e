"""Mixtures of Gaussians fitted by expectation and maximisation over a histogram, each round one aggregate.

Equal values share their responsibilities, so values are counted once and every round reads only the distinct ones: its
cost doesn't depend on the number of cells, let alone pixels. A round brings back one row of 3 sums a component.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import _cut as _written


@dataclass(frozen=True)
class Component:
    weight: float
    mean: float
    variance: float

    def interval(self, confidence: float) -> tuple[float, float]:
        """The central interval that holds this share of the component."""
        z = NormalDist().inv_cdf(0.5 + confidence / 2) * math.sqrt(self.variance)
        return self.mean - z, self.mean + z


def histogram(values: DataFrame, value: Column) -> DataFrame:
    """(v, n): distinct values and how many rows have them; nulls are left out."""
    return values.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))


def _log_density(c: Component) -> Column:
    if not c.weight:
        return F.lit(-math.inf)
    return F.lit(math.log(c.weight) - 0.5 * math.log(2 * math.pi * c.variance)) - F.pow(F.col("v") - c.mean, F.lit(2.0)) / (2 * c.variance)


def _step(counts: DataFrame, parts: list[Component], floor: float) -> tuple[list[Component], float]:
    """Components after a round, and the mean log likelihood before it."""
    logs = [F.col(f"l{k}") for k in range(len(parts))]
    dense = counts.select("v", "n", *[_log_density(c).alias(f"l{k}") for k, c in enumerate(parts)])
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = sum((F.exp(x - F.col("top")) for x in logs), F.lit(0.0))
    dense = dense.withColumn("top", top).withColumn("total", total)
    sums = [F.sum(F.col("n") * (F.col("top") + F.log("total"))).alias("ll"), F.sum("n").alias("n")]
    for k, c in enumerate(parts):
        share, gap = F.col("n") * F.exp(logs[k] - F.col("top")) / F.col("total"), F.col("v") - c.mean
        sums += [F.sum(share).alias(f"s{k}"), F.sum(share * gap).alias(f"d{k}"), F.sum(share * gap * gap).alias(f"q{k}")]
    row = dense.agg(*sums).first()
    out = []
    for k, c in enumerate(parts):
        s = row[f"s{k}"]
        if s <= 0:  # nothing is nearest to it any more
            out.append(Component(0.0, c.mean, c.variance))
            continue
        shift = row[f"d{k}"] / s
        out.append(Component(s / row["n"], c.mean + shift, max(row[f"q{k}"] / s - shift * shift, 0.0) + floor))
    return out, row["ll"] / row["n"]


def fit(values: DataFrame, value: Column, components: int = 1, rounds: int = 100, tolerance: float | None = 1e-3, floor: float = 1e-6) -> list[Component]:
    """components Gaussians over a column, in order of their starting means; empty without values.

    Means start at evenly spaced quantiles, variances at the whole's, weights equal. Rounds end when the mean log
    likelihood gains less than tolerance (None: never), or after `rounds`. floor is added to every variance, so that
    equal values don't end the fit. Fewer distinct values than components leave some components alike.
    """
    if components < 1:
        raise ValueError("a mixture has one component at least")
    counts = _written(histogram(values, value))
    places = [(k + 0.5) / components for k in range(components)]
    start = counts.agg(F.percentile("v", F.array(*map(F.lit, places)), F.col("n")).alias("q"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s")).first()
    if not start["n"]:
        return []
    mean = start["s"] / start["n"]
    spread = counts.agg((F.sum(F.col("n") * F.pow(F.col("v") - mean, F.lit(2.0))) / F.sum("n")).alias("x")).first()["x"] + floor
    parts, last = [Component(1 / components, q, spread) for q in start["q"]], -math.inf
    for _ in range(rounds):
        parts, gained = _step(counts, parts, floor)
        if tolerance is not None and abs(gained - last) < tolerance:
            break
        last = gained
    return parts


def pick(parts: list[Component], keep: str) -> Component:
    """The component of the largest or smallest mean, or of the most or least common; the first of ties."""
    by = {"largest": lambda c: c.mean, "smallest": lambda c: -c.mean, "mostcommon": lambda c: c.weight, "leastcommon": lambda c: -c.weight}
    if keep not in by:
        raise ValueError(f"keep one of {sorted(by)}")
    return max(parts, key=by[keep])


def thresholds(sizes: DataFrame, components: int = 1, keep: str = "largest", confidence: float = 0.95, log: bool = True, **how) -> tuple[float, float] | None:
    """Least and largest size (column n) of the kept component's central interval; None without sizes. log: fitted to log sizes."""
    parts = fit(sizes, F.log("n") if log else F.col("n"), components, **how)
    if not parts:
        return None
    low, high = pick(parts, keep).interval(confidence)
    return (math.exp(low), math.exp(high)) if log else (low, high)

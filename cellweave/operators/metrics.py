"""Metrics of predictions, as grouping and cumulative windows over distinct scores (never over all rows in one task)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import running_sum


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def precision_recall(pred: DataFrame, positive: int, truth: str = "class_true", guess: str = "class_pred") -> DataFrame:
    """precision and recall of one class; null where nothing was predicted or is there."""
    hit = F.count_if((F.col(truth) == positive) & (F.col(guess) == positive))
    return pred.agg(_ratio(hit, F.count_if(F.col(guess) == positive)).alias("precision"), _ratio(hit, F.count_if(F.col(truth) == positive)).alias("recall"))


def threshold_curve(pred: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row per distinct score: p and n there, tp and fp down to it, positives and negatives of all. Sums run in slices of the scores, however many there are."""
    at = pred.groupBy(F.col(score).alias("score")).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    down = running_sum(running_sum(at.withColumn("_down", -F.col("score")), "_down", "p", "_p"), "_down", "n", "_n")
    everything = at.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return down.select("score", "p", "n", (F.col("_p") + F.col("p")).alias("tp"), (F.col("_n") + F.col("n")).alias("fp")).crossJoin(F.broadcast(everything))  # one row


def roc_pr_auc(pred: DataFrame, **columns: str) -> DataFrame:
    """roc_auc and pr_auc by trapezoids over the threshold curve; the point before each one follows from its own counts."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    before = F.when(tp + fp > p + n, (tp - p) / F.nullif(tp + fp - p - n, F.lit(0))).otherwise(1.0)
    roc = _ratio(n, F.col("negatives")) * _ratio(2 * tp - p, F.col("positives"))
    pr = _ratio(p, F.col("positives")) * (tp / (tp + fp) + before)
    return threshold_curve(pred, **columns).agg((F.sum(roc) / 2).alias("roc_auc"), (F.sum(pr) / 2).alias("pr_auc"))


def f1_at(pred: DataFrame, threshold: float = 0.5, truth: str = "truth", score: str = "score") -> DataFrame:
    guess = (F.col(score) >= threshold).cast("int")
    tp, fp, fn = (F.count_if(c) for c in ((guess == 1) & (F.col(truth) == 1), (guess == 1) & (F.col(truth) == 0), (guess == 0) & (F.col(truth) == 1)))
    return pred.agg(_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(pred: DataFrame, classes: Sequence[int], normalize: bool = False, truth: str = "class_true", guess: str = "class_pred") -> DataFrame:
    """A row for each pair of classes, with n and, if normalised, its share of the true class to two places."""
    spark = pred.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"{truth} int, {guess} int")
    counts = pred.groupBy(F.col(truth).cast("int").alias(truth), F.col(guess).cast("int").alias(guess)).agg(F.count("*").alias("n"))
    full = grid.join(counts, [truth, guess], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not normalize:
        return full
    return full.withColumn("share", F.round(_ratio(F.col("n"), F.sum("n").over(Window.partitionBy(truth))), 2))


def class_precision(pred: DataFrame, truth: str = "class_true", guess: str = "class_pred") -> DataFrame:
    return pred.groupBy(F.col(guess).alias("class")).agg((F.count_if(F.col(truth) == F.col(guess)) / F.count("*")).alias("precision"), F.count("*").alias("n"))


def mean_probabilities(pred: DataFrame, probabilities: str, truth: str = "class_true") -> DataFrame:
    """Mean of each entry of a probability array, per true class."""
    flat = pred.select(F.col(truth).alias("class"), F.posexplode(probabilities).alias("entry", "p"))
    return flat.groupBy("class", "entry").agg(F.avg("p").alias("p"))


def regression_losses(pred: DataFrame, truth: str, guess: str, delta: float = 1.0) -> DataFrame:
    """mse, mae and Huber loss."""
    e = F.abs(F.col(guess) - F.col(truth))
    return pred.agg(F.avg(e * e).alias("mse"), F.avg(e).alias("mae"), F.avg(F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2))).alias("huber"))


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    """Records per label, and a row with a null label for all."""
    return rows.rollup(label).agg(F.count("*").alias("n"))

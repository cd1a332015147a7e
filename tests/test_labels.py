"""Literal label masks with known answers."""

# Small masks and the answers that they must have.

import pytest
from pyspark.sql import functions as F

from cellweave.operators import labels, pixels

DIAGONAL = [[1, 0, 0], [0, 2, 0], [0, 0, 3]]
PATCH = [[0, 1, 1], [0, 2, 1], [0, 0, 2]]


def mask(spark, grid, dense=False):
    rows = [(y, x, int(v)) for y, row in enumerate(grid) for x, v in enumerate(row) if v or dense]
    return spark.createDataFrame(rows, "y int, x int, cell_id long")


def grid(df, h=3, w=3):
    out = [[0] * w for _ in range(h)]
    for r in df.collect():
        out[r["y"]][r["x"]] = r["cell_id"]
    return out


def ids(df):
    return {r["cell_id"] for r in df.collect()}


def test_edge_labels(spark):
    assert ids(labels.edge_labels(mask(spark, DIAGONAL), 3, 3)) == {1, 3}


def test_shift_labels(spark):
    assert grid(labels.shift_labels(mask(spark, DIAGONAL), 10, 3, 3)) == [[11, 0, 0], [0, 12, 0], [0, 0, 13]]
    assert grid(labels.shift_labels(mask(spark, DIAGONAL), 10, 3, 3, remove_edges=True)) == [[0, 0, 0], [0, 12, 0], [0, 0, 0]]


def test_remove_labels(spark):
    m = mask(spark, [[1, 2, 1], [1, 0, 2], [0, 2, 3]])
    one_three = spark.createDataFrame([(1,), (3,)], "cell_id long")
    one = spark.createDataFrame([(1,)], "cell_id long")
    assert grid(labels.remove_labels(m, one_three)) == [[0, 2, 0], [0, 0, 2], [0, 2, 0]]
    assert grid(labels.compact_after_removal(m, one)) == [[0, 1, 0], [0, 0, 1], [0, 1, 2]]


def test_contact(spark):
    m = mask(spark, PATCH, dense=True)
    got = {r["cell_id"]: r["proportion"] for r in labels.contact_proportion(m, 3, 3).collect()}
    assert got == pytest.approx({0: 1.0, 1: 1.0, 2: 0.6})
    assert grid(labels.contact_filter(m, 3, 3, 0.7)) == [[0, 1, 1], [0, 0, 1], [0, 0, 0]]


def test_size_filter_and_sizes(spark):
    m = mask(spark, PATCH)
    assert grid(labels.size_filter(m, 1, 2)) == [[0, 0, 0], [0, 2, 0], [0, 0, 2]]
    assert {r["cell_id"]: r["n"] for r in labels.label_sizes(m).collect()} == {1: 3, 2: 2}


def test_subtract(spark):
    got = grid(pixels.subtract_from_labels(mask(spark, [[0, 2, 3], [0, 5, 6], [0, 0, 7]]), 1))
    assert got == [[0, 1, 2], [0, 4, 5], [0, 0, 6]]


def test_centroids(spark):
    got = {r["cell_id"]: (r["y"], r["x"], r["n"]) for r in labels.centroids(mask(spark, PATCH)).collect()}
    assert got[1] == pytest.approx((1 / 3, 5 / 3, 3))
    assert got[2] == pytest.approx((1.5, 1.5, 2))


def test_dense_labels_many(spark):
    m = spark.range(5000).select(F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), (F.col("id") * 7 + 3).alias("cell_id"))
    got = labels.dense_labels(m).where("new_id != x + 1").count()
    assert got == 0


def test_filters_are_idempotent(spark):
    m = mask(spark, PATCH)
    once = labels.size_filter(m, 1, 2)
    assert grid(labels.size_filter(once, 1, 2)) == grid(once)


def test_empty_mask(spark):
    empty = spark.createDataFrame([], "y int, x int, cell_id long")
    assert labels.centroids(empty).count() == 0
    assert labels.size_outliers(empty).count() == 0
    assert labels.dense_labels(empty).count() == 0

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import kernels as K
from cellweave.operators import blocks, images, pixels


def image(spark, a, image_id=0):
    return spark.createDataFrame([(image_id, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id long, y int, x int, value double")


def array(df, column="normalized"):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1))
    for r in rows:
        out[r["y"], r["x"]] = r[column]
    return out


def test_quantile_normalization(spark):
    a = np.random.default_rng(1).random((10, 10))
    got = array(pixels.normalize_quantiles(image(spark, a)))
    lo, hi = np.quantile(a, [0.001, 0.999])
    assert got == pytest.approx(((a - lo) / (hi - lo)).clip(0, 1)) and got.min() == 0 and got.max() == 1


def test_zero_image_stays_zero(spark):
    assert array(pixels.normalize_quantiles(image(spark, np.zeros((4, 4))))).max() == 0
    assert array(blocks.downsample(image(spark, np.zeros((4, 4))), 2, ["image_id"]), "value").max() == 0


def test_range_normalization(spark):
    px = image(spark, np.array([[0.0, 5.0], [10.0, 15.0]]))
    assert array(pixels.normalize_range(px, 5, 10, top=None)).tolist() == [[0, 0], [1, 1]]
    assert array(pixels.normalize_range(px, 5, 10)).tolist() == [[0, 0], [65535, 65535]]
    with pytest.raises(ValueError):
        pixels.normalize_range(px, 5, 5)


def test_uint_range_is_checked(spark):
    with pytest.raises(Exception, match=r"lie in \[0, 1\]"):
        spark.createDataFrame([(1.5,)], "v double").select(pixels.to_uint(F.col("v"))).collect()


def test_padded_downsample_shape(spark):
    assert array(blocks.block_mean(image(spark, np.ones((5, 5))), 2, ["image_id"], padded=True), "value").shape == (3, 3)


def test_gaussian_noise_keeps_range(spark):
    got = array(pixels.gaussian_noise(image(spark, np.full((8, 8), 0.5)), 0.5, 3), "value")
    assert got.min() >= 0.5 and got.max() <= 1


def test_otsu_equals_numpy(spark):
    from cellweave.operators.labels import otsu_threshold

    a = np.random.default_rng(2).integers(0, 4000, (40, 40)).astype(float)
    a[:20] += 3000
    assert otsu_threshold(image(spark, a)).first()["threshold"] == pytest.approx(images.otsu(a))


def test_distance_transform_and_watershed():
    mask = np.zeros((12, 20), int)
    mask[2:9, 2:9] = 1
    mask[3:10, 11:18] = 1
    d = K.distance_transform(mask)
    back = np.argwhere(mask == 0)
    for y, x in ((5, 5), (2, 2), (6, 14)):
        assert d[y, x] == pytest.approx(np.sqrt(((back - (y, x)) ** 2).sum(1).min()))
    assert len(np.unique(K.label_mask(mask, min_distance=3))) == 3


def test_fill_holes():
    a = np.zeros((7, 7), int)
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    assert K.fill_holes(a)[3, 3] and not K.fill_holes(a)[0, 0]


def test_registration_finds_shift():
    a = np.random.default_rng(42).random((100, 100))
    moved = K.apply_shift(a, (5, -3))
    dy, dx = K.phase_shift(moved, a)
    assert (dy, dx) == pytest.approx((5, -3), abs=0.5)
    assert np.abs(K.apply_shift(a, (dy, dx)) - moved).max() < 1e-2

import numpy as np
import pytest

from cellweave.operators import stitching


def tiles_of(image, places, h, w, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    return [(t, c, y, x, float(image[c, py + y, px + x] + rng.normal(0, noise))) for t, (py, px) in places.items() for c in range(len(image)) for y in range(h) for x in range(w)]


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).integers(0, 1000, (2, 70, 90)).astype(float)


def test_noisy_tiles_come_back(spark, image):
    """A 3 x 3 grid of tiles, each a few pixels off its nominal place, and one tile by itself."""
    h = w = 24
    rng = np.random.default_rng(2)
    nominal = {3 * r + k: (r * 17 + 3, k * 17 + 3) for r in range(3) for k in range(3)} | {20: (3, 64)}
    true = {t: (y + int(rng.integers(-2, 3)), x + int(rng.integers(-2, 3))) for t, (y, x) in nominal.items()}
    true[20] = nominal[20]
    px = spark.createDataFrame(tiles_of(image, true, h, w, 5.0), "tile long, c int, y int, x int, value double")
    at = spark.createDataFrame([(t, float(y), float(x)) for t, (y, x) in nominal.items()], "tile long, y double, x double")
    canvas, placed = stitching.stitch(px, at, h, w)
    got = {r.tile: (r.y, r.x) for r in placed.collect()}
    base = (true[4][0] - got[4][0], true[4][1] - got[4][1])
    assert {t: (y + base[0], x + base[1]) for t, (y, x) in got.items() if t != 20} == {t: p for t, p in true.items() if t != 20}
    assert min(y for y, _ in got.values()) == 0 and abs(got[20][1] - got[2][1] - (true[20][1] - true[2][1])) < 6  # alone: by the map of the others
    seen = {(r.c, r.y + base[0], r.x + base[1]): r.value for r in canvas.collect() if r.x + base[1] < 60}
    errors = [abs(v - image[int(c), int(y), int(x)]) for (c, y, x), v in seen.items()]
    assert len(seen) > 2 * 50 * 50 and np.mean(errors) < 6 and max(errors) < 30


def test_weights_and_pairs(spark):
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 3.0), (2, 50.0, 0.0), (3, 3.0, -1.0)], "tile long, y double, x double")
    assert {(r.a, r.b): (r.oy, r.ox) for r in stitching.neighbours(at, 5, 5, 1).collect()} == {(0, 1): (0, 3), (0, 3): (3, -1), (1, 3): (3, -4)}
    px = spark.createDataFrame([(t, 0, y, x, float(v)) for t, v in ((0, 10), (1, 40)) for y in range(5) for x in range(5)], "tile long, c int, y int, x int, value double")
    got = {(r.y, r.x): r.value for r in stitching.blend(px, at.where("tile < 2"), 5, 5).collect()}
    for (y, x), v in got.items():
        weights = {t: min(y + 1, 5 - y, x - o + 1, 5 - x + o) for t, o in ((0, 0), (1, 3)) if 0 <= x - o < 5}
        assert v == pytest.approx(sum(wt * (10, 40)[t] for t, wt in weights.items()) / sum(weights.values()))
    assert len(got) == 5 * 8


def test_ranges_of_channels(spark):
    px = spark.createDataFrame([(c, i, float(i * (c + 1))) for c in range(3) for i in range(101)], "c int, x int, value double")
    got = {(r.c, r.x): r.value for r in stitching.rescale_channels(px, {1: (0.0, 50.0)}, (10.0, 90.0)).collect()}
    for c, (lo, hi) in ((0, (10, 90)), (1, (0, 50)), (2, (10, 90))):
        for x in range(101):
            assert abs(got[c, x] - 65535 * min(max((x - lo) / (hi - lo), 0), 1)) <= 1

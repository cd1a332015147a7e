import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import kernels as K
from cellweave.operators import images, labels, tiled


def frame(spark, grids, name="value", keep=False):
    rows = [(i, int(y), int(x), float(g[y, x])) for i, g in enumerate(grids) for y, x in np.ndindex(*g.shape) if keep or g[y, x] or (y, x) == (g.shape[0] - 1, g.shape[1] - 1)]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {name} double").repartition(3)


def foreground(spark, grids):
    return tiled.sized(frame(spark, grids, keep=True), ["image_id"]).where("value != 0").select("image_id", "h", "w", "y", "x")


def grids_of(df, shapes, name):
    out = [np.zeros(s) for s in shapes]
    for r in df.collect():
        out[r["image_id"]][r["y"], r["x"]] = r[name]
    return out


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:23, :31]
    disks = np.zeros((23, 31), bool)
    for cy, cx, r in ((6, 7, 5), (6, 15, 6), (16, 20, 6), (15, 8, 4), (4, 27, 4)):
        disks |= (y - cy) ** 2 + (x - cx) ** 2 <= r * r
    return [disks, rng.random((19, 22)) < 0.7, np.ones((12, 9), bool), np.zeros((5, 5), bool)]


@pytest.mark.parametrize("lines", [1, 64])
def test_distances_equal_brute_force(spark, masks, lines):
    got = grids_of(tiled.distance(foreground(spark, masks), ["image_id"], lines), [m.shape for m in masks], "depth")
    for m, g in zip(masks, got, strict=True):
        assert np.allclose(g, K.distance_transform(m))
        back = np.argwhere(~m)
        for y, x in np.argwhere(m):
            want = np.sqrt(((back - [y, x]) ** 2).sum(1).min()) if len(back) else sum(m.shape)
            assert g[y, x] == pytest.approx(want)


@pytest.mark.parametrize(("tile", "distance"), [(4, 2), (16, 3)])
def test_peaks_and_watershed_equal_the_whole_image(spark, masks, tile, distance):
    rng = np.random.default_rng(tile)
    heights = [np.where(m, rng.integers(1, 4, m.shape), 0).astype(float) for m in masks]  # many ties and plateaus
    px = tiled.sized(frame(spark, heights, keep=True), ["image_id"])
    seeds = tiled.chosen_peaks(px, distance, ["image_id"], tile).cache()
    wet = px.where("value != 0").withColumn("height", -F.col("value"))
    flooded = grids_of(tiled.watershed(wet, seeds, ["image_id"], tile), [m.shape for m in masks], "cell_id")
    ranked = {i: [(r.y, r.x) for r in sorted((r for r in seeds.collect() if r.image_id == i), key=lambda r: r["rank"])] for i in range(4)}
    for i, (m, a) in enumerate(zip(masks, heights, strict=True)):
        assert ranked[i] == K.local_maxima(a, distance)
        assert np.array_equal(flooded[i], K.watershed(-a, K.local_maxima(a, distance), m))
    seeds.unpersist()


@pytest.mark.parametrize(("tile", "dilation"), [(4, 0), (16, 2), (25, 1), (512, 2)])
def test_labels_equal_the_whole_image(spark, masks, tile, dilation):
    got = grids_of(tiled.label_mask(foreground(spark, masks), dilation, 2, ["image_id"], tile, 5), [m.shape for m in masks], "cell_id")
    for m, g in zip(masks, got, strict=True):
        assert np.array_equal(g, K.label_mask(m, dilation, 2))
    assert len(np.unique(got[0])) == 6  # five disks


def test_watershed_by_hand():
    """Two basins and a ridge: levels are least climbs, labels those of the lower side."""
    height = np.array([[0, 1, 5, 2, 0], [9, 1, 5, 2, 9]], float)
    labels = K.watershed(height, [(0, 0), (0, 4)], height < 9)
    assert labels.tolist() == [[1, 1, 1, 2, 2], [0, 1, 1, 2, 0]]
    flat = K.watershed(np.zeros((1, 7)), [(0, 1), (0, 6)], np.ones((1, 7), bool))
    assert flat.tolist() == [[1, 1, 1, 1, 2, 2, 2]]


def slow_blur(a, sigma):
    r = max(int(4 * sigma + 0.5), 1)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.zeros(a.shape)
    for y, x in np.ndindex(*a.shape):
        out[y, x] = sum(k[i + r] * k[j + r] * a[min(max(y + i, 0), a.shape[0] - 1), min(max(x + j, 0), a.shape[1] - 1)] for i in range(-r, r + 1) for j in range(-r, r + 1))
    return out


@pytest.mark.parametrize("tile", [4, 512])
def test_blur_and_illumination(spark, tile):
    rng = np.random.default_rng(9)
    grids = [rng.random((13, 17)) * 100, np.full((6, 6), 3.0)]
    px = frame(spark, grids, keep=True)
    shapes = [g.shape for g in grids]
    for a, g in zip(grids, grids_of(images.blur(px, 1.0, tile=tile), shapes, "out"), strict=True):
        assert np.allclose(g, slow_blur(a, 1.0))
    for double in (False, True):
        for a, g in zip(grids, grids_of(images.illumination(px, 1.0, double, tile=tile), shapes, "out"), strict=True):
            span = a.max() - a.min()
            unit = (a - a.min()) / span if span else a * 0
            back = slow_blur(unit, 1.0)
            want = unit + np.where(unit < back - 1e-12, back.max() - back, 0) - (np.where(unit > back + 1e-12, back - back.min(), 0) if double else 0)
            assert np.allclose(g, want.clip(0, 1), atol=1e-9) or not span


def slow_median(a, radius):
    out = np.zeros(a.shape)
    for y, x in np.ndindex(*a.shape):
        out[y, x] = np.median([a[p, q] for p, q in np.ndindex(*a.shape) if (p - y) ** 2 + (q - x) ** 2 <= radius**2])
    return out


def otsu(a, bins=512):
    """Every bin centre tried."""
    counts, edges = np.histogram(a, bins)
    centre = (edges[:-1] + edges[1:]) / 2
    best, at = -1.0, None
    for k in range(bins - 1):
        low, high = counts[: k + 1], counts[k + 1 :]
        if low.sum() and high.sum():
            spread = low.sum() * high.sum() * ((low * centre[: k + 1]).sum() / low.sum() - (high * centre[k + 1 :]).sum() / high.sum()) ** 2
            if spread > best * (1 + 1e-12):
                best, at = spread, centre[k]
    return at


@pytest.mark.parametrize("tile", [9, 512])
def test_segmentations_equal_the_whole_image(spark, masks, tile):
    rng = np.random.default_rng(11)
    a = np.where(masks[0], 60, 10) + rng.random(masks[0].shape) * 9
    px = frame(spark, [a], keep=True)
    cut = images.segment_threshold(px, 35.0, speckle=1, min_distance=2, tile=tile)
    assert np.array_equal(grids_of(cut, [a.shape], "cell_id")[0], K.label_mask(K.erode(masks[0].astype(np.int8), 1), 0, 2))
    auto = images.segment_threshold(px, speckle=0, tile=tile)
    assert np.array_equal(grids_of(auto, [a.shape], "cell_id")[0], K.label_mask(a > otsu(a), 0, 2))
    local = images.segment_local(px, 2, 1.0, tile=tile)
    assert np.array_equal(grids_of(local, [a.shape], "cell_id")[0], K.label_mask(a > slow_median(a, 2) - 1.0, 0, 2))
    lo, hi = np.quantile(a, [0.02, 0.98])
    unit = ((a - lo) / (hi - lo)).clip(0, 1)
    seeds = K.local_maxima(unit, 2)
    cost = np.full(a.shape, np.inf)
    for s in seeds:
        cost[s] = 0
    inside = unit > otsu(unit)
    want = K.watershed(np.minimum(K.travel_time(unit + 1e-3, cost), 1e9), [s for s in seeds if inside[s]], inside)
    assert np.array_equal(grids_of(images.segment_cytosol(px, tile=tile), [a.shape], "cell_id")[0], want)


@pytest.mark.parametrize("tile", [3, 512])
def test_growth_and_refinement(spark, tile):
    rng = np.random.default_rng(12)
    a = np.kron(rng.integers(0, 3, (4, 5)), np.ones((3, 3), int)) * np.arange(1, 16).reshape(1, 15)
    px = frame(spark, [a])
    grown = grids_of(images.expand_nuclei(px, 2, tile=tile), [a.shape], "cell_id")[0]
    assert np.array_equal(grown, K.expand_labels(a.astype(np.int64), 2))
    near = lambda y, x: min((abs(p - y) + abs(q - x) for p, q in np.argwhere(a)), default=99)
    for y, x in np.ndindex(*a.shape):
        assert (grown[y, x] > 0) == (near(y, x) <= 2)
    fine = grids_of(images.refine_upscaled(px, 2, tile=tile), [(24, 30)], "cell_id")[0]
    big = np.kron(a, np.ones((2, 2))).astype(np.int64)
    assert set(np.unique(fine)) == set(np.unique(big)) and ((fine == big) | (fine == 0) | (big > 0)).all()


def test_small_tiles_are_worked_on_in_stacks(spark, masks):
    """A kernel isn't called for each small image, and images that span batches stay whole."""
    calls = spark.sparkContext.accumulator(0)

    def kernel(g):
        calls.add(1)
        return {"cell_id": K.label_mask(g["on"] > 0, 0, 2)}

    grids = [np.roll(m[:9, :9], k, 0) if k % 3 else m[:6, :7] for k in range(60) for m in masks[:2]]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "1000")
    try:
        px = foreground(spark, grids).withColumn("on", F.lit(1.0))
        got = grids_of(tiled.per_block(px, kernel, 0, ["image_id"], {"on": 0.0}, {"cell_id": "long"}, keep="cell_id"), [g.shape for g in grids], "cell_id")
    finally:
        spark.conf.set(conf, before)
    assert 0 < calls.value < len(grids) / 2
    for m, g in zip(grids, got, strict=True):
        assert np.array_equal(g, K.label_mask(m, 0, 2))


def test_otsu_reads_only_bins_with_values(spark):
    """No row for each of 512 bins of an image."""
    px = frame(spark, [np.arange(12.0).reshape(3, 4), np.full((2, 2), 7.0)], keep=True)
    out = labels.otsu_threshold(px, by=["image_id"])
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.image_id: r.threshold for r in out.collect()}
    assert got[0] == pytest.approx(otsu(np.arange(12.0))) and got[1] == 7.0

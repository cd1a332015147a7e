"""Crops of cells against plain loops."""

import numpy as np

from cellweave.operators import images
from tests.test_tiled import slow_blur


def filled(mask):
    """Background that can't be walked to from beyond the border is filled."""
    h, w = mask.shape
    seen, left = set(), [(-1, -1)]
    while left:
        y, x = left.pop()
        if (y, x) in seen or not (-1 <= y <= h and -1 <= x <= w) or (0 <= y < h and 0 <= x < w and mask[y, x]):
            continue
        seen.add((y, x))
        left += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return np.array([[(y, x) not in seen for x in range(w)] for y in range(h)])


def test_crops_equal_plain_loops(spark):
    rng = np.random.default_rng(6)
    side, rows, want = 10, [], {}
    for cell in range(3):
        own, value = rng.random((side, side)) < 0.6, rng.random((side, side)) * 50
        own[2:6, 2:6], own[3:5, 3:5] = True, False  # a hole
        keep = rng.random((side, side)) < 0.9  # missing pixels are 0
        rows += [(cell, int(y), int(x), int(own[y, x]), float(value[y, x])) for y, x in np.ndindex(side, side) if keep[y, x]]
        soft = slow_blur(filled(own & keep).astype(float), 1.0)
        want[cell] = soft, soft * np.where(keep, value, 0)
    crops = spark.createDataFrame(rows, "cell_id long, y int, x int, own int, value double")
    got = {(r.cell_id, r.y, r.x): (r.mask, r.value) for r in images.cell_crops(crops, side // 2).collect()}
    assert len(got) == 3 * side * side
    for (cell, y, x), (mask, value) in got.items():
        assert np.isclose(mask, want[cell][0][y, x]) and np.isclose(value, want[cell][1][y, x])

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import rings


def brute(grid):
    """Rings of each label by walking along pixel sides, one after another: {(label, sorted corners as a cycle)}."""
    h, w = grid.shape
    at = lambda y, x: grid[y, x] if 0 <= y < h and 0 <= x < w else 0
    side, step = [(-1, 0), (0, 1), (1, 0), (0, -1)], [(0, 1), (1, 0), (0, -1), (-1, 0)]
    left = {(y, x, d) for y in range(h) for x in range(w) for d in range(4) if grid[y, x] and at(y + side[d][0], x + side[d][1]) != grid[y, x]}
    out = []
    while left:
        start = now = min(left)
        label, corners, n, twice = grid[start[0], start[1]], [], 0, 0
        while True:
            left.discard(now)
            y, x, d = now
            ey, ex = [(y, x + 1), (y + 1, x + 1), (y + 1, x), (y, x)][d]
            sy, sx = step[d]
            twice += (ex - sx) * ey - ex * (ey - sy)
            n += 1
            ahead, corner = (y + sy, x + sx), (y + sy + side[d][0], x + sx + side[d][1])
            if at(*ahead) != label:
                now = (y, x, (d + 1) % 4)
            elif at(*corner) != label:
                now = (*ahead, d)
            else:
                now = (*corner, (d + 3) % 4)
            if now[2] != d:
                corners.append((ey, ex))
            if now == start:
                break
        k = corners.index(min(corners))
        out.append((int(label), n, twice // 2, tuple(corners[k:] + corners[:k])))
    return sorted(out)


def got(spark, grid, tile):
    mask = spark.createDataFrame([(int(y), int(x), int(grid[y, x])) for y, x in np.ndindex(*grid.shape)], "y int, x int, cell_id long")
    outline = rings.outlines(mask, tile=tile).cache()
    by = defaultdict(list)
    for r in rings.corners(outline).collect():
        by[r.cell_id, r.ring].append((r.place, (r.y, r.x)))
    out = []
    for m in rings.ring_measures(outline).collect():
        assert m.hole == (m.area < 0) and m.n_corners == len(by[m.cell_id, m.ring])
        corners = [c for _, c in sorted(by[m.cell_id, m.ring])]
        k = corners.index(min(corners))
        out.append((m.cell_id, m.n_edges, m.area, tuple(corners[k:] + corners[:k])))
    for p in rings.polygons(outline).collect():
        assert [(q.y, q.x) for q in p.points] == [c for _, c in sorted(by[p.cell_id, p.ring])]
    outline.unpersist()
    return sorted(out)


@pytest.mark.parametrize(("seed", "tile"), [(0, 4), (1, 16), (2, 1), (3, 512)])
def test_random_masks(spark, seed, tile):
    rng = np.random.default_rng(seed)
    grid = np.kron(rng.integers(0, 3, (7, 6)), np.ones((3, 3), int)) * (rng.random((21, 18)) > 0.15)
    out = got(spark, grid, tile)
    assert out == brute(grid)
    area = Counter()
    for label, _, a, _ in out:
        area[label] += a
    assert area == {k: int((grid == k).sum()) for k in (1, 2)}


def test_holes_corners_and_large_labels(spark):
    grid = np.zeros((40, 40), int)
    grid[2:38, 2:38] = 3
    grid[5:20, 5:20] = 0
    grid[8:12, 8:12] = (1 << 44) - 1
    grid[20, 20] = 0  # a corner joins this pixel to the hole: cells are joined by sides, and so what lies around them by corners too
    grid[30, 30] = 0
    out = got(spark, grid, 8)
    assert out == brute(grid)
    assert sorted(a for label, _, a, _ in out if label == 3) == [-226, -1, 36 * 36]


def test_a_mask_without_cells(spark):
    mask = spark.createDataFrame([(0, 0, 0)], "y int, x int, cell_id long")
    outline = rings.outlines(mask)
    assert outline.count() == 0 and rings.ring_measures(outline).count() == 0


def test_shapes_for_cutting(spark, tmp_path):
    grid = np.zeros((9, 9), int)
    grid[1:4, 1:5], grid[5:8, 5:8] = 1, 2
    grid[6, 6] = 0
    mask = spark.createDataFrame([(int(y), int(x), int(grid[y, x])) for y, x in np.ndindex(9, 9)], "y int, x int, cell_id long")
    shapes = rings.polygons(rings.outlines(mask))
    sets = spark.createDataFrame([("a", "A1", 1), ("b", "B1", 1), ("b", "B1", 2), ("b", "B1", 2), ("c", "C1", 9)], "name string, well string, cell_id long")
    cut = rings.cutting_shapes(shapes, sets, 10)
    rows = {(r.Name, r.cell_id): r for r in cut.collect()}
    assert set(rows) == {("a", 1), ("b", 1), ("b", 2)} and rows["b", 2].CapID == "B1"
    assert {(p.X, p.Y) for p in rows["a", 1].Point} == {(10, 10), (50, 10), (50, 40), (10, 40)}
    rings.write_cutting_xml(cut, f"{tmp_path}/xml")
    back = spark.read.format("xml").option("rowTag", "Shape").load(f"{tmp_path}/xml")
    assert back.count() == 3 and back.agg(F.sum("PointCount")).first()[0] == 12


def test_rings_of_one_tile_are_not_doubled_over_tables(spark, monkeypatch):
    """Only edges of rings that cross a tile's border go through the rounds."""
    seen, doubled = [], rings.rings
    monkeypatch.setattr(rings, "rings", lambda sides, by=(): seen.append(sides.count()) or doubled(sides, by))
    grid = np.zeros((16, 16), int)
    grid[1:4, 1:6], grid[6:10, 2:5], grid[12, 12] = 1, 2, 3
    assert got(spark, grid, 16) == brute(grid) and not seen
    assert got(spark, grid, 8) == brute(grid) and seen == [14]

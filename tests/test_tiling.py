import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.functions import kernels as K
from cellweave.operators import tiling


def test_plan_covers_image(spark):
    plan = tiling.shard_plan(spark, 100, 70, 900, 4).collect()
    assert {(y, x) for r in plan for y in range(r["y0"], r["y1"]) for x in range(r["x0"], r["x1"])} == {(y, x) for y in range(100) for x in range(70)}


def test_tile_plan_of_small_image(spark):
    assert tiling.tile_plan(spark, 3, 3, 64).count() == 1


def test_plan_json_round_trip(spark):
    """Steps are kept. The format of a stored plan."""
    plan = spark.createDataFrame([(17, 50, 175, 25, 225, None, 5)], "id int, y0 int, y1 int, x0 int, x1 int, ys int, xs int")
    text = tiling.plan_to_json(plan)
    assert text.first()["json"] == '{"id":17,"window":{"y":{"start":50,"stop":175,"step":null},"x":{"start":25,"stop":225,"step":5}}}'
    assert tiling.plan_from_json(text.select("json")).select(*plan.columns).collect() == plan.collect()
    bare = plan.drop("ys", "xs")
    assert tiling.plan_from_json(tiling.plan_to_json(bare)).where("ys is null and xs is null").select(*bare.columns).collect() == bare.collect()


def test_wide_halo_is_refused(spark):
    with pytest.raises(ValueError):
        tiling.with_halo(spark.createDataFrame([(0, 0, 1.0)], "y int, x int, value double"), 2, 3)


def shard_rows(shard, window, cells):
    y0, y1, x0, x1 = window
    out = []
    for y in range(y0, y1):
        for x in range(x0, x1):
            out.append((0, shard, y0, y1, x0, x1, y, x, next((i for i, pts in cells.items() if (y, x) in pts), 0)))
    return out


def fold(pdf):
    """Brute force: shards folded in order over a whole image; the state is the label at each pixel."""
    state: dict[tuple[int, int], int] = {}
    shift = 0
    for _, rows in pdf.sort_values("shard").groupby("shard", sort=True):
        y0, y1, x0, x1 = (int(rows[c].iloc[0]) for c in ("y0", "y1", "x0", "x1"))
        on_edge = lambda p: p[0] in (y0, y1 - 1) or p[1] in (x0, x1 - 1)  # noqa: B023, E731
        new = {(y, x): i + shift for y, x, i in zip(rows["y"], rows["x"], rows["cell_id"], strict=True) if i}
        cut = {i for p, i in new.items() if on_edge(p)}
        new = {p: i for p, i in new.items() if i not in cut}
        old = {p: i for p, i in state.items() if y0 <= p[0] < y1 and x0 <= p[1] < x1}
        old_cut = {i for p, i in old.items() if on_edge(p)}
        discard = {old[p] for p in new if p in old} - old_cut
        old = {p: i for p, i in old.items() if i not in discard}
        problem = {i for p, i in new.items() if p in old}
        result = old | {p: i for p, i in new.items() if i not in problem}
        state = {p: i for p, i in state.items() if not (y0 <= p[0] < y1 and x0 <= p[1] < x1)} | result
        shift = max([shift, *result.values()])
    return pd.DataFrame([(y, x, i) for (y, x), i in state.items()], columns=["y", "x", "cell_id"])


def random_shards(seed):
    """Six overlapping shards of one image, each labelled on its own: cells of one to nine pixels, some at borders, some seen twice."""
    rng = np.random.default_rng(seed)
    cells, rows = [], []
    for _ in range(60):
        y, x, h, w = rng.integers(0, 24), rng.integers(0, 36), rng.integers(1, 4), rng.integers(1, 4)
        cells.append({(y + a, x + b) for a in range(h) for b in range(w)})
    for shard, window in enumerate([(r, r + 14, c, c + 16) for r in (0, 10) for c in (0, 10, 20)]):
        y0, y1, x0, x1 = window
        labels = {}
        for k in rng.permutation(len(cells)):
            if rng.random() < 0.8:
                moved = {(y + rng.integers(0, 2), x) for y, x in cells[k]} if rng.random() < 0.3 else cells[k]
                mine = {p for p in moved if y0 <= p[0] < y1 and x0 <= p[1] < x1 and p not in labels}
                labels |= {p: int(k) + 1 for p in mine}
        rows += [(seed, shard, *window, int(y), int(x), i) for (y, x), i in labels.items()]
    return rows


def test_merge_against_folding(spark):
    rows = [r for seed in range(12) for r in random_shards(seed)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in tiling.merge_shards(table).collect())
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    want = [(seed, *r) for seed, part in frame.groupby("image_id") for r in fold(part).itertuples(index=False, name=None)]
    assert got == sorted(want)


def test_segmentation_by_shards(spark):
    """Shards segmented on their own and merged: each blob inside some shard once, as the whole image has it; one shard is the image without cells at its border."""
    image = np.zeros((40, 40))
    for y, x in [(5, 5), (5, 18), (18, 20), (30, 8), (33, 33), (20, 34), (0, 30)]:
        image[y : y + 3, x : x + 4] = 1
    px = spark.createDataFrame([(7, y, x, float(image[y, x])) for y in range(40) for x in range(40)], "image_id long, y int, x int, value double")
    for plan in (tiling.shard_plan(spark, 40, 40, 400, 6), tiling.shard_plan(spark, 40, 40, 1600, 0)):
        got = {}
        for r in tiling.merge_shards(tiling.segment_shards(px, plan, lambda a: K.label_mask(a > 0))).collect():
            got.setdefault(r["cell_id"], set()).add((r["y"], r["x"]))
        assert sorted(map(sorted, got.values())) == sorted(sorted((a, b) for a in range(y, y + 3) for b in range(x, x + 4)) for y, x in [(5, 5), (5, 18), (18, 20), (30, 8), (33, 33), (20, 34)])


SCHEMA = "image_id long, shard int, y0 int, y1 int, x0 int, x1 int, y int, x int, cell_id long"


def test_two_shards(spark):
    """The overlap holds a cell that both see: the later shard's stays, once."""
    both = {(2, 5), (2, 6)}
    rows = shard_rows(0, (0, 6, 0, 9), {1: {(2, 2)}, 2: both}) + shard_rows(1, (0, 6, 3, 12), {1: both, 2: {(3, 9)}})
    got = {(r["y"], r["x"]): r["cell_id"] for r in tiling.merge_shards(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(2, 2), (3, 9)} | both
    assert len({got[p] for p in both}) == 1 and len(set(got.values())) == 3


def test_one_shard_is_the_shard_without_edges(spark):
    rows = shard_rows(0, (0, 5, 0, 5), {1: {(2, 2)}, 2: {(0, 1), (1, 1)}})
    got = {(r["y"], r["x"]): r["cell_id"] for r in tiling.merge_shards(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, 2): 1}


def test_halo_makes_tiles_exact(spark):
    a = np.random.default_rng(0).random((23, 31))
    px = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(23) for x in range(31)], "y int, x int, value double")
    got = np.zeros_like(a)
    for r in tiling.per_tile(px, 8, 2, lambda g: K.dilate(g, 2)).collect():
        got[r["y"], r["x"]] = r["out"]
    assert np.array_equal(got, K.dilate(a, 2))


def test_with_shards_matches_windows(spark):
    px = spark.range(40 * 30).select((F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"))
    plan = tiling.shard_plan(spark, 40, 30, 100, 3)
    got = tiling.with_shards(px, plan).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in got} == {r["id"]: (r["y1"] - r["y0"]) * (r["x1"] - r["x0"]) for r in plan.collect()}

import pytest

from cellweave.operators import features


def cell(spark):
    rows = []
    for y in range(4):
        for x in range(4):
            cyt, nuc = y in (1, 2) and x in (1, 2), (y, x) == (1, 1)
            rows.append((1, y, x, nuc, cyt, 10.0 if nuc else 1.0 if cyt else 0.0))
    return spark.createDataFrame(rows, "cell_id long, y int, x int, nucleus boolean, cytosol boolean, dna double")


def test_statistics(spark):
    r = features.cell_statistics(cell(spark), ["nucleus", "cytosol"], ["dna"]).first()
    assert [r[f"dna_summed_intensity_{m}"] for m in ("nucleus", "cytosol", "cytosol_only")] == [10, 13, 3]
    assert [r[f"dna_summed_intensity_area_normalized_{m}"] for m in ("nucleus", "cytosol", "cytosol_only")] == pytest.approx([10, 3.25, 1])
    assert r["dna_mean_nucleus"] - r["dna_mean_cytosol"] > 1


def test_names_match_columns(spark):
    got = features.cell_statistics(cell(spark), ["nucleus", "cytosol"], ["dna"]).columns
    assert got[1:] == features.feature_names(["nucleus", "cytosol", "cytosol_only"], ["dna"])


def test_empty_mask_gives_null_means_and_zero_sums(spark):
    rows = spark.createDataFrame([(1, False, False, 5.0)], "cell_id long, nucleus boolean, cytosol boolean, dna double")
    r = features.cell_statistics(rows, ["nucleus", "cytosol"], ["dna"]).first()
    assert r["nucleus_area"] == 0 and r["dna_mean_nucleus"] is None and r["dna_summed_intensity_nucleus"] == 0


def test_tile_range_join_is_exact(spark):
    px = spark.createDataFrame([(y, x, y * 100 + x) for y in range(20) for x in range(20)], "y int, x int, value int")
    centers = spark.createDataFrame([(1, 5, 5), (2, 10, 13), (3, 0, 19)], "cell_id long, cy int, cx int")
    got = {(r["cell_id"], r["y"], r["x"]) for r in features.tile_range_join(px, centers, 3).collect()}
    want = {(i, y, x) for i, cy, cx in ((1, 5, 5), (2, 10, 13), (3, 0, 19)) for y in range(20) for x in range(20) if cy - 3 <= y < cy + 3 and cx - 3 <= x < cx + 3}
    assert got == want


def test_unknown_id_fails(spark):
    table = spark.createDataFrame([(1, 2)], "cell_id long, n int")
    ids = spark.createDataFrame([(1, 0), (9, 1)], "cell_id long, position int")
    with pytest.raises(Exception, match="unknown id"):
        features.lookup(table, ids).collect()

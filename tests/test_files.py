import numpy as np
import pytest

from cellweave.sources import files


def test_tiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    for name, a in {"ch01.tif": rng.integers(0, 255, (7, 9)).astype(np.uint8), "ch02.tif": rng.integers(0, 65535, (7, 9)).astype(np.uint16)}.items():
        (tmp_path / name).write_bytes(files.write_tiff(a))
        assert np.array_equal(files.read_tiff(files.write_tiff(a)), a)
        got = files.pixels_from_tiffs(spark, [str(tmp_path / name)]).collect()
        assert {(r["y"], r["x"]): r["value"] for r in got} == {(y, x): int(a[y, x]) * (255 if a.itemsize == 1 else 1) for y in range(7) for x in range(9)}
        assert files.pixels_from_tiffs(spark, [str(tmp_path / name)], (0, -1)).count() == 6 * 8
    assert files.channel_name("/x/plate7/img_12_a.tif") == "12"
    with pytest.raises(ValueError):
        files.read_tiff(b"II*\x00nothing")


def test_tiffs_from_pixels(spark):
    a = np.arange(12, dtype=np.uint16).reshape(3, 4) * 5000
    px = spark.createDataFrame([(1, y, x, int(a[y, x])) for y in range(3) for x in range(4)], "image_id long, y int, x int, value int")
    assert np.array_equal(files.read_tiff(bytes(files.tiffs_from_pixels(px).first()["content"])), a)


def test_directory_scan_and_manifest(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "root" / "a"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "root" / "b" / "c"))
    assert files.files_below(spark, str(tmp_path / "root"), 1).count() == 1
    assert files.files_below(spark, str(tmp_path / "root"), 2).count() == 2
    files.write_manifest(spark.createDataFrame([("dna", "a.tif")], "channel string, path string").coalesce(1), str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "image").load(str(tmp_path / "xml")).first()["channel"] == "dna"

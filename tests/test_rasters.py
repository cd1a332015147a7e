import gzip
import json
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from cellweave.sources import files, rasters


def table(a, crop=(slice(None), slice(None))):
    y, x = np.indices(a.shape)
    return {(int(p), int(q)): int(v) for p, q, v in zip(y[crop].ravel(), x[crop].ravel(), a[crop].ravel(), strict=True)}


def as_table(df):
    return {(r.y, r.x): r.value for r in df.collect()}


def tiled_tiff(a, side):
    """A big-endian TIFF of tiles, padded at the ends."""
    h, w = a.shape
    tiles = [np.pad(a, ((0, side), (0, side)))[y : y + side, x : x + side].astype(">u2").tobytes() for y in range(0, h, side) for x in range(0, w, side)]
    fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16]), (259, 3, [1]), (277, 3, [1]), (322, 3, [side]), (323, 3, [side]), (324, 4, None), (325, 4, [len(t) for t in tiles])]
    start = 8 + 2 + 12 * len(fields) + 4
    lists = start + 8 * len(tiles)
    places = [lists + sum(len(t) for t in tiles[:k]) for k in range(len(tiles))]
    head = struct.pack(">2sHIH", b"MM", 42, 8, len(fields))
    for tag, kind, values in fields:
        values = places if values is None else values
        if len(values) == 1:
            head += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", values[0], 0) if kind == 3 else struct.pack(">I", values[0]))
        else:
            head += struct.pack(">HHII", tag, kind, len(values), start + 4 * len(tiles) * (tag == 325))
    return head + struct.pack(">I", 0) + struct.pack(f">{len(tiles)}I", *places) + struct.pack(f">{len(tiles)}I", *[len(t) for t in tiles]) + b"".join(tiles)


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(5).integers(0, 65535, (37, 29)).astype(np.uint16)


def test_strips_tiles_and_bits(spark, tmp_path, image):
    small = (image % 200).astype(np.uint8)
    for name, content, want in (("a1.tif", files.write_tiff(image), image), ("b2.TIFF", tiled_tiff(image, 16), image), ("c3.tif", files.write_tiff(small), small.astype(int) * 255)):
        (tmp_path / name).write_bytes(content)
        assert as_table(rasters.load_tiffs(spark, str(tmp_path / name), ((None, None), (None, None)))) == table(want)
        assert as_table(rasters.load_tiffs(spark, str(tmp_path / name))) == table(want, (slice(0, -1), slice(0, -1)))
        assert as_table(rasters.load_tiffs(spark, str(tmp_path / name), ((3, 9), (-5, None)))) == table(want, (slice(3, 9), slice(-5, None)))
    got = rasters.load_tiffs(spark, str(tmp_path)).groupBy("channel").count()
    assert {r.channel: r["count"] for r in got.collect()} == {"1": 36 * 28, "2": 36 * 28, "3": 36 * 28}
    two = rasters.load_tiffs(spark, [str(tmp_path / "a1.tif"), str(tmp_path / "c3.tif")]).where("channel in ('1', '2') and y = 4")
    assert as_table(two) == table(image, (slice(4, 5), slice(0, -1)))


def test_written_files_come_back(spark, tmp_path, image):
    px = [(k, int(y), int(x), int(image[y, x]) // k) for k in (1, 2) for y in range(37) for x in range(29) if (y, x) != (5, 6)]
    df = spark.createDataFrame(px, "image_id long, y int, x int, value int").repartition(6)
    for rows in (4, 100):
        folder = f"{tmp_path}/out{rows}"
        made = {r.image_id: r for r in rasters.write_tiffs(df, folder, rows_per_strip=rows).collect()}
        assert {(r.height, r.width) for r in made.values()} == {(37, 29)}
        want = image.copy()
        want[5, 6] = 0
        for k in (1, 2):
            assert as_table(rasters.load_tiffs(spark, made[k].path, ((None, None), (None, None)))) == table(want // k)
    assert rasters.write_tiffs(df.where("false"), f"{tmp_path}/none").count() == 0


def test_an_image_is_dealt_by_sections(spark, tmp_path, image, monkeypatch):
    """Sections of four rows go to many tasks, not an image to one; rows without pixels are 0, and a small image has its own file at once."""
    monkeypatch.setattr(rasters, "SECTION_PIXELS", 4 * 29)
    monkeypatch.setattr(rasters, "TASK_PIXELS", 100)
    px = [(1, y, x, int(image[y, x])) for y in range(37) for x in range(29) if y < 3 or y > 20] + [(2, 0, 0, 7)]
    made = rasters.write_tiffs(spark.createDataFrame(px, "image_id long, y int, x int, value int").repartition(3), str(tmp_path), rows_per_strip=5)
    assert re.search(rf"hashpartitioning\(name#\d+, section#\d+, {1 + len(px) // 100}\)", made._jdf.queryExecution().executedPlan().toString())
    want = image.copy()
    want[3:21] = 0
    for _ in range(2):  # the second time, all sections are gone
        assert {(r.image_id, r.height, r.width) for r in made.collect()} == {(1, 37, 29), (2, 1, 1)}
        assert sorted(p.name for p in tmp_path.iterdir()) == ["1.tif", "2.tif"]
        assert as_table(rasters.load_tiffs(spark, f"{tmp_path}/1.tif", ((None, None), (None, None)))) == table(want)
        assert as_table(rasters.load_tiffs(spark, f"{tmp_path}/2.tif", ((None, None), (None, None)))) == {(0, 0): 7}
    with pytest.raises(FileNotFoundError):
        rasters._join_sections(f"{tmp_path}/3.tif", 8, 29, 5, 4, [(0, f"{tmp_path}/3.part")])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.tif", "2.tif"]


def read_blocks(reader, monkeypatch, kind, name):
    """How many blocks a reader opens over all its partitions, and its rows."""
    seen, own = [], getattr(kind, name)
    monkeypatch.setattr(kind, name, lambda self, *a: seen.append(a[-1]) or own(self, *a))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.setattr(kind, name, own)
    return len(seen), rows


def test_a_window_reads_fewer_strips(spark, tmp_path, image, monkeypatch):
    px = spark.createDataFrame([(1, y, x, int(image[y, x])) for y in range(37) for x in range(29)], "image_id long, y int, x int, value int")
    path = rasters.write_tiffs(px, str(tmp_path), rows_per_strip=4).first().path
    reader = rasters.TiffReader({"path": path})
    assert read_blocks(reader, monkeypatch, rasters.TiffLayout, "block")[0] == 10
    kept = list(reader.pushFilters([ds.GreaterThanOrEqual(("y",), 9), ds.LessThan(("y",), 13), ds.EqualTo(("x",), 3)]))
    assert len(kept) == 3  # Spark still checks them
    n, rows = read_blocks(reader, monkeypatch, rasters.TiffLayout, "block")
    assert n == 2 and {(r["y"], r["x"]): r["value"] for r in rows} == {(y, 3): int(image[y, 3]) for y in range(9, 13)}
    other = rasters.TiffReader({"path": path})
    list(other.pushFilters([ds.In(("channel",), ("7", "8"))]))
    assert read_blocks(other, monkeypatch, rasters.TiffLayout, "block") == (0, [])
    plan = rasters.load_tiffs(spark, path).where("y >= 9 and y < 13 and x = 3")
    assert plan.count() == 4


def test_large_files_are_shared_and_small_ones_bunched(tmp_path, image):
    for k in range(5):
        (tmp_path / f"{k}.tif").write_bytes(tiled_tiff(image, 16))
    one = rasters.TiffReader({"path": str(tmp_path / "0.tif"), "taskBytes": "1000"})
    assert len(one.partitions()) > 3
    rows = [r for p in one.partitions() for b in one.read(p) for r in b.to_pylist()]
    assert {(r["y"], r["x"]): r["value"] for r in rows} == table(image) and len(rows) == image.size
    assert len(rasters.TiffReader({"path": str(tmp_path)}).partitions()) == 1


def test_bad_files(spark, tmp_path):
    (tmp_path / "cut.tif").write_bytes(files.write_tiff(np.zeros((9, 9), np.uint16))[:100])
    (tmp_path / "no.tif").write_bytes(b"II*\x00nothing")
    for name in ("cut.tif", "no.tif"):
        with pytest.raises(Exception, match="cut file|not a TIFF"):
            rasters.load_tiffs(spark, str(tmp_path / name)).count()
    with pytest.raises(Exception, match="missing|NotFound|FileNotFound"):
        rasters.load_tiffs(spark, str(tmp_path / "missing")).count()
    (tmp_path / "empty").mkdir()
    assert rasters.load_tiffs(spark, str(tmp_path / "empty")).count() == 0


def group(path, a, chunks, codec, separator=".", omero=True, skip=(), fill=0):
    """An OME-Zarr group written plainly."""
    packed = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": lambda b: __import__("zstandard").ZstdCompressor().compress(b)}[codec]
    (path / "0").mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": codec and {"id": codec}, "fill_value": fill, "order": "C", "filters": None, "dimension_separator": separator}
    (path / "0" / ".zarray").write_text(json.dumps(meta))
    attrs = {"multiscales": [{"datasets": [{"path": "0"}]}]} | ({"omero": {"channels": [{"label": n} for n in ("dna", "actin", "er")]}} if omero else {})
    (path / ".zattrs").write_text(json.dumps(attrs))
    for place in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunks, strict=True)]):
        if place in skip:
            continue
        block = np.full(chunks, fill, a.dtype)
        part = a[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        file = path / "0" / separator.join(map(str, place))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(packed(block.tobytes()))


@pytest.mark.parametrize(("codec", "separator", "chunks"), [(None, ".", (1, 10, 10)), ("zlib", "/", (2, 16, 7)), ("gzip", ".", (3, 37, 29)), ("zstd", "/", (1, 50, 8))])
def test_zarr_groups(spark, tmp_path, image, codec, separator, chunks):
    a = np.stack([image, image // 2, image // 3]).astype(">u2")
    group(tmp_path / "g", a, chunks, codec, separator)
    got = rasters.load_omezarr(spark, str(tmp_path / "g")).collect()
    assert {(r.c, r.channel) for r in got} == {(0, "dna"), (1, "actin"), (2, "er")}
    assert {(r.c, r.y, r.x): r.value for r in got} == {(c, y, x): int(a[c, y, x]) for c, y, x in np.ndindex(*a.shape)} and len(got) == a.size
    turned = rasters.load_omezarr(spark, str(tmp_path / "g"), remap=[2, 0])
    assert {(r.c, r.channel) for r in turned.select("c", "channel").distinct().collect()} == {(0, "er"), (1, "dna")}


def test_missing_chunks_and_pruned_ones(spark, tmp_path, image, monkeypatch):
    a = np.stack([image, image // 2, image // 3])
    group(tmp_path / "g", a, (1, 10, 10), "zlib", skip={(0, 1, 1), (2, 3, 2)}, fill=7)
    want = a.copy()
    want[0, 10:20, 10:20] = 7
    want[2, 30:, 20:] = 7
    got = rasters.load_omezarr(spark, str(tmp_path / "g"))
    assert {(r.c, r.y, r.x): r.value for r in got.collect()} == {(c, y, x): int(want[c, y, x]) for c, y, x in np.ndindex(*a.shape)}
    reader = rasters.ZarrReader({"path": str(tmp_path / "g"), "taskBytes": "1"})
    assert read_blocks(reader, monkeypatch, rasters.ZarrGroup, "load")[0] == 3 * 4 * 3
    list(reader.pushFilters([ds.GreaterThan(("y",), 9), ds.LessThanOrEqual(("y",), 20), ds.LessThan(("x",), 10), ds.EqualTo(("channel",), "actin")]))
    n, rows = read_blocks(reader, monkeypatch, rasters.ZarrGroup, "load")
    assert n == 2 and len(rows) == 11 * 10 and len(reader.partitions()) == 2


def test_flat_arrays_and_refused_ones(spark, tmp_path, image):
    group(tmp_path / "flat", image, (8, 8), None, omero=False)
    got = rasters.load_omezarr(spark, str(tmp_path / "flat"))
    assert as_table(got) == table(image) and got.select("channel").distinct().collect()[0][0] == "channel_0"
    for name, change in (("codec", {"compressor": {"id": "blosc"}}), ("kind", {"dtype": "<f4"}), ("order", {"order": "F"})):
        group(tmp_path / name, image, (8, 8), None, omero=False)
        at = tmp_path / name / "0" / ".zarray"
        at.write_text(json.dumps(json.loads(at.read_text()) | change))
        with pytest.raises(ValueError):
            rasters.ZarrGroup(str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        rasters.ZarrGroup(str(tmp_path / "nothing"))


def test_written_groups_leave_out_empty_chunks(spark, tmp_path, image):
    kept = np.where(np.indices(image.shape)[0] < 10, image, 0)
    px = spark.createDataFrame([(c, y, x, int(kept[y, x])) for c in (0, 1) for y in range(37) for x in range(29)], "c int, y int, x int, value int")
    n = rasters.write_omezarr(px, f"{tmp_path}/g", ["a", "b"], 37, 29, (10, 10))
    assert n == 2 * 3
    got = rasters.load_omezarr(spark, f"{tmp_path}/g").where(F.col("channel") == "b")
    assert as_table(got) == table(kept)

"""Image files as Spark data sources: TIFF files by strips and tiles, OME-Zarr groups by chunks.

`register(spark)` adds the formats `tiff_pixels` and `omezarr_pixels`. Both give a row per pixel and plan their reads
from what is asked: bounds on y and x and lists of channels are pushed down to the strips, tiles or chunks that can hold
such pixels, in the tasks for TIFF (only they open files) and in the plan for Zarr (whose grid is known without files).
Files are opened by Arrow's file systems, so paths are local or URIs that those know.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby, islice, pairwise
from math import prod
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from ..operators.graphs import _cut
from .files import BITS, COMPRESSION, COUNTS, FORMAT, HEIGHT, OFFSETS, PHOTOMETRIC, ROWS, SAMPLES, WIDTH, channel_name

# TIFF tags of tiled files, and the sizes and codes of its field types.
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
#: Bytes of files, or of unpacked chunks, that a task reads; a larger file is shared by several tasks.
TASK_BYTES = 32 << 20
#: Pixels of a section of an image, and of a task that writes sections on average.
SECTION_PIXELS, TASK_PIXELS = 1 << 17, 1 << 20


def open_fs(uri: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(uri)


def _read_at(file: pa.NativeFile, at: int, n: int) -> bytes:
    file.seek(at)
    got = file.read(n)
    if len(got) < n:
        raise ValueError("a cut file")
    return got


@dataclass
class Asked:
    """Bounds and channels that filters leave; a block is read if it can hold such pixels."""

    low: dict[str, int] = field(default_factory=lambda: {"y": 0, "x": 0})
    high: dict[str, int] = field(default_factory=lambda: {"y": 1 << 62, "x": 1 << 62})
    channels: set[str] | None = None
    numbers: set[int] | None = None

    def add(self, f: ds.Filter) -> None:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name in ("y", "x"):
            if isinstance(f, ds.EqualTo):
                self.narrow(name, f.value, f.value + 1)
            elif isinstance(f, ds.GreaterThanOrEqual | ds.GreaterThan):
                self.narrow(name, f.value + isinstance(f, ds.GreaterThan), 1 << 62)
            elif isinstance(f, ds.LessThanOrEqual | ds.LessThan):
                self.narrow(name, 0, f.value + isinstance(f, ds.LessThanOrEqual))
        elif name in ("channel", "c") and isinstance(f, ds.EqualTo | ds.In):
            values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            old = self.channels if name == "channel" else self.numbers
            values = values if old is None else old & values
            if name == "channel":
                self.channels = values
            else:
                self.numbers = values

    def narrow(self, axis: str, low: int, high: int) -> None:
        self.low[axis], self.high[axis] = max(self.low[axis], low), min(self.high[axis], high)

    def channel(self, name: str, number: int | None = None) -> bool:
        return (self.channels is None or name in self.channels) and (self.numbers is None or number is None or number in self.numbers)

    def meets(self, y0: int, y1: int, x0: int, x1: int) -> bool:
        return y0 < self.high["y"] and y1 > self.low["y"] and x0 < self.high["x"] and x1 > self.low["x"]


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.asked = options, Asked()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Blocks are chosen by them; Spark still checks each row."""
        for f in filters:
            self.asked.add(f)
            yield f


def _pixels(head: dict[str, object], block: np.ndarray, y: int, x: int, box: tuple[int, int, int, int]) -> pa.RecordBatch:
    """Rows of the block at (y, x) that lie in the box; head: columns that are the same in all rows."""
    y0, y1, x0, x1 = max(box[0], y), min(box[1], y + block.shape[0]), max(box[2], x), min(box[3], x + block.shape[1])
    inside = block[y0 - y : y1 - y, x0 - x : x1 - x]
    n = inside.size
    ys, xs = np.repeat(np.arange(y0, y1, dtype=np.int32), x1 - x0), np.tile(np.arange(x0, x1, dtype=np.int32), y1 - y0)
    same = [pa.repeat(pa.scalar(v, pa.int32() if isinstance(v, int) else pa.string()), n) for v in head.values()]
    return pa.record_batch([*same, pa.array(ys), pa.array(xs), pa.array(inside.ravel().astype(np.int32))], [*head, "y", "x", "value"])


class TiffLayout:
    """Where the blocks of a file's first page lie: uncompressed grey images of 8 or 16 bits, in strips or tiles, also of files over 4 GB."""

    def __init__(self, file: pa.NativeFile) -> None:
        head = _read_at(file, 0, 8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(f"{self.order or '<'}H", head, 2)[0]
        if self.order is None or magic not in (42, 43):
            raise ValueError("not a TIFF file")
        self.wide = magic == 43
        tags = self._tags(file, struct.unpack(self.order + "Q", _read_at(file, 8, 8))[0] if self.wide else struct.unpack_from(self.order + "I", head, 4)[0])
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.height, self.width, self.bits = one(HEIGHT, 0), one(WIDTH, 0), one(BITS, 1)
        if one(COMPRESSION, 1) != 1 or one(SAMPLES, 1) != 1 or self.bits not in (8, 16):
            raise ValueError("only uncompressed grey TIFF files of 8 or 16 bits are read")
        tiled = TILE_OFFSETS in tags
        self.rows, self.columns = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, self.height), self.height), self.width)
        self.offsets, self.counts = tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS]
        self.across, self.tiled = -(-self.width // max(self.columns, 1)), tiled

    def _tags(self, file: pa.NativeFile, at: int) -> dict[int, tuple[int, ...]]:
        count, entry = ("Q", 20) if self.wide else ("H", 12)
        size = struct.calcsize(self.order + count)
        n = struct.unpack(self.order + count, _read_at(file, at, size))[0]
        data, tags = _read_at(file, at + size, n * entry), {}
        for k in range(n):
            tag, kind, many = struct.unpack_from(f"{self.order}HH{'Q' if self.wide else 'I'}", data, k * entry)
            if kind not in FIELDS:
                continue
            width, code = FIELDS[kind]
            room = 8 if self.wide else 4
            inline = data[(k + 1) * entry - room : (k + 1) * entry]
            raw = inline if many * width <= room else _read_at(file, struct.unpack(f"{self.order}{'Q' if self.wide else 'I'}", inline)[0], many * width)
            tags[tag] = struct.unpack_from(f"{self.order}{many}{code}", raw)
        return tags

    def place(self, k: int) -> tuple[int, int, int, int]:
        """y0, y1, x0, x1 of a block."""
        y, x = k // self.across * self.rows, k % self.across * self.columns
        return y, min(y + self.rows, self.height), x, min(x + self.columns, self.width)

    def block(self, file: pa.NativeFile, k: int) -> np.ndarray:
        y0, y1, x0, x1 = self.place(k)
        rows = self.rows if self.tiled else y1 - y0
        raw = np.frombuffer(_read_at(file, self.offsets[k], self.counts[k]), f"{self.order}u{self.bits // 8}")
        return raw[: rows * self.columns].reshape(rows, self.columns)[: y1 - y0, : x1 - x0]


@dataclass
class TiffShare(ds.InputPartition):
    """(path, part, parts): the part-th of equal shares of each file's blocks."""

    files: list[tuple[str, int, int]]


class TiffReader(_Reader):
    def partitions(self) -> Sequence[TiffShare]:
        """Whole small files together, large ones in shares; only names and sizes are looked at."""
        shares, bunch, held = [], [], 0
        limit = int(self.options.get("taskBytes", TASK_BYTES))
        for path, size in _listed(json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]], (".tif", ".tiff")):
            if not self.asked.channel(channel_name(path)):
                continue
            parts = -(-size // limit)
            if parts > 1:
                shares += [TiffShare([(path, k, parts)]) for k in range(parts)]
                continue
            bunch.append((path, 0, 1))
            held += size
            if held >= limit:
                shares.append(TiffShare(bunch))
                bunch, held = [], 0
        return [*shares, *([TiffShare(bunch)] if bunch else [])] or [TiffShare([])]

    def read(self, partition: TiffShare) -> Iterator[pa.RecordBatch]:
        crop = json.loads(self.options.get("crop", "[[null, null], [null, null]]"))
        for path, part, parts in partition.files:
            system, at = open_fs(path)
            with system.open_input_file(at) as file:
                layout = TiffLayout(file)
                (y0, y1, _), (x0, x1, _) = (slice(*c).indices(n) for c, n in zip(crop, (layout.height, layout.width), strict=True))
                box = (max(y0, self.asked.low["y"]), min(y1, self.asked.high["y"]), max(x0, self.asked.low["x"]), min(x1, self.asked.high["x"]))
                n = len(layout.offsets)
                for k in range(part * n // parts, (part + 1) * n // parts):
                    p0, p1, q0, q1 = layout.place(k)
                    if p0 < box[1] and p1 > box[0] and q0 < box[3] and q1 > box[2]:
                        values = layout.block(file, k).astype(np.int32) * (255 if layout.bits == 8 else 1)
                        yield _pixels({"path": path, "channel": channel_name(path)}, values, p0, q0, box)


def _listed(paths: list[str], endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of files, and of all files with these endings in folders, in order of their paths."""
    out = []
    for path in paths:
        system, at = open_fs(path)
        info = system.get_file_info(at)
        if info.type == afs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [i for i in system.get_file_info(afs.FileSelector(at, recursive=True)) if i.is_file and i.path.lower().endswith(endings)]
        root = path[: len(path) - len(at)] if path.endswith(at) else path.split("/", 1)[0] if "://" not in path and ":" in path else ""
        out += [(f"{root}{i.path}", i.size) for i in found]
    return sorted(out)


class TiffSource(ds.DataSource):
    """Options: path (a file or folder) or paths (a JSON list), crop (JSON: first and last row and column, as in slices), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pixels"

    def schema(self) -> str:
        return "path string, channel string, y int, x int, value int"

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


class ZarrGroup:
    """Metadata of an OME-Zarr group (format 2): one level's chunk grid, and channel names of `omero` or by number."""

    def __init__(self, uri: str, level: int = 0) -> None:
        self.uri = uri.rstrip("/")
        attrs = self._json(".zattrs") or {}
        scales = (attrs.get("multiscales") or [{}])[0]
        sets = scales.get("datasets") or [{"path": "0"}]
        self.array = sets[level]["path"]
        meta = self._json(f"{self.array}/.zarray")
        if meta is None:
            raise FileNotFoundError(f"{self.uri}/{self.array}/.zarray")
        self.shape, self.chunks = meta["shape"], meta["chunks"]
        self.dtype, self.fill = np.dtype(meta["dtype"]), meta.get("fill_value") or 0
        if self.dtype.kind not in "ui" or self.dtype.itemsize > 4 or meta.get("filters") or meta.get("order", "C") != "C":
            raise ValueError("only row-major arrays of whole numbers of at most 32 bits without filters are read")
        self.codec, self.join = (meta.get("compressor") or {}).get("id"), meta.get("dimension_separator", ".")
        if self.codec not in (None, "zlib", "gzip", "zstd"):
            raise ValueError(f"chunks packed by {self.codec} aren't read")
        axes = [a["name"] if isinstance(a, dict) else a for a in scales.get("axes") or []] or [*"tzcyx"][-len(self.shape) :]
        self.axis = {name: axes.index(name) if name in axes else None for name in "cyx"}
        if any(n > 1 for a, n in zip(axes, self.shape, strict=True) if a not in "cyx"):
            raise ValueError("only images of one time and one plane are read")
        said = (attrs.get("omero") or {}).get("channels")
        n = self.size("c")
        self.channels = [c["label"] for c in said] if said else [f"channel_{i}" for i in range(n)]
        if len(self.channels) != n:
            raise ValueError(f"{len(self.channels)} channel names for {n} channels")

    def _json(self, name: str) -> dict | None:
        system, at = open_fs(f"{self.uri}/{name}")
        if system.get_file_info(at).type == afs.FileType.NotFound:
            return None
        with system.open_input_file(at) as f:
            return json.loads(f.read())

    def size(self, axis: str) -> int:
        return 1 if self.axis[axis] is None else self.shape[self.axis[axis]]

    def step(self, axis: str) -> int:
        return 1 if self.axis[axis] is None else self.chunks[self.axis[axis]]

    def load(self, place: dict[str, int]) -> np.ndarray | None:
        """A chunk as (c, y, x), cut at the array's ends; None if there is no file."""
        at = [place[{v: k for k, v in self.axis.items()}[i]] if i in self.axis.values() else 0 for i in range(len(self.shape))]
        system, path = open_fs(f"{self.uri}/{self.array}/{self.join.join(map(str, at))}")
        if system.get_file_info(path).type == afs.FileType.NotFound:
            return None
        with system.open_input_file(path) as f:
            raw = f.read()
        if self.codec == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=prod(self.chunks) * self.dtype.itemsize)
        elif self.codec:
            raw = zlib.decompress(raw) if self.codec == "zlib" else gzip.decompress(raw)
        out = np.frombuffer(raw, self.dtype).reshape(self.chunks)
        order = [self.axis[k] for k in "cyx" if self.axis[k] is not None]
        out = np.moveaxis(out, order, range(len(order))).reshape([self.step(k) for k in "cyx"])
        return out[tuple(slice(0, min(self.step(k), self.size(k) - place[k] * self.step(k))) for k in "cyx")]


@dataclass
class ZarrShare(ds.InputPartition):
    chunks: list[tuple[int, int, int]]


class ZarrReader(_Reader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.group = ZarrGroup(options["path"], int(options.get("level", 0)))

    def partitions(self) -> Sequence[ZarrShare]:
        g, limit = self.group, int(self.options.get("taskBytes", TASK_BYTES))
        per = max(1, limit // (prod(g.chunks) * g.dtype.itemsize))
        steps = {k: g.step(k) for k in "cyx"}
        ends = {k: -(-g.size(k) // steps[k]) for k in "cyx"}
        rows, columns = ([i for i in range(ends[k]) if i * steps[k] < self.asked.high[k] and (i + 1) * steps[k] > self.asked.low[k]] for k in "yx")
        levels = [i for i in range(ends["c"]) if any(self.asked.channel(n, i * steps["c"] + j) for j, n in enumerate(g.channels[i * steps["c"] : (i + 1) * steps["c"]]))]
        asked = [(c, y, x) for c in levels for y in rows for x in columns]
        return [ZarrShare(asked[k : k + per]) for k in range(0, len(asked), per)] or [ZarrShare([])]

    def read(self, partition: ZarrShare) -> Iterator[pa.RecordBatch]:
        g = self.group
        box = (self.asked.low["y"], min(self.asked.high["y"], g.size("y")), self.asked.low["x"], min(self.asked.high["x"], g.size("x")))
        for c, y, x in partition.chunks:
            place = {"c": c, "y": y, "x": x}
            shape = [min(g.step(k), g.size(k) - place[k] * g.step(k)) for k in "cyx"]
            block = g.load(place)
            block = np.full(shape, g.fill) if block is None else block
            for i in range(shape[0]):
                number = c * g.step("c") + i
                if self.asked.channel(g.channels[number], number):
                    yield _pixels({"c": number, "channel": g.channels[number]}, block[i], y * g.step("y"), x * g.step("x"), box)


class ZarrSource(ds.DataSource):
    """Options: path (the group), level (of the pyramid, 0 is the full image), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "omezarr_pixels"

    def schema(self) -> str:
        return "c int, channel string, y int, x int, value int"

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Add both formats to the session, and let it push filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    spark.dataSource.register(ZarrSource)


def load_tiffs(spark: SparkSession, paths: Sequence[str] | str, crop: Sequence[tuple[int | None, int | None]] = ((0, -1), (0, -1))) -> DataFrame:
    """px(path, channel, y, x, value): a channel a file, named by the first number in its name; 8-bit values times 255.

    crop: first and last row and column, as in slices; by default the last of both are left out. None keeps all.
    """
    register(spark)
    reader = spark.read.format("tiff_pixels").option("crop", json.dumps(crop))
    return reader.load(paths) if isinstance(paths, str) else reader.option("paths", json.dumps(list(paths))).load()


def load_omezarr(spark: SparkSession, path: str, remap: Sequence[int] | None = None, level: int = 0) -> DataFrame:
    """px(c, channel, y, x, value) of a group. remap: the channels in their new order; those that it leaves out aren't read."""
    register(spark)
    px = spark.read.format("omezarr_pixels").option("level", level).load(path)
    if remap is None:
        return px
    new = F.create_map(*[F.lit(v) for k, old in enumerate(remap) for v in (old, k)])
    return px.where(F.col("c").isin(list(remap))).withColumn("c", new[F.col("c")].cast("int"))


def _head(height: int, width: int, rows: int) -> bytes:
    """What stands before the rows of a 16-bit file, which follow one another: its directory, and where its strips lie."""
    rows = min(rows, height)
    n = -(-height // rows)
    sizes = np.full(n, 2 * width * rows, "<u8")
    sizes[-1] = 2 * width * (height - (n - 1) * rows)
    fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [16]), (COMPRESSION, [1]), (PHOTOMETRIC, [1]), (OFFSETS, None), (SAMPLES, [1]), (ROWS, [rows]), (COUNTS, sizes), (FORMAT, [1])]
    after = 16 + 8 + 20 * len(fields) + 8  # lists follow the directory, strips follow them
    places = after + 16 * n * (n > 1) + np.cumsum(sizes) - sizes
    head = b"II" + struct.pack("<HHHQQ", 43, 8, 0, 16, len(fields))
    lists = {OFFSETS: places, COUNTS: sizes}
    for tag, values in fields:
        values = lists.get(tag, values)
        where = int(values[0]) if n == 1 or tag not in lists else after + 8 * n * (tag == COUNTS)
        head += struct.pack("<HHQQ", tag, 16 if tag in lists else 4 if tag in (WIDTH, HEIGHT, ROWS) else 3, len(values), where)
    return head + struct.pack("<Q", 0) + (places.astype("<u8").tobytes() + sizes.tobytes() if n > 1 else b"")


def _put(path: str, content: Iterable[bytes]) -> None:
    """A file written piece by piece, under a name of its own until it is whole."""
    system, at = open_fs(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            for piece in content:
                out.write(piece)
        system.move(part, at)
    except BaseException:
        if system.get_file_info(part).type != afs.FileType.NotFound:
            system.delete_file(part)
        raise


def _join_sections(path: str, height: int, width: int, rows: int, per: int, sections: list[tuple[int, str]]) -> None:
    """The file of an image from files of `per` rows each, which are deleted; sections without a file are 0.

    If some are gone, an earlier attempt has joined them: they go only after the whole file is in its place.
    """

    def content() -> Iterator[bytes]:
        yield _head(height, width, rows)
        at = 0
        for k, part in sections:
            for row in range(at, k * per, per):
                yield bytes(2 * width * min(per, k * per - row))
            system, place = open_fs(part)
            with system.open_input_file(place) as f:
                yield f.read()
            at = (k + 1) * per

    try:
        _put(path, content())
    except FileNotFoundError:
        system, at = open_fs(path)
        if system.get_file_info(at).type == afs.FileType.NotFound:
            raise
    for _, part in sections:
        system, at = open_fs(part)
        if system.get_file_info(at).type != afs.FileType.NotFound:
            system.delete_file(at)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 200)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))


def write_tiffs(px: DataFrame, folder: str, by: str = "image_id", rows_per_strip: int = 256) -> DataFrame:
    """px(by, y, x, value) to a 16-bit file for each image, folder/NAME.tif; (by, path, height, width), once they are written.

    Values are those of unsigned 16 bits; pixels that don't exist are 0. Images are dealt by sections of whole rows, some
    SECTION_PIXELS each or one row, which a task holds one at a time; pixels are packed for them, six bytes each, before
    they are dealt. Files of an image's sections are then copied one after another into its own. The images' sizes are
    worked out at once, and give the number of tasks.
    """
    size = _cut(px.groupBy(by).agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.count("*").alias("n")))
    tasks = 1 + (size.agg(F.sum("n")).first()[0] or 0) // TASK_PIXELS
    size = size.select(by, "height", "width", F.greatest(F.lit(1), F.expr(f"cast({SECTION_PIXELS} div width as int)")).alias("per"))
    columns = [F.col(by).cast("string").alias("name"), "height", "width", "per", F.expr("cast(y div per as int)").alias("section"), F.expr("cast(y % per * width + x as int)").alias("place"), F.col("value").cast("int").alias("value")]
    rows = px.select(by, "y", "x", "value").join(size, by).select(*columns)
    fields = [("name", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("per", pa.int32()), ("section", pa.int32())]
    runs, parts = pa.schema([*fields, ("places", pa.binary()), ("values", pa.binary())]), pa.schema([*fields, ("path", pa.string())])
    files = pa.schema([("name", pa.string()), ("path", pa.string()), ("height", pa.int32()), ("width", pa.int32())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The pixels of a batch that lie in the same section as one row."""
        for batch in batches:
            if not batch.num_rows:
                continue
            code, section, place, value = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0).dictionary_encode().indices, *(batch.column(k) for k in (4, 5, 6))))
            order = np.lexsort((section, code))
            code, section, place, value = code[order], section[order], place[order].astype("<i4"), value[order].astype("<u2")
            edges = np.flatnonzero((code[1:] != code[:-1]) | (section[1:] != section[:-1])) + 1
            for a, b in pairwise([0, *edges.tolist(), len(code)]):
                yield *(batch.column(k)[int(order[a])].as_py() for k in range(5)), place[a:b].tobytes(), value[a:b].tobytes()

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A file for each section; an image of one section has its own file at once."""
        key, block = None, None

        def done() -> tuple:
            name, height, width, per, section = key
            path = f"{folder}/{name}.tif"
            if per < height:
                path = f"{path}.{uuid.uuid4().hex}.part"
            _put(path, [block.tobytes()] if per < height else [_head(height, width, rows_per_strip), block.tobytes()])
            return *key, path

        for *here, places, values in _rows_of(batches):
            if here != key:
                if key is not None:
                    yield done()
                key, (_, height, width, per, k) = here, here
                block = np.zeros((min(per, height - k * per), width), "<u2")
            block.ravel()[np.frombuffer(places, "<i4")] = np.frombuffer(values, "<u2")
        if key is not None:
            yield done()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (name, height, width, per), own in groupby(_rows_of(batches), itemgetter(0, 1, 2, 3)):
            path = f"{folder}/{name}.tif"
            if per < height:
                _join_sections(path, height, width, rows_per_strip, per, [r[4:] for r in own])
            yield name, path, height, width

    of_section = "name string, height int, width int, per int, section int"
    dealt = rows.mapInArrow(lambda batches: _in_batches(packed(batches), runs), f"{of_section}, places binary, values binary").repartition(tasks, "name", "section").sortWithinPartitions("name", "section")
    written = dealt.mapInArrow(lambda batches: _in_batches(sections(batches), parts), f"{of_section}, path string")
    whole = written.repartition("name").sortWithinPartitions("name", "section").mapInArrow(lambda batches: _in_batches(joined(batches), files), "name string, path string, height int, width int")
    return whole.select(F.col("name").cast(px.schema[by].dataType).alias(by), "path", "height", "width")


def write_omezarr(px: DataFrame, path: str, channels: Sequence[str], height: int, width: int, chunk: tuple[int, int] = (1024, 1024), fill: int = 0) -> int:
    """px(c, y, x, value) as a group of one level with zlib chunks of one channel each; the number of chunk files.

    A chunk whose pixels are all `fill` or missing has no file. Each chunk is written by one task, which holds only it.
    """
    rows, columns = chunk
    meta = {"zarr_format": 2, "shape": [len(channels), height, width], "chunks": [1, rows, columns], "dtype": "<u2", "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None, "dimension_separator": "/"}
    axes = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space"}, {"name": "x", "type": "space"}]
    attrs = {"multiscales": [{"version": "0.4", "axes": axes, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 1]}]}]}], "omero": {"channels": [{"label": c} for c in channels]}}

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block = np.full((rows, columns), fill, "<u2")
        block[part["y"] - key[1] * rows, part["x"] - key[2] * columns] = part["value"]
        system, at = open_fs(f"{path}/0/{key[0]}/{key[1]}/{key[2]}")
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at) as f:
            f.write(zlib.compress(block.tobytes(), 1))
        return pd.DataFrame({"n": [1]})

    kept = px.where(F.col("value") != fill).select("c", "y", "x", "value")
    n = kept.groupBy("c", F.expr(f"cast(y div {rows} as int)").alias("cy"), F.expr(f"cast(x div {columns} as int)").alias("cx")).applyInPandas(write, "n int").count()
    for name, content in ((".zgroup", {"zarr_format": 2}), (".zattrs", attrs), ("0/.zarray", meta)):
        system, at = open_fs(f"{path}/{name}")
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at) as f:
            f.write(json.dumps(content).encode())
    return n

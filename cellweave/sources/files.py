"""Image files as Spark tables: plain TIFF read and written by executors, XML manifests, directory scans."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF tags and the sizes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
TYPE_SIZE = {1: 1, 3: 2, 4: 4}
TYPE_CODE = {1: "B", 3: "H", 4: "I"}


def _tags(data: bytes, order: str) -> dict[int, tuple[int, ...]]:
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
        if kind in TYPE_SIZE:
            place = entry + 8 if n * TYPE_SIZE[kind] <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{TYPE_CODE[kind]}", data, place)
    return tags


def read_tiff(data: bytes) -> np.ndarray:
    """The first page of an uncompressed grey TIFF of 8 or 16 bits; other files are an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    try:
        tags = _tags(data, order)
    except struct.error as e:
        raise ValueError("a cut TIFF file") from e
    bits = tags.get(BITS, (1,))[0]
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1 or bits not in (8, 16):
        raise ValueError("only uncompressed grey TIFF files of 8 or 16 bits are read")
    raw = b"".join(data[o : o + n] for o, n in zip(tags[OFFSETS], tags[COUNTS], strict=True))
    return np.frombuffer(raw, f"{order}u{bits // 8}").reshape(tags[HEIGHT][0], tags[WIDTH][0]).astype(f"u{bits // 8}")


def write_tiff(a: np.ndarray) -> bytes:
    """An 8 or 16 bit grey image as one strip."""
    a = np.ascontiguousarray(a, "<u2" if a.dtype.itemsize > 1 else "u1")
    fields = [(WIDTH, 4, a.shape[1]), (HEIGHT, 4, a.shape[0]), (BITS, 3, a.itemsize * 8), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 4, 0), (SAMPLES, 3, 1), (ROWS, 4, a.shape[0]), (COUNTS, 4, a.nbytes), (FORMAT, 3, 1)]
    start = 8 + 2 + 12 * len(fields) + 4
    head = b"II" + struct.pack("<HIH", 42, 8, len(fields))
    for tag, kind, value in fields:
        head += struct.pack("<HHI", tag, kind, 1) + struct.pack("<I" if kind == 4 else "<HH", *((start if tag == OFFSETS else value,) if kind == 4 else (value, 0)))
    return head + struct.pack("<I", 0) + a.tobytes()


def channel_name(path: str) -> str:
    """The first number in a file's name."""
    found = re.search(r"\d+", path.rsplit("/", 1)[-1])
    return found[0] if found else path


def pixels_from_tiffs(spark: SparkSession, paths: Sequence[str], crop: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """px(path, y, x, value): one file per channel, decoded where it is read; 8-bit values times 255. crop: first and last row and column, as in slices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                a = read_tiff(content)
                a = (a.astype(np.int32) * (255 if a.dtype.itemsize == 1 else 1))[slice(*crop), slice(*crop)]
                y, x = np.indices(a.shape).reshape(2, -1)
                yield pd.DataFrame({"path": path, "y": y.astype(np.int32), "x": x.astype(np.int32), "value": a.ravel()})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, "path string, y int, x int, value int")


def tiffs_from_pixels(px: DataFrame, by: str = "image_id") -> DataFrame:
    """(by, content): each image as the bytes of a 16-bit TIFF."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1), np.uint16)
        a[rows["y"], rows["x"]] = rows["value"]
        return pd.DataFrame({by: [rows[by].iloc[0]], "content": [write_tiff(a)]})

    return px.groupBy(by).applyInPandas(run, f"{by} {px.schema[by].dataType.simpleString()}, content binary")


def write_manifest(images: DataFrame, path: str) -> None:
    """Channel and image paths as XML."""
    images.write.format("xml").option("rootTag", "images").option("rowTag", "image").save(path)


def files_below(spark: SparkSession, root: str, levels: int, pattern: str = "*.parquet") -> DataFrame:
    """(path, level) of files at most `levels` folders below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    below = F.substring_index("path", f"/{root.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return found.withColumn("level", F.size(F.split(below, "/")) - 1).where(F.col("level") <= levels)


def consistent_channels(channels: DataFrame) -> DataFrame:
    """Channel numbers whose name or kind differs between files (column file); empty if all agree."""
    return channels.groupBy("c").agg(F.count_distinct("channel", "kind").alias("variants")).where("variants > 1")

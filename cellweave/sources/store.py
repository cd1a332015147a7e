"""A project's tables as Parquet under one root: images, masks, centres, features, single-cell sets; checked when written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.labels import centroids

#: Tiles that images are laid out in on disk: a crop reads the tiles that it touches.
TILE = 2000
CHANNEL_KINDS = ("mask", "image_channel")


class Project:
    """Named tables of one experiment. Writing an existing name is an error unless overwrite is set."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None) -> None:
        self.spark, self.root, self.config = spark, root.rstrip("/"), dict(config or {})

    def section(self, name: str) -> dict:
        """A method's own section of the configuration, or all of it."""
        return self.config.get(name, self.config)

    def path(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/{name}"

    def exists(self, kind: str, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(kind, name))
        except AnalysisException:
            return False
        return True

    def status(self) -> dict[str, bool]:
        names = [("image", "input_image"), ("mask", "nucleus"), ("mask", "cytosol"), ("points", "centers_nucleus"), ("points", "centers_cytosol")]
        return {f"{k}/{n}": self.exists(k, n) for k, n in names}

    def _write(self, df: DataFrame, kind: str, name: str, overwrite: bool, partitions: Sequence[str] = ()) -> None:
        writer = df.write.mode("overwrite" if overwrite else "errorifexists")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(self.path(kind, name))

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def drop(self, kind: str, name: str) -> bool:
        fs, at = self._fs(self.path(kind, name))
        return fs.delete(at, True)

    def rename(self, kind: str, name: str, new: str) -> bool:
        fs, at = self._fs(self.path(kind, name))
        return fs.rename(at, self._fs(self.path(kind, new))[1])

    def write_image(self, px: DataFrame, name: str = "input_image", channels: Sequence[str] | None = None, overwrite: bool = False) -> None:
        """px(c, y, x, value), laid out by channel and tile and sorted within, so that channels and windows prune files and pages."""
        tiled = px.withColumns({"ty": F.expr(f"cast(y div {TILE} as int)"), "tx": F.expr(f"cast(x div {TILE} as int)")})
        self._write(tiled.repartition("c", "ty", "tx").sortWithinPartitions("y", "x"), "image", name, overwrite, ["c"])
        if channels is not None:
            self._write(self.spark.createDataFrame(list(enumerate(channels)), "c int, channel string"), "channels", name, overwrite)

    def read_image(self, name: str = "input_image", channels: Sequence[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
        """Chosen channels and window (y0, y1, x0, x1): filters on stored columns, so that the scan skips the rest."""
        px = self.spark.read.parquet(self.path("image", name))
        if channels is not None:
            px = px.where(F.col("c").isin(list(channels)))
        if window is not None:
            y0, y1, x0, x1 = window
            px = px.where(F.col("ty").between(y0 // TILE, (y1 - 1) // TILE) & F.col("tx").between(x0 // TILE, (x1 - 1) // TILE) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
        return px.drop("ty", "tx")

    def write_mask(self, mask: DataFrame, name: str, overwrite: bool = False) -> None:
        """mask(y, x, cell_id) without background, and its centres."""
        kept = mask.where("cell_id != 0")
        self._write(kept, "mask", name, overwrite)
        self._write(centroids(kept), "points", f"centers_{name}", overwrite)

    def read(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, name))

    def write_cell_table(self, table: DataFrame, name: str, mask: str, overwrite: bool = False) -> None:
        """A table that annotates a mask: its ids are unique and all in the mask."""
        if not table.groupBy("cell_id").count().where("count > 1").isEmpty():
            raise ValueError("cell ids have to be unique")
        if not table.join(self.read("mask", mask), "cell_id", "left_anti").isEmpty():
            raise ValueError(f"some cell ids are not in the mask {mask}")
        self._write(table, "table", name, overwrite)

    def write_cells(self, images: DataFrame, channels: DataFrame, name: str, overwrite: bool = False) -> None:
        """A single-cell set: images(cell_id, c, y, x, value) and channels(c, channel, kind)."""
        check_channels(channels)
        self._write(images.repartition("cell_id").sortWithinPartitions("cell_id", "c", "y", "x"), "cells", name, overwrite)
        self._write(channels, "channels", name, overwrite)

    def write_results_csv(self, results: DataFrame, name: str, overwrite: bool = False) -> None:
        results.write.mode("overwrite" if overwrite else "errorifexists").csv(self.path("csv", name), header=True)

    def write_classes(self, ids: DataFrame, name: str, overwrite: bool = False) -> None:
        """One id a line."""
        ids.select(F.col("cell_id").cast("string")).write.mode("overwrite" if overwrite else "errorifexists").text(self.path("classes", name))

    def write_positions(self, tiles: DataFrame, name: str, overwrite: bool = False) -> None:
        tiles.write.mode("overwrite" if overwrite else "errorifexists").csv(self.path("positions", name), sep="\t")

    def run(self, step: Callable[[DataFrame], DataFrame], source: tuple[str, str], target: tuple[str, str], overwrite: bool = False) -> DataFrame:
        """A step from one stored table to another: the extension point for own methods."""
        self._write(step(self.read(*source)), *target, overwrite)
        return self.read(*target)

    def import_masks(self, nucleus: DataFrame, cytosol: DataFrame, overwrite: bool = False) -> None:
        """Two masks at once; the ids of one have to be among the other's."""
        a, b = (m.where("cell_id != 0").select("cell_id").distinct() for m in (nucleus, cytosol))
        if not a.join(b, "cell_id", "left_anti").isEmpty() and not b.join(a, "cell_id", "left_anti").isEmpty():
            raise ValueError("nucleus and cytosol ids have to be equal or subsets of each other")
        self.write_mask(nucleus, "nucleus", overwrite)
        self.write_mask(cytosol, "cytosol", overwrite)


def check_channels(channels: DataFrame) -> None:
    """Channel kinds are complete, known, and there is a mask."""
    if "kind" not in channels.columns:
        raise ValueError("channels need a column kind")
    kinds = {r["kind"] for r in channels.select("kind").distinct().limit(10).collect()}
    if None in kinds:
        raise ValueError("some channels have no kind")
    if kinds - set(CHANNEL_KINDS):
        raise ValueError(f"unknown kinds: {sorted(kinds - set(CHANNEL_KINDS))}")
    if "mask" not in kinds:
        raise ValueError("a single-cell set needs a mask channel")


def labelled_cells(cells: DataFrame, label: str, transform: Callable[[Column], Column] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Rows (label, cell_id, index) of a single-cell set for training, restricted to an index list; the transform is applied once."""
    value = F.col(label)
    out = cells.select((transform(value) if transform else value).alias("label"), "cell_id")
    return out.join(index, "cell_id", "left_semi") if index is not None else out

"""Plate metadata: position clustering, missing tiles, measurements that complete each other, and tile names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import running_sum


def cluster_positions(tiles: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """A number for each group of close stage positions, from 0 in ascending order, in column `out`.

    Steps are the positive gaps between sorted distinct positions; the typical step is their 0.9 quantile. Where small
    gaps (below a fifth of it) exist, they are jitter: the tolerance is twice their 0.95 quantile, a hundredth of the
    step at least; else it is a twentieth of the step. A gap above the tolerance opens a new group.
    """
    # The quantiles 0.9 and 0.95 and the factors 0.2, 0.05, 2 and 0.01, which decide what counts as one position.
    keys = list(by) or [F.lit(0).alias("_all")]
    order = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy(value)
    distinct = tiles.select(*by, value).distinct().withColumn("gap", F.col(value) - F.lag(value).over(order))
    step = distinct.groupBy(*keys).agg(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), F.lit(0.9)).alias("step"))
    join = (lambda a, b: a.join(b, list(by))) if by else (lambda a, b: a.crossJoin(F.broadcast(b.drop("_all"))))  # one row
    stepped = join(distinct, step)
    small = F.when((F.col("gap") > 0) & (F.col("gap") <= F.col("step") * 0.2), F.col("gap"))
    jitter = stepped.groupBy(*keys).agg(F.percentile(small, F.lit(0.95)).alias("jitter"))
    tolerance = F.when(F.col("jitter").isNull(), F.col("step") * 0.05).otherwise(F.greatest(F.col("jitter") * 2, F.col("step") * 0.01))
    flagged = join(stepped, jitter).withColumn("opens", F.when(F.col("gap") > tolerance, 1).otherwise(0))
    numbered = flagged.select(*by, value, F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias(out))
    return tiles.join(numbered, [*by, value])


def tile_positions(tiles: DataFrame, by: Sequence[str] = ("row_id", "well")) -> DataFrame:
    """x_pos and y_pos of each tile in its well."""
    return cluster_positions(cluster_positions(tiles, "px", "x_pos", by), "py", "y_pos", by)


def missing_tiles(tiles: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Combinations of the axes' values that no tile has, each once. The grid is the product of short lists of distinct values."""
    grid = tiles.agg(*[F.array_sort(F.collect_set(axis)).alias(axis) for axis in axes])
    for k, axis in enumerate(axes):
        grid = grid.withColumn(axis, F.explode(axis))
        if k == 0:
            grid = grid.repartition(axis)  # the rest of the product is made by as many tasks as the first axis allows
    return grid.join(tiles.select(*axes).distinct(), list(axes), "left_anti")


def first_measurement(tiles: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """One row per key: from each column the first value that isn't null, by the measurements' order."""
    rest = [c for c in tiles.columns if c not in (*keys, rank)]
    return tiles.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(rank), F.col(c)))).alias(c) for c in rest])


def tile_names(tiles: DataFrame) -> DataFrame:
    """Padded file names from row, well, channel and grid position."""
    name = F.format_string("Timepoint001_Row%s_Well%s_Channel%d_r%03d_c%03d.tif", "row_id", "well", "channel", "y_pos", "x_pos")
    return tiles.withColumn("filename", name)


def compressed_rows(tiles: DataFrame) -> DataFrame:
    """y positions of a well's rows put below each other: running offsets of the rows before, last row first."""
    size = tiles.groupBy("well", "row_id").agg((F.max("y_pos") + 1).alias("height"))
    before = Window.partitionBy("well").orderBy(F.col("row_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = size.select("well", "row_id", F.coalesce(F.sum("height").over(before), F.lit(0)).alias("offset"))
    return tiles.join(offsets, ["well", "row_id"]).withColumn("y_all", F.col("y_pos") + F.col("offset"))


def tile_id(name: str) -> Column:
    """r..._c... of a file name, null without one."""
    r, c = F.regexp_extract(name, r"_r(\d+)_c(\d+)\.tif", 1), F.regexp_extract(name, r"_r(\d+)_c(\d+)\.tif", 2)
    return F.when(r != "", F.concat(F.lit("r"), r, F.lit("_c"), c))


def measurement_order(paths: DataFrame, column: str = "path") -> DataFrame:
    """Measurement folders by the time in their names (those without one first), then by name, with a rank from 0. Ranked in slices of time."""
    stamp = F.regexp_extract(column, r"(\d{4}-\d{2}-\d{2}T\d{2}_\d{2}_\d{2})", 1)
    seconds = F.coalesce(F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH_mm_ss"))), F.lit(-(1 << 62)))
    return running_sum(paths.withColumn("stamp", stamp).withColumn("_seconds", seconds), "_seconds", name="rank", ties=[column]).drop("_seconds")


def images_from_xml(spark, path: str) -> DataFrame:
    """Tile metadata from a plate reader's XML: one row per Image element, with unix time and zero-padded indexes."""
    raw = spark.read.format("xml").option("rowTag", "Image").load(path)
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    at = F.to_timestamp(F.substring(F.col("AbsTime").cast("string"), 1, 19))
    return raw.select(F.col("URL").alias("filename"), pad("Row").alias("row_id"), pad("Col").alias("well"), F.col("PlaneID").cast("int").alias("zstack"), F.col("TimepointID").cast("int").alias("timepoint"), F.col("ChannelID").cast("int").alias("channel"), F.col("PositionX").cast("double").alias("px"), F.col("PositionY").cast("double").alias("py"), F.unix_timestamp(at).alias("unix_time"))


def channels_from_xml(spark, path: str) -> DataFrame:
    """channel ids and names, blanks removed, one row each."""
    raw = spark.read.format("xml").option("rowTag", "Image").load(path)
    return raw.select(F.col("ChannelID").cast("int").alias("channel"), F.replace("ChannelName", F.lit(" "), F.lit("")).alias("name")).distinct()


# The namespaces of plate index files by version, and what an image element holds.
_IMAGE = "URL string, Row int, Col int, FieldID int, PlaneID int, TimepointID int, ChannelID string, ChannelName string, FlimID int, PositionX double, PositionY double, AbsTime string"
_SCHEMA = f"Images struct<Image: array<struct<{_IMAGE}>>>"
VERSIONS = {"HarmonyV5": (_SCHEMA, 1), "HarmonyV7": (_SCHEMA.replace(", FlimID int", ", FlimID int, OrientationMatrix string"), 0)}


def plate_index(documents: DataFrame, flatfield: bool = False) -> DataFrame:
    """Index files of plates (name, xml: one document a row) to a row per image: name, version, filename, row_id, well, zstack,
    timepoint, channel, px, py, date, unix_time.

    The version is told by the root's namespace; another one is an error. Version 5 counts timepoints from 1, version 7
    from 0, and they name files differently; flat-field exports of version 7 have shorter names. Channel ids take the
    name that an image of the same document gives them, without blanks. Documents without images give no rows.
    """
    found = F.regexp_extract("xml", r'<\w+[^>]*xmlns="[^"]*(' + "|".join(VERSIONS) + r')[^"]*"', 1)
    told = documents.select("name", "xml", F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("unknown version of "), "name"))).alias("version"))
    out = None
    for version, (schema, first) in VERSIONS.items():
        images = told.where(F.col("version") == version).select("name", "version", F.from_xml("xml", schema, {"mode": "FAILFAST"}).alias("x")).select("name", "version", F.explode("x.Images.Image").alias("i"))
        two = lambda c: F.lpad(F.col(f"i.{c}").cast("string"), 2, "0")
        time = F.col("i.TimepointID") + first
        head = F.concat(F.lit("r"), two("Row"), F.lit("c"), two("Col"), F.lit("f"), two("FieldID"), F.lit("p"), two("PlaneID"), F.lit("-ch"), "i.ChannelID")
        if flatfield and version == "HarmonyV7":
            file = F.concat(head, F.lit("t"), F.lpad(time.cast("string"), 2, "0"), F.lit(".tiff"))
        else:
            file = F.concat(head, F.lit("sk"), time.cast("string"), F.lit("fk1fl"), F.coalesce(F.col("i.FlimID"), F.lit(1)).cast("string"), F.lit(".tiff"))
        at = F.to_timestamp(F.concat(F.substring("i.AbsTime", 1, 19), F.regexp_extract("i.AbsTime", r"([+-]\d\d:?\d\d|Z)$", 1)))
        part = images.select("name", "version", file.alias("filename"), two("Row").alias("row_id"), two("Col").alias("well"), two("PlaneID").alias("zstack"), time.alias("timepoint"), F.col("i.ChannelID").alias("channel_id"), F.replace("i.ChannelName", F.lit(" "), F.lit("")).alias("said"), F.col("i.PositionX").alias("px"), F.col("i.PositionY").alias("py"), F.substring("i.AbsTime", 1, 10).alias("date"), F.unix_timestamp(at).alias("unix_time"))
        out = part if out is None else out.unionByName(part)
    names = out.where("said is not null").groupBy("name", "channel_id").agg(F.min("said").alias("channel"))  # as many rows as a plate has channels
    return out.drop("said").join(names, ["name", "channel_id"], "left").drop("channel_id")

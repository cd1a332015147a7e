"""Queries that write images to files and read them back through the library's own sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import _shared
from ..sources import adapters as A
from ..sources import rasters
from ..sources.adapters import with_views
from .images import _mosaic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CHANNELS = """chans AS (SELECT 1 AS c, y, x, value FROM mosaic UNION ALL SELECT 2, y, x, value // 2 FROM mosaic UNION ALL SELECT 3, y, x, 30000 - value FROM mosaic),
    size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM mosaic), grid AS (SELECT c, y, x FROM size, range(1, 4) t(c), range(h) u(y), range(w) v(x))"""


def _channels(spark, d):
    """The mosaic in three channels (image_id 1 to 3), and its size."""
    m, h, w = _mosaic(spark, d)
    value = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("c"), v.cast("int").alias("value")) for k, v in ((1, F.col("value")), (2, F.expr("value div 2")), (3, 30000 - F.col("value")))]))
    return m.select("y", "x", value.alias("v")).select(F.col("v.c").alias("image_id"), "y", "x", "v.value"), h, w


@query(f"{with_views('mosaic')}, {_CHANNELS} SELECT c::VARCHAR AS channel, y::INT AS y, x::INT AS x, coalesce(value, 0)::INT AS value FROM grid LEFT JOIN chans USING (c, y, x), size WHERE y < h - 1 AND x < w - 1")
def s2_tiff_files(spark, d):
    """Channels written as TIFF files and read back by strips, with the default crop."""
    px, _, _ = _channels(spark, d)
    folder = f"{_shared(spark)}/tiff/{uuid.uuid4().hex}"
    rasters.write_tiffs(px, folder, rows_per_strip=16).count()
    return rasters.load_tiffs(spark, folder).drop("path")


@query(f"{with_views('mosaic')}, {_CHANNELS} SELECT c::INT - 1 AS c, ['dna', 'membrane', 'tubulin'][c] AS channel, y::INT AS y, x::INT AS x, coalesce(value, 0)::INT AS value FROM grid LEFT JOIN chans USING (c, y, x)")
def s3_omezarr_group(spark, d):
    """S3: channels written as chunks of an OME-Zarr group and read back by its metadata."""
    px, h, w = _channels(spark, d)
    path = f"{_shared(spark)}/zarr/{uuid.uuid4().hex}"
    rasters.write_omezarr(px.withColumn("c", (F.col("image_id") - 1).cast("int")), path, ["dna", "membrane", "tubulin"], h, w, (64, 48))
    return rasters.load_omezarr(spark, path)


@query(f"{with_views('mosaic')}, {_CHANNELS} SELECT (2 - c // 2)::INT AS c, ['dna', 'membrane', 'tubulin'][c] AS channel, sum(coalesce(value, 0))::BIGINT AS total, count(*) AS n FROM grid LEFT JOIN chans USING (c, y, x), size WHERE c <> 2 AND y >= h // 4 AND y < h // 2 AND x >= 10 GROUP BY c")
def s3_omezarr_window(spark, d):
    """Two channels in another order, and a window of their rows and columns; other chunks aren't opened."""
    px, h, w = _channels(spark, d)
    path = f"{_shared(spark)}/zarr/{uuid.uuid4().hex}"
    rasters.write_omezarr(px.withColumn("c", (F.col("image_id") - 1).cast("int")), path, ["dna", "membrane", "tubulin"], h, w, (16, 16))
    got = rasters.load_omezarr(spark, path, remap=[0, 2]).withColumn("c", 2 - F.col("c")).where((F.col("y") >= h // 4) & (F.col("y") < h // 2) & (F.col("x") >= 10))
    return got.groupBy("c", "channel").agg(F.sum("value").alias("total"), F.count("*").alias("n"))

"""Queries through a project's stored tables: images, masks, tables, single-cell sets, results and classes, written and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import _shared
from ..sources import adapters as A
from ..sources.adapters import with_views
from ..sources.store import Project
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


def _project(spark) -> Project:
    return Project(spark, f"{_shared(spark)}/projects/{uuid.uuid4().hex}")


@query(f"{with_views('mosaic')} SELECT 1::INT AS c, 'membrane' AS channel, y::INT AS y, x::INT AS x, (value // 2)::INT AS value FROM mosaic")
def k5_project_image(spark, d):
    """An image of two channels stored, renamed, a second one dropped, and a channel read with its name."""
    m, h, w = _mosaic(spark, d)
    two = F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("value").alias("value")), F.struct(F.lit(1).alias("c"), F.expr("cast(value div 2 as int)").alias("value"))))
    px = m.select("y", "x", two.alias("v")).select("v.c", "y", "x", "v.value")
    project = _project(spark)
    project.write_image(px, "raw", ["dna", "membrane"])
    project.write_image(px.where("c = 0"), "spare")
    project.rename("image", "raw", "input_image")
    if not project.drop("image", "spare") or project.exists("image", "spare") or not project.status()["image/input_image"]:
        raise RuntimeError("a stored image was not dropped or renamed")
    names = project.read("channels", "raw")
    return project.read_image("input_image", [1], (0, h, 0, w)).join(names, "c").select("c", "channel", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("int").alias("value"))


@query(f"{with_views('mosaic')} SELECT cell_id, round(avg(y), 6) AS y, round(avg(x), 6) AS x, count(*) AS n, count(*) * 2 AS twice FROM mosaic WHERE cell_id <> 0 GROUP BY cell_id")
def k8_project_mask_and_table(spark, d):
    """K4, K8, K9: a mask stored with its centres, and a table of its cells checked against it."""
    m, _, _ = _mosaic(spark, d)
    project = _project(spark)
    project.write_mask(m.select("y", "x", "cell_id"), "nucleus")
    centres = project.read("points", "centers_nucleus")
    project.write_cell_table(centres.select("cell_id", (F.col("n") * 2).alias("twice")), "sizes", "nucleus")
    return centres.join(project.read("table", "sizes"), "cell_id").select("cell_id", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "n", "twice")


@query(f"{with_views('px')} SELECT image_id AS cell_id, 0::INT AS c, 'nucleus' AS channel, y, x, (value > 10000)::INT AS value FROM px UNION ALL SELECT image_id, 1, 'dna', y, x, value FROM px")
def k2_single_cell_set(spark, d):
    """A single-cell set with a mask and an image channel, stored by cell and read back with channel names."""
    px = A.pixels(spark, d)
    cell = lambda c, v: px.select(F.col("image_id").alias("cell_id"), F.lit(c).alias("c"), "y", "x", v.cast("int").alias("value"))
    project = _project(spark)
    kinds = spark.createDataFrame([(0, "nucleus", "mask"), (1, "dna", "image_channel")], "c int, channel string, kind string")
    project.write_cells(cell(0, F.col("value") > 10000).unionByName(cell(1, F.col("value"))), kinds, "cells")
    return project.read("cells", "cells").join(project.read("channels", "cells").drop("kind"), "c").select("cell_id", "c", "channel", "y", "x", "value")


@query(f"{with_views('nuc')} SELECT cell_id, count(*) AS n, cell_id % 3 = 0 AS chosen FROM nuc GROUP BY cell_id")
def k11_results_and_classes(spark, d):
    """Results as CSV and chosen classes as lines of text, both read back."""
    sizes = A.nuclei(A.pixels(spark, d)).groupBy("cell_id").agg(F.count("*").alias("n"))
    project = _project(spark)
    project.write_results_csv(sizes, "sizes")
    project.write_classes(sizes.where("cell_id % 3 = 0").select("cell_id"), "chosen")
    back = spark.read.csv(project.path("csv", "sizes"), header=True, schema="cell_id long, n long")
    chosen = spark.read.text(project.path("classes", "chosen")).select(F.col("value").cast("long").alias("cell_id"), F.lit(True).alias("chosen"))
    return back.join(chosen, "cell_id", "left").select("cell_id", "n", F.coalesce("chosen", F.lit(False)).alias("chosen"))

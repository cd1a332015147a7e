"""Queries of cell outlines: ordered rings, their areas, and shapes for cutting."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rings
from ..operators.graphs import _cut, _shared
from ..sources import adapters as A
from ..sources.adapters import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Edges and their rings, each ring walked from its least edge.
_WALK = f"""{with_views('px', 'nuc').replace('WITH', 'WITH RECURSIVE', 1)}, m AS (SELECT image_id AS i, y, x, cell_id AS c FROM nuc),
    dirs(d, oy, ox, sy, sx, cy, cx, ey, ex) AS (VALUES (0, -1, 0, 0, 1, -1, 1, 0, 1), (1, 0, 1, 1, 0, 1, 1, 1, 1), (2, 1, 0, 0, -1, 1, -1, 1, 0), (3, 0, -1, -1, 0, -1, -1, 0, 0)),
    sides AS (SELECT m.*, dirs.* FROM m, dirs WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.i = m.i AND o.c = m.c AND o.y = m.y + oy AND o.x = m.x + ox)),
    linked AS (SELECT s.i, s.c, s.d, (s.y::BIGINT * 2147483648 + s.x) * 4 + s.d AS e, s.y + ey AS vy, s.x + ex AS vx, s.y + ey - sy AS wy, s.x + ex - sx AS wx,
        CASE WHEN a.c IS NULL THEN (s.y::BIGINT * 2147483648 + s.x) * 4 + (s.d + 1) % 4 WHEN b.c IS NULL THEN ((s.y + sy)::BIGINT * 2147483648 + s.x + sx) * 4 + s.d
            ELSE ((s.y + cy)::BIGINT * 2147483648 + s.x + cx) * 4 + (s.d + 3) % 4 END AS nx, a.c IS NULL OR b.c IS NOT NULL AS turn
        FROM sides s LEFT JOIN m a ON a.i = s.i AND a.c = s.c AND a.y = s.y + sy AND a.x = s.x + sx LEFT JOIN m b ON b.i = s.i AND b.c = s.c AND b.y = s.y + cy AND b.x = s.x + cx),
    walk AS (SELECT i, e AS ring, e, nx, 0 AS place FROM linked UNION ALL SELECT w.i, ring, l.e, l.nx, place + 1 FROM walk w JOIN linked l ON l.i = w.i AND l.e = w.nx WHERE w.nx > ring),
    heads AS (SELECT i, ring FROM walk WHERE nx = ring),
    ringed AS (SELECT l.*, w.ring, w.place FROM walk w JOIN heads USING (i, ring) JOIN linked l ON l.i = w.i AND l.e = w.e)"""


def _outline(spark, d):
    return rings.outlines(A.nuclei(A.pixels(spark, d)), ["image_id"])


@query(f"{_WALK} SELECT i AS image_id, c AS cell_id, ring, place::BIGINT AS place, vy::INT AS y, vx::INT AS x FROM ringed WHERE turn")
def k10_ring_corners(spark, d):
    """Corners of every ring of every nucleus, in order."""
    return rings.corners(_outline(spark, d), ["image_id"])


@query(f"{_WALK} SELECT i AS image_id, c AS cell_id, ring, count(*) AS n_edges, count(*) FILTER (WHERE turn) AS n_corners, (sum(wx * vy - vx * wy) // 2)::BIGINT AS area, sum(wx * vy - vx * wy) < 0 AS hole FROM ringed GROUP BY ALL")
def k10_ring_areas(spark, d):
    """Perimeters and areas of rings, holes below zero."""
    return rings.ring_measures(_outline(spark, d), ["image_id"])


@query(f"""{_WALK}, pts AS (SELECT i, c, ring, list({{'X': vx * 100, 'Y': vy * 100}} ORDER BY place) FILTER (WHERE turn) AS p, sum(wx * vy - vx * wy) AS a FROM ringed GROUP BY i, c, ring)
    SELECT c AS cell_id, 'well-' || lower(substr(c_mktsegment, 1, 1)) AS cap, count(*) AS n_shapes, sum(len(p))::BIGINT AS n_points, sum(list_sum([q.X * 3 + q.Y for q in p]))::BIGINT AS checksum
    FROM pts JOIN customer ON c_custkey = c WHERE a > 0 GROUP BY 1, 2""")
def k23_cutting_shapes(spark, d):
    """Shapes of the cells of each set, written as XML for a cutter and read back."""
    outline = _cut(_outline(spark, d)).drop("image_id")  # an id is of one image
    path = f"{_shared(spark)}/xml/{uuid.uuid4().hex}"
    rings.write_cutting_xml(rings.cutting_shapes(rings.polygons(outline.withColumn("ring", F.struct("cell_id", "ring"))), A.cell_sets(spark, d)), path)
    back = spark.read.format("xml").option("rowTag", "Shape").schema("cell_id long, Name string, CapID string, PointCount int, Point array<struct<X: long, Y: long>>").load(path)
    check = F.aggregate("Point", F.lit(0).cast("long"), lambda s, p: s + p["X"] * 3 + p["Y"])
    return back.groupBy("cell_id", F.col("CapID").alias("cap")).agg(F.count("*").alias("n_shapes"), F.sum("PointCount").alias("n_points"), F.sum(check).alias("checksum"))

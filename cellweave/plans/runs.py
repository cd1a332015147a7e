"""Queries of plate indexes, run metrics and random transforms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment, plates
from ..operators.graphs import _cut, _shared
from ..sources import adapters as A
from ..sources import metrics
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


#: Part numbers whose images share an index file; a plate has as many files as its images ask for.
_FILE_IMAGES = 400

_PARTS = """p AS (SELECT *, p_partkey % 4 = 3 AS late, (p_partkey + 1) % 3 + 1 AS ch FROM part)"""


@query(f"""WITH {_PARTS} SELECT CASE WHEN late THEN 'plate7' ELSE 'plate5' END AS name, CASE WHEN late THEN 'HarmonyV7' ELSE 'HarmonyV5' END AS version,
    'r' || lpad((p_size % 16 + 1)::VARCHAR, 2, '0') || 'c' || lpad((p_size % 24 + 1)::VARCHAR, 2, '0') || 'f' || lpad((p_partkey % 90 + 1)::VARCHAR, 2, '0') || 'p' || lpad((p_partkey % 5 + 1)::VARCHAR, 2, '0') || '-ch' || ch || 'sk' || (p_partkey % 7 + CASE WHEN late THEN 0 ELSE 1 END) || 'fk1fl' || (p_partkey % 2 + 1) || '.tiff' AS filename,
    lpad((p_size % 16 + 1)::VARCHAR, 2, '0') AS row_id, lpad((p_size % 24 + 1)::VARCHAR, 2, '0') AS well, lpad((p_partkey % 5 + 1)::VARCHAR, 2, '0') AS zstack, (p_partkey % 7 + CASE WHEN late THEN 0 ELSE 1 END)::INT AS timepoint,
    (p_partkey % 11) * 0.25::DOUBLE AS px, (p_partkey % 5) * -0.5::DOUBLE AS py, '2023-05-0' || (p_partkey % 9 + 1) AS date, (1682935200 + (p_partkey % 9) * 86400 + p_partkey % 60)::BIGINT AS unix_time, ['Alexa488', 'DAPI', 'mCherry'][ch] AS channel FROM p""")
def s17_plate_xml(spark, d):
    """Index files of two versions, with their own namespaces, time bases and file names; channels by their ids."""
    key, size = F.col("p_partkey"), F.col("p_size")
    late, channel = key % 4 == 3, (key + 1) % 3 + 1
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), F.lit(value).cast("string") if isinstance(value, str) else value.cast("string"), F.lit(f"</{name}>"))
    names = F.element_at(F.array(*map(F.lit, ("Alexa 488", "DAPI", "m Cherry"))), channel.cast("int"))
    time = F.concat(F.lit("2023-05-0"), (key % 9 + 1).cast("string"), F.lit("T12:00:"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(".1234567+02:00"))
    fields = {"Row": size % 16 + 1, "Col": size % 24 + 1, "FieldID": key % 90 + 1, "PlaneID": key % 5 + 1, "TimepointID": key % 7, "ChannelID": channel, "ChannelName": names, "FlimID": key % 2 + 1, "PositionX": key % 11 * 0.25, "PositionY": key % 5 * -0.5, "AbsTime": time}
    image = F.concat(F.lit('<Image Version="1">'), *[tag(k, v) for k, v in fields.items()], F.lit("</Image>"))
    rows = A.table(spark, d, "part").select(F.when(late, "plate7").otherwise("plate5").alias("name"), F.when(late, "HarmonyV7").otherwise("HarmonyV5").alias("v"), F.expr(f"p_partkey div {_FILE_IMAGES}").alias("file"), image.alias("image"))
    docs = rows.groupBy("name", "v", "file").agg(F.array_join(F.collect_list("image"), "").alias("body"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><EvaluationInputData xmlns="http://www.perkinelmer.com/PEHH/'), "v", F.lit('" Version="1"><User>x</User><Images>'), "body", F.lit("</Images></EvaluationInputData>"))
    return plates.plate_index(docs.select("name", xml.alias("xml")))


@query(f"""{with_views('px', 'nuc')} SELECT 'nuclei' AS stage, count(*)::DOUBLE AS n_rows, sum(CASE WHEN y % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS even, max(cell_id)::DOUBLE AS top FROM nuc
    UNION ALL SELECT 'pixels', count(*)::DOUBLE, sum(CASE WHEN y % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE, max(image_id)::DOUBLE FROM px""")
def k15_run_metrics(spark, d):
    """Two stages counted while they are written, read back from the metrics table."""
    at = f"{_shared(spark)}/runs/{uuid.uuid4().hex}"
    px = A.pixels(spark, d)
    for stage, df, top in (("pixels", px, "image_id"), ("nuclei", A.nuclei(px), "cell_id")):
        metrics.measured(df, lambda x, stage=stage: x.write.parquet(f"{at}/{stage}"), stage, f"{at}/metrics", even=F.count_if(F.col("y") % 2 == 0), top=F.max(top))
    m = F.col("metrics")
    return metrics.read_metrics(spark, f"{at}/metrics").where("seconds > 0").select("stage", m["rows"].alias("n_rows"), m["even"].alias("even"), m["top"].alias("top"))


def _draw(place: int, k: int) -> str:
    return f"(('0x' || substr(md5('5/2/{place}/{k}/' || image_id), 1, 8))::BIGINT / 4294967296.0)"


@query(f"""{with_views('px')}, a AS (SELECT image_id, y, CASE WHEN {_draw(0, 0)} < 0.5 THEN 7 - x ELSE x END AS x, value FROM px),
    b AS (SELECT *, floor({_draw(1, 0)} * 4) AS k FROM a), t AS (SELECT image_id, CASE k WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END AS ny, CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END AS nx, value FROM b)
    SELECT image_id AS cell_id, ny::INT AS y, nx::INT AS x, round(value * (0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * {_draw(2, 0)}), 4) AS value FROM t""")
def u9_random_transforms(spark, d):
    """Flips, quarter turns and brightness, drawn per cell and epoch."""
    px = A.pixels(spark, d).select(F.col("image_id").alias("cell_id"), "y", "x", F.col("value").cast("double").alias("value"))
    out = augment.apply_chain(px, [augment.flip(), augment.quarter_turns(), augment.scale(0.8, 1.2)], A.SIDE, seed=5, epoch=2)
    return out.withColumn("value", F.round("value", 4))


#: Tiles of the mosaic: their side, the step between them, and the rows and columns by which a tile may be off.
_TILE_SIDE, _TILE_STEP = 40, 28


def _cut_tiles(spark, d):
    """Tiles of the whole mosaic at places up to two pixels off nominal; the last ones end at its border. Each pixel tells its tiles, without a join."""
    from .images import _mosaic

    m, h, w = _mosaic(spark, d)
    rows, columns = (max(0, -(-(n - _TILE_SIDE) // _TILE_STEP)) + 1 for n in (h, w))
    grid = spark.range(rows * columns).select(F.col("id").alias("tile"), F.expr(f"id div {columns}").cast("int").alias("r"), (F.col("id") % columns).cast("int").alias("k"))
    nominal = lambda c, n: F.least(F.col(c) * _TILE_STEP, F.lit(max(n - _TILE_SIDE, 0)))
    off = lambda c, n, by: F.greatest(F.lit(0), F.least(nominal(c, n) + F.when(F.col("tile") == 0, 0).otherwise(F.col("tile") * by % 5 - 2), F.lit(max(n - _TILE_SIDE, 0)))).cast("int")

    def near(c: str, n: int, many: int) -> Column:
        """Rows (or columns) of tiles that may hold a pixel: a tile is up to two pixels off, the last one may begin before its step."""
        low = F.greatest(F.lit(0), F.least(F.expr(f"({c} - {_TILE_SIDE + 1}) div {_TILE_STEP}"), F.lit(many - 1)))
        high = F.when(F.col(c) >= n - _TILE_SIDE - 2, many - 1).otherwise(F.least(F.expr(f"({c} + 2) div {_TILE_STEP}"), F.lit(many - 1)))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    asked = m.select("y", "x", "value", near("y", h, rows).alias("r")).select("*", near("x", w, columns).alias("k"))
    asked = asked.withColumn("tile", F.col("r").cast("long") * columns + F.col("k"))
    px = asked.select("tile", (F.col("y") - off("r", h, 3)).cast("int").alias("y"), (F.col("x") - off("k", w, 7)).cast("int").alias("x"), "value").where(F.col("y").between(0, _TILE_SIDE - 1) & F.col("x").between(0, _TILE_SIDE - 1))
    return px.select("tile", F.lit(0).alias("c"), "y", "x", "value"), grid.select("tile", nominal("r", h).cast("double").alias("y"), nominal("k", w).cast("double").alias("x"))


@query(f"""{with_views('mosaic')}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM mosaic), n AS (SELECT *, greatest(0, ceil((h - 40) / 28.0))::INT + 1 AS nr, greatest(0, ceil((w - 40) / 28.0))::INT + 1 AS nk FROM s),
    t AS (SELECT i AS tile, greatest(0, least(least(i // nk * 28, greatest(h - 40, 0)) + CASE WHEN i = 0 THEN 0 ELSE i * 3 % 5 - 2 END, greatest(h - 40, 0))) AS ty, greatest(0, least(least(i % nk * 28, greatest(w - 40, 0)) + CASE WHEN i = 0 THEN 0 ELSE i * 7 % 5 - 2 END, greatest(w - 40, 0))) AS tx FROM n, range(nr * nk) g(i)),
    o AS (SELECT min(ty) AS oy, min(tx) AS ox FROM t) SELECT 0 AS c, (y - oy)::INT AS y, (x - ox)::INT AS x, any_value(value)::DOUBLE AS value FROM mosaic m, t, o WHERE m.y >= ty AND m.y < ty + 40 AND m.x >= tx AND m.x < tx + 40 GROUP BY y, x, oy, ox""")
def g10_stitch_mosaic(spark, d):
    """Tiles of the mosaic, off their nominal places, registered, placed and blended to the mosaic again."""
    from ..operators import stitching

    px, nominal = _cut_tiles(spark, d)
    canvas, _ = stitching.stitch(_cut(px), _cut(nominal), _TILE_SIDE, _TILE_SIDE, most_error=0.4)
    return canvas.select("c", "y", "x", F.round("value", 6).alias("value"))

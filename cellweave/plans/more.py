"""More queries: merges, crops, filled gaps, calibrations and losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import blocks, features, images, labels, plates, tiling
from ..sources import adapters as A
from ..sources import files
from ..sources.adapters import with_views
from .images import _CELLS, _FEATURES, _cells, _mosaic
from .tables import _TILES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _shard_labels(spark, d):
    """Each group of four images as one image of 16 x 16 pixels in two overlapping shards, labelled by quadrant."""
    px = A.pixels(spark, d)
    k = F.col("image_id") % 4
    big = px.select(F.expr("image_id div 4").alias("image_id"), (F.expr("(image_id % 4) div 2") * 8 + F.col("y")).cast("int").alias("y"), (F.col("image_id") % 2 * 8 + F.col("x")).cast("int").alias("x"), F.when((F.col("value") > 9000) & F.col("y").between(1, 6) & F.col("x").between(1, 6), k + 1).otherwise(0).alias("cell_id"))
    windows = spark.createDataFrame([(0, 0, 16, 0, 10), (1, 0, 16, 6, 16)], "shard int, y0 int, y1 int, x0 int, x1 int")
    return big.join(F.broadcast(windows), (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))  # two rows


@query()
def w3_merge_shards(spark, d):
    """Labels of overlapping shards merged in order, image by image."""
    return tiling.merge_shards(_shard_labels(spark, d))


@query()
def l7_segment_shards(spark, d):
    """The mosaic in overlapping shards, each labelled by its own threshold and watershed, then merged to one mask."""
    m, h, w = _mosaic(spark, d)
    px = m.select(F.lit(0).cast("long").alias("image_id"), "y", "x", "value")
    plan = tiling.shard_plan(spark, h, w, 64 * 64, 8)
    found = tiling.segment_shards(px, plan, lambda a: kernels.label_mask(a > 12000, 0, 2))
    return tiling.merge_shards(found)


@query()
def j5_cell_crops(spark, d):
    """Holes filled, mask blurred, values under it."""
    m, h, w = _mosaic(spark, d)
    centers = features.inside_border(features.rounded_centers(labels.centroids(m)), 6, h, w)
    crops = features.extract_cells(m.select("y", "x", "value"), m.where("cell_id != 0").select("y", "x", "cell_id"), centers, 6)
    return images.cell_crops(crops, 6)


@query()
def i13_refine_upscaled(spark, d):
    """Masks at twice the size, smoothed without losing a label."""
    nuc = A.nuclei(A.pixels(spark, d)).withColumn("value", F.col("cell_id"))
    return images.refine_upscaled(nuc, 2)


@query()
def i16_segment_nuclei(spark, d):
    """I16: normalised, thresholded and labelled, then small labels filtered, all per image."""
    from ..operators import pixels

    px = pixels.normalize_quantiles(A.pixels(spark, d)).select("image_id", "y", "x", F.col("normalized").alias("value"))
    found = images.segment_threshold(px, speckle=0).withColumn("cell_id", F.col("image_id") * 1000 + F.col("cell_id"))
    return labels.size_filter(found, 3, 60)


@query(f"""{with_views('px')}, t AS (SELECT *, radians(45 * (((image_id + 3) * 2654435761 % 4294967296) % 8)) AS a FROM px),
    f AS (SELECT image_id, y, x, round(3.5 + cos(a) * (y - 3.5) - sin(a) * (x - 3.5))::INT AS sy, round(3.5 + sin(a) * (y - 3.5) + cos(a) * (x - 3.5))::INT AS sx FROM t)
    SELECT f.image_id, f.y, f.x, coalesce(px.value, 0)::DOUBLE AS out FROM f LEFT JOIN px ON px.image_id = f.image_id AND px.y = sy AND px.x = sx""")
def p29_random_rotation(spark, d):
    return images.rotate(A.pixels(spark, d), 8, 3)


@query()
def g1_registration_limit(spark, d):
    """A low quantile of errors between tiles that don't touch."""
    rows = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("source"))
    apart = rows.join(rows.select((F.col("a") - 17).alias("a"), F.col("a").alias("b"), F.col("source").alias("target")), "a").select("a", "b", "source", "target")
    return images.max_error(images.register_pairs(apart, A.SIDE))


@query()
def k16_tiff_images(spark, d):
    """Images as 16-bit TIFF files, their bytes and a checksum."""
    out = files.tiffs_from_pixels(A.pixels(spark, d).select("image_id", "y", "x", "value"))
    return out.select("image_id", F.length("content").alias("n_bytes"), F.crc32("content").alias("crc"))


@query(f"{_CELLS}, f AS ({_FEATURES}) SELECT cell_id, nucleus_area, dna_mean_nucleus FROM f")
def j8_features_as_frame(spark, d):
    """A feature table read back by id, without its region."""
    f = features.cell_statistics(_cells(spark, d), ["nucleus", "cytosol"], ["dna"], digits=6).withColumn("region", F.lit("seg_nucleus"))
    return f.select("cell_id").join(f.drop("region"), "cell_id").select("cell_id", "nucleus_area", "dna_mean_nucleus")


@query("WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS mean, count(*) AS weight FROM customer GROUP BY 1) SELECT max_by(k, (weight, -k)) AS k FROM c")
def a8_population_index(spark, d):
    """The component with the most weight."""
    parts = A.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("weight"))
    return labels.mixture_index(parts, "most")


@query(f"""{_TILES}, t AS (SELECT * FROM tiles WHERE tile_id % 9 <> 0), g AS (SELECT * FROM (SELECT DISTINCT row_id FROM t), (SELECT DISTINCT well FROM t), (SELECT DISTINCT x_pos FROM t), (SELECT DISTINCT y_pos FROM t), (SELECT DISTINCT channel FROM t)), gone AS (SELECT row_id, well, x_pos, y_pos, channel FROM g EXCEPT SELECT row_id, well, x_pos, y_pos, channel FROM t)
    SELECT row_id, well, x_pos, y_pos, channel, (i // 4)::INT AS y, (i % 4)::INT AS x, 0::INT AS value FROM gone, range(16) AS r(i)""")
def k22_replace_missing(spark, d):
    """Black images in place of missing tiles."""
    tiles = plates.tile_positions(A.stage_positions(spark, d)).where("tile_id % 9 != 0")
    gone = plates.missing_tiles(tiles, ["row_id", "well", "x_pos", "y_pos", "channel"])
    steps = F.sequence(F.lit(0), F.lit(3))
    return gone.withColumn("y", F.explode(steps)).withColumn("x", F.explode(steps)).withColumn("value", F.lit(0))


@query(f"""{with_views('px', 'nuc')}, c AS (SELECT (image_id % 5)::INT AS c, 'ch' || (image_id % 5 + CASE WHEN image_id = 33 THEN 1 ELSE 0 END) AS channel, 'mask' AS kind FROM px) SELECT c, count(DISTINCT (channel, kind)) AS variants FROM c GROUP BY c HAVING count(DISTINCT (channel, kind)) > 1""")
def s29_channel_consistency(spark, d):
    px = A.pixels(spark, d)
    name = F.concat(F.lit("ch"), F.col("image_id") % 5 + F.when(F.col("image_id") == 33, 1).otherwise(0))
    return files.consistent_channels(px.select((F.col("image_id") % 5).cast("int").alias("c"), name.alias("channel"), F.lit("mask").alias("kind")))


@query(f"{with_views('nuc', 'cyt')} SELECT 'nucleus' AS mask, image_id, y, x, cell_id FROM nuc UNION ALL SELECT 'cytosol', image_id, y, x, cell_id FROM cyt")
def s15_stack_masks(spark, d):
    """Masks stacked under a name."""
    px = A.pixels(spark, d)
    return A.nuclei(px).select(F.lit("nucleus").alias("mask"), "image_id", "y", "x", "cell_id").unionByName(A.cytosol(px).select(F.lit("cytosol").alias("mask"), "image_id", "y", "x", "cell_id"))


@query(f"{with_views('px')} SELECT image_id, round(avg(pow(v - 0.5, 2)) + 0.25 * (-0.5 * avg(1 + v - pow(v, 2) - exp(v))), 6) AS loss FROM px GROUP BY image_id")
def u19_reconstruction_loss(spark, d):
    """Mean squared error plus a weighted divergence term."""
    px, v = A.pixels(spark, d), F.col("v")
    divergence = -0.5 * F.avg(1 + v - F.pow(v, F.lit(2.0)) - F.exp(v))
    return px.groupBy("image_id").agg(F.round(F.avg(F.pow(v - 0.5, F.lit(2.0))) + 0.25 * divergence, 6).alias("loss"))


@query(f"{with_views('mosaic')} SELECT (y // 4)::INT AS y, (x // 4)::INT AS x, trunc(sum(value) / 16 / (SELECT max(s) FROM (SELECT sum(value) / 16 AS s FROM mosaic GROUP BY y // 4, x // 4)) * 255)::INT AS value FROM mosaic GROUP BY 1, 2")
def i26_thumbnail(spark, d):
    """The whole mosaic, small."""
    m, _, _ = _mosaic(spark, d)
    return blocks.downsample(m.select("y", "x", "value"), 4, padded=True, top=255)


@query(f"{with_views('px')}, n AS (SELECT image_id, (y // 2)::INT AS ty, (x // 2)::INT AS tx, max(value) AS value FROM px GROUP BY 1, 2, 3) SELECT image_id, ty AS y, tx AS x, value FROM n WHERE NOT (image_id % 6 = 0 AND ty = 0)")
def l6_resume_tiles(spark, d):
    """Tiles that an earlier run has done are left out, the others worked on."""
    tiles = A.pixels(spark, d).select("image_id", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x"), "value")
    done = tiles.where("image_id % 6 = 0 and y = 0").select("image_id", "y", "x").distinct()
    return tiles.join(done, ["image_id", "y", "x"], "left_anti").groupBy("image_id", "y", "x").agg(F.max("value").alias("value"))

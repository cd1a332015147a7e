"""The driver's tables seen as images, masks, plates and scores. Each view is lazy and reads only the columns it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the small images, tiles in a mosaic row, and the base of second nuclei's ids.
SIDE, MOSAIC_TILES, SECOND = 8, 25, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px(image_id, y, x, v double, value int): each 64-float vector as an 8 x 8 image; value is its 16-bit form."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return rows.select("image_id", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"), v.alias("v"), F.greatest(F.lit(0), F.floor((v + 1) * 10000)).cast("int").alias("value"))


def cytosol(px: DataFrame) -> DataFrame:
    """mask pixels (image_id, y, x, cell_id): the inner 6 x 6 of each image."""
    return px.where("y between 1 and 6 and x between 1 and 6").select("image_id", "y", "x", (F.col("image_id") + 1).alias("cell_id"))


def nuclei(px: DataFrame) -> DataFrame:
    """Bright inner pixels; one image in seven has a nucleus that leaves its cytosol, one in seven has two nuclei."""
    inner = (F.col("y").between(1, 6) & F.col("x").between(1, 6)) | (F.col("image_id") % 7 == 3)
    second = F.when((F.col("image_id") % 7 == 5) & (F.col("x") >= 4), SECOND).otherwise(0)
    return px.where(inner & (F.col("value") > 10000)).select("image_id", "y", "x", (F.col("image_id") + 1 + second).alias("cell_id"))


def mosaic(px: DataFrame) -> DataFrame:
    """One large image of all small ones: (y, x, value, cell_id); each tile's bright pixels are labelled with its cell."""
    return px.select(
        (F.expr(f"image_id div {MOSAIC_TILES}") * SIDE + F.col("y")).alias("y"),
        (F.col("image_id") % MOSAIC_TILES * SIDE + F.col("x")).alias("x"),
        "value",
        F.when(F.col("value") > 10000, F.col("image_id") + 1).otherwise(0).alias("cell_id"),
    )


def stage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate tiles with jittered stage positions: (row_id, well, tile_id, px, py, channel, source)."""
    part = table(spark, sf_dir, "part")
    jitter = F.col("p_partkey") % 3 * 0.001
    return part.select(
        F.lpad((F.col("p_size") % 2 + 1).cast("string"), 2, "0").alias("row_id"),
        F.lpad((F.col("p_size") % 3 + 1).cast("string"), 2, "0").alias("well"),
        F.col("p_partkey").alias("tile_id"),
        (F.col("p_partkey") % 11 + jitter).alias("px"),
        (F.col("p_partkey") % 5 + jitter).alias("py"),
        (F.col("p_partkey") % 2).cast("int").alias("channel"),
        F.when(F.col("p_partkey") % 4 < 3, "first").otherwise("second").alias("source"),
    )


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger pixel table: order lines as pixels of cells (cell_id, channel, y, x, value in cents)."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("channel"), F.col("l_linenumber").cast("int").alias("y"), F.col("l_quantity").cast("int").alias("x"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (id, truth 0/1, score in [0, 1], class_true, class_pred) from labels and text lengths."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("truth"),
        (F.least(F.col("n_chars"), F.lit(4000)) / 4000).alias("score"),
        (F.col("quality") + F.col("toxic")).alias("class_true"),
        (F.col("n_chars") % 3).cast("int").alias("class_pred"),
    )


def cell_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named sets of cells, a row for each cell (name, well, cell_id): customers by market segment."""
    name = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(name.alias("name"), F.concat(F.lit("well-"), F.lower(F.substring(name, 1, 1))).alias("well"), F.col("c_custkey").alias("cell_id"))


# Fixed text: the same views for DuckDB.
SQL = {
    "px": """px AS (SELECT vec_id AS image_id, (pos // 8)::INT AS y, (pos % 8)::INT AS x, v::DOUBLE AS v, greatest(0, floor((v::DOUBLE + 1) * 10000))::INT AS value
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))""",
    "cyt": "cyt AS (SELECT image_id, y, x, image_id + 1 AS cell_id FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6)",
    "nuc": """nuc AS (SELECT image_id, y, x, image_id + 1 + CASE WHEN image_id % 7 = 5 AND x >= 4 THEN 1000000 ELSE 0 END AS cell_id
        FROM px WHERE ((y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6) OR image_id % 7 = 3) AND value > 10000)""",
    "mosaic": "mosaic AS (SELECT image_id // 25 * 8 + y AS y, image_id % 25 * 8 + x AS x, value, CASE WHEN value > 10000 THEN image_id + 1 ELSE 0 END AS cell_id FROM px)",
    "stage": """stage AS (SELECT lpad((p_size % 2 + 1)::VARCHAR, 2, '0') AS row_id, lpad((p_size % 3 + 1)::VARCHAR, 2, '0') AS well, p_partkey AS tile_id, p_partkey % 11 + (p_partkey % 3) * 0.001::DOUBLE AS px,
        p_partkey % 5 + (p_partkey % 3) * 0.001::DOUBLE AS py, (p_partkey % 2)::INT AS channel, CASE WHEN p_partkey % 4 < 3 THEN 'first' ELSE 'second' END AS source FROM part)""",
    "lines": "lines AS (SELECT l_orderkey AS cell_id, l_returnflag AS channel, l_linenumber::INT AS y, trunc(l_quantity)::INT AS x, round(l_extendedprice * 100)::BIGINT AS value FROM lineitem)",
    "scores": """scores AS (SELECT doc_id AS id, quality AS truth, least(n_chars, 4000) / 4000 AS score, quality + toxic AS class_true, (n_chars % 3)::INT AS class_pred FROM labels JOIN documents USING (doc_id))""",
    "sets": "sets AS (SELECT c_mktsegment AS name, 'well-' || lower(substr(c_mktsegment, 1, 1)) AS well, list_sort(list(c_custkey)) AS classes FROM customer GROUP BY c_mktsegment)",
}


def with_views(*names: str) -> str:
    """WITH clause (without a closing comma) of these views and those that they need."""
    needs = {"cyt": ["px"], "nuc": ["px"], "mosaic": ["px"]}
    order: list[str] = []
    for name in names:
        order += [x for x in [*needs.get(name, []), name] if x not in order]
    return "WITH " + ", ".join(SQL[x] for x in order)

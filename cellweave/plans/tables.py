"""Queries of the metadata, sampling, metric and registration operators, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, graphs, images, labels, metrics, plates, sampling
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


def _clusters(value: str, out: str) -> str:
    return f"""{out}_d AS (SELECT row_id, well, v, v - lag(v) OVER (PARTITION BY row_id, well ORDER BY v) AS gap FROM (SELECT DISTINCT row_id, well, {value} AS v FROM stage)),
    {out}_s AS (SELECT row_id, well, quantile_cont(gap, 0.9) FILTER (WHERE gap > 0) AS step FROM {out}_d GROUP BY 1, 2),
    {out}_j AS (SELECT row_id, well, quantile_cont(gap, 0.95) FILTER (WHERE gap > 0 AND gap <= step * 0.2) AS jitter, any_value(step) AS step FROM {out}_d JOIN {out}_s USING (row_id, well) GROUP BY 1, 2),
    {out}_n AS (SELECT row_id, well, v, sum(CASE WHEN gap > CASE WHEN jitter IS NULL THEN step * 0.05 ELSE greatest(jitter * 2, step * 0.01) END THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, well ORDER BY v ROWS UNBOUNDED PRECEDING)::INT AS {out} FROM {out}_d JOIN {out}_j USING (row_id, well))"""


_TILES = f"{with_views('stage')}, {_clusters('px', 'x_pos')}, {_clusters('py', 'y_pos')}, tiles AS (SELECT s.*, x_pos, y_pos FROM stage s JOIN x_pos_n a ON a.row_id = s.row_id AND a.well = s.well AND a.v = s.px JOIN y_pos_n b ON b.row_id = s.row_id AND b.well = s.well AND b.v = s.py)"


@query(f"{_TILES} SELECT row_id, well, tile_id, x_pos, y_pos FROM tiles")
def w1_tile_positions(spark, d):
    """Clusters of stage positions per well."""
    return plates.tile_positions(A.stage_positions(spark, d)).select("row_id", "well", "tile_id", "x_pos", "y_pos")


@query(f"{_TILES} SELECT tile_id, format('Timepoint001_Row{{}}_Well{{}}_Channel{{}}_r{{:03d}}_c{{:03d}}.tif', row_id, well, channel, y_pos, x_pos) AS filename, format('r{{:03d}}_c{{:03d}}', y_pos, x_pos) AS tile FROM tiles")
def p21_tile_names(spark, d):
    """P21, P22."""
    named = plates.tile_names(plates.tile_positions(A.stage_positions(spark, d)))
    return named.select("tile_id", "filename", plates.tile_id("filename").alias("tile"))


@query(f"""{_TILES}, h AS (SELECT well, row_id, max(y_pos) + 1 AS height FROM tiles GROUP BY 1, 2), o AS (SELECT well, row_id, coalesce(sum(height) OVER (PARTITION BY well ORDER BY row_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM h)
    SELECT tile_id, (y_pos + off)::BIGINT AS y_all FROM tiles JOIN o USING (well, row_id)""")
def w6_compressed_rows(spark, d):
    return plates.compressed_rows(plates.tile_positions(A.stage_positions(spark, d))).select("tile_id", F.col("y_all").cast("long").alias("y_all"))


@query(f"""{_TILES}, t AS (SELECT * FROM tiles WHERE tile_id % 9 <> 0), g AS (SELECT * FROM (SELECT DISTINCT row_id FROM t), (SELECT DISTINCT well FROM t), (SELECT DISTINCT x_pos FROM t), (SELECT DISTINCT y_pos FROM t), (SELECT DISTINCT channel FROM t))
    SELECT row_id, well, x_pos, y_pos, channel FROM g EXCEPT SELECT row_id, well, x_pos, y_pos, channel FROM t""")
def j9_missing_tiles(spark, d):
    tiles = plates.tile_positions(A.stage_positions(spark, d)).where("tile_id % 9 != 0")
    return plates.missing_tiles(tiles, ["row_id", "well", "x_pos", "y_pos", "channel"])


_RANKED = "r AS (SELECT *, CASE source WHEN 'first' THEN 0 ELSE 1 END AS rank, CASE WHEN tile_id % 4 = 0 THEN NULL ELSE 'tile-' || tile_id END AS file FROM tiles)"


@query(f"{_TILES}, {_RANKED} SELECT row_id, well, x_pos, y_pos, channel, (min_by(tile_id, (rank, tile_id))) AS tile_id, min_by(file, (rank, file)) FILTER (WHERE file IS NOT NULL) AS file FROM r GROUP BY row_id, well, x_pos, y_pos, channel")
def j10_first_measurement(spark, d):
    """Measurements in order complete each other."""
    tiles = plates.tile_positions(A.stage_positions(spark, d)).withColumn("rank", F.when(F.col("source") == "first", 0).otherwise(1))
    tiles = tiles.withColumn("file", F.when(F.col("tile_id") % 4 != 0, F.concat(F.lit("tile-"), F.col("tile_id"))))
    keys = ["row_id", "well", "x_pos", "y_pos", "channel"]
    return plates.first_measurement(tiles.select(*keys, "rank", "tile_id", "file"), keys, "rank")


@query("SELECT 'exp-' || c_mktsegment || '-' || strftime(make_timestamp((1500000000 + c_custkey * 1000)::BIGINT * 1000000), '%Y-%m-%dT%H_%M_%S') AS path, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer")
def s20_measurement_order(spark, d):
    rows = A.table(spark, d, "customer")
    stamp = F.date_format(F.timestamp_seconds(1500000000 + F.col("c_custkey") * 1000), "yyyy-MM-dd'T'HH_mm_ss")
    return plates.measurement_order(rows.select(F.concat(F.lit("exp-"), "c_mktsegment", F.lit("-"), stamp).alias("path"))).select("path", F.col("rank").cast("long").alias("rank"))


_HASH = "((doc_id * 2654435761) % 4294967296)"


@query(f"SELECT doc_id FROM documents ORDER BY {_HASH}, doc_id LIMIT 100")
def o1_sample(spark, d):
    """O1, O2, U-sets: n ids without replacement."""
    return sampling.sample_n(A.table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT n, floor(n * 0.7)::BIGINT AS a, floor(n * 0.2)::BIGINT AS b, floor(n * 0.1)::BIGINT AS c FROM n), e AS (SELECT a + (n - a - b - c >= 1)::INT AS a, b + (n - a - b - c >= 2)::INT AS b FROM s),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id % 4096, doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split FROM r, e""")
def o4_split_fractions(spark, d):
    return sampling.split_fractions(A.table(spark, d, "documents").select("doc_id"), [0.7, 0.2, 0.1], ["train", "val", "test"], "doc_id").select("doc_id", "split")


@query(f"""WITH s AS (SELECT doc_id, lang, source FROM documents), c AS (SELECT lang, source, count(*) AS n FROM s GROUP BY 1, 2), q AS (SELECT lang, source, round_even(10 * n / sum(n) OVER (PARTITION BY lang), 0)::BIGINT AS quota FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_HASH}, doc_id) AS k FROM s) SELECT doc_id, lang, source FROM r JOIN q USING (lang, source) WHERE k <= quota""")
def o3_balanced(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", "lang", "source")
    return sampling.balanced_per_class(rows, "lang", "source", "doc_id", 10).select("doc_id", "lang", "source")


@query("WITH n AS (SELECT least(greatest((count(*) + 7) // 8, 100), 1000) AS size FROM documents) SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS save_index, (row_number() OVER (ORDER BY doc_id) - 1) // size AS batch FROM documents, n")
def w5_batches(spark, d):
    """W4, W5."""
    out = sampling.batches(A.table(spark, d, "documents").select("doc_id"), "doc_id", 8)
    return out.select("doc_id", F.col("save_index").cast("long").alias("save_index"), F.col("batch").cast("long").alias("batch"))


@query("SELECT max_by('model-epoch=' || c_nationkey || '-' || c_custkey, (c_nationkey, 'model-epoch=' || c_nationkey || '-' || c_custkey)) AS name FROM customer")
def o6_best_checkpoint(spark, d):
    names = A.table(spark, d, "customer").select(F.concat(F.lit("model-epoch="), "c_nationkey", F.lit("-"), "c_custkey").alias("name"))
    return sampling.best_checkpoint(names)


@query(f"{with_views('scores')} SELECT count(*) FILTER (WHERE class_true = 1 AND class_pred = 1) / nullif(count(*) FILTER (WHERE class_pred = 1), 0) AS precision, count(*) FILTER (WHERE class_true = 1 AND class_pred = 1) / nullif(count(*) FILTER (WHERE class_true = 1), 0) AS recall FROM scores")
def a14_precision_recall(spark, d):
    """A14, A15."""
    return metrics.precision_recall(A.scores(spark, d), 1)


_CURVE = """byscore AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM scores GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM byscore WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT score, tp / nullif(pp, 0) AS tpr, fp / nullif(nn, 0) AS fpr, tp / (tp + fp) AS prec FROM c), st AS (SELECT fpr - lag(fpr, 1, 0) OVER o AS dx, tpr + lag(tpr, 1, 0) OVER o AS y, tpr - lag(tpr, 1, 0) OVER o AS dr, prec + lag(prec, 1, 1) OVER o AS p FROM q WINDOW o AS (ORDER BY score DESC))"""


@query(f"{with_views('scores')}, {_CURVE} SELECT round(sum(dx * y) / 2, 6) AS roc_auc, round(sum(dr * p) / 2, 6) AS pr_auc FROM st")
def a16_roc_pr_auc(spark, d):
    return metrics.roc_pr_auc(A.scores(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query(f"{with_views('scores')}, g AS (SELECT truth, (score >= 0.5)::INT AS guess FROM scores), c AS (SELECT count(*) FILTER (WHERE guess = 1 AND truth = 1) AS tp, count(*) FILTER (WHERE guess = 1 AND truth = 0) AS fp, count(*) FILTER (WHERE guess = 0 AND truth = 1) AS fn FROM g) SELECT 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c")
def a16_f1(spark, d):
    return metrics.f1_at(A.scores(spark, d))


@query(f"""{with_views('scores')}, g AS (SELECT a::INT AS class_true, b::INT AS class_pred FROM range(3) AS x(a), range(3) AS y(b)), c AS (SELECT class_true::INT AS class_true, class_pred, count(*) AS n FROM scores GROUP BY 1, 2), f AS (SELECT class_true, class_pred, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (class_true, class_pred))
    SELECT class_true, class_pred, n, round(n / nullif(sum(n) OVER (PARTITION BY class_true), 0), 2) AS share FROM f""")
def a17_confusion(spark, d):
    return metrics.confusion(A.scores(spark, d), [0, 1, 2], normalize=True)


@query(f"{with_views('scores')} SELECT class_pred AS \"class\", count(*) FILTER (WHERE class_true = class_pred) / count(*) AS precision, count(*) AS n FROM scores GROUP BY class_pred")
def a18_class_precision(spark, d):
    return metrics.class_precision(A.scores(spark, d))


@query(f"{with_views('scores')}, p AS (SELECT class_true::INT AS c, 0::INT AS entry, score AS p FROM scores UNION ALL SELECT class_true::INT, 1::INT, 1 - score FROM scores) SELECT c AS \"class\", entry, round(avg(p), 6) AS p FROM p GROUP BY 1, 2")
def a18_mean_probabilities(spark, d):
    pred = A.scores(spark, d).select(F.col("class_true").cast("int").alias("class_true"), F.array(F.col("score"), 1 - F.col("score")).alias("probs"))
    return metrics.mean_probabilities(pred, "probs").select("class", "entry", F.round("p", 6).alias("p"))


@query(f"{with_views('scores')} SELECT round(avg(pow(score - truth, 2)), 6) AS mse, round(avg(abs(score - truth)), 6) AS mae, round(avg(CASE WHEN abs(score - truth) <= 0.5 THEN pow(score - truth, 2) / 2 ELSE 0.5 * (abs(score - truth) - 0.25) END), 6) AS huber FROM scores")
def u21_regression_losses(spark, d):
    return metrics.regression_losses(A.scores(spark, d), "truth", "score", 0.5).select(*[F.round(c, 6).alias(c) for c in ("mse", "mae", "huber")])


@query("SELECT quality, count(*) AS n FROM labels GROUP BY ROLLUP (quality)")
def a19_label_counts(spark, d):
    return metrics.class_counts(A.table(spark, d, "labels"), "quality")


@query(f"{with_views('sets')} SELECT name, well, unnest(classes) AS cell_id FROM sets")
def j14_cell_ids(spark, d):
    """D11, J14, P25."""
    return A.cell_sets(spark, d)


@query(f"{with_views('sets')} SELECT well, list_sort(list(name)) AS names FROM sets GROUP BY well")
def j13_region_lookup(spark, d):
    """Region to tables."""
    return A.cell_sets(spark, d).select("name", "well").distinct().groupBy("well").agg(F.sort_array(F.collect_list("name")).alias("names"))


@query(f"{with_views('px', 'nuc')}, c AS (SELECT cell_id, count(*) AS n FROM nuc GROUP BY cell_id), i AS (SELECT DISTINCT image_id + 1 AS cell_id, (image_id + 1) * 7 % 101 AS position FROM px WHERE image_id % 10 = 0) SELECT cell_id, position, n FROM i JOIN c USING (cell_id)")
def j12_images_by_id(spark, d):
    """Rows of chosen ids, with the order asked for."""
    px = A.pixels(spark, d)
    ids = px.where("image_id % 10 = 0").select((F.col("image_id") + 1).alias("cell_id")).distinct().withColumn("position", F.col("cell_id") * 7 % 101)
    return features.lookup(labels.label_sizes(A.nuclei(px)), ids).select("cell_id", "position", "n")


@query("SELECT doc_id, CASE WHEN lang = '' THEN NULL ELSE lang END AS label, (row_number() OVER (ORDER BY doc_id) - 1) AS idx FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s26_locator(spark, d):
    """Rows for training with a label column and their place in the file."""
    docs = A.table(spark, d, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("")).alias("label")).join(A.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    from ..functions.ranking import running_sum

    return running_sum(docs, "doc_id", name="idx").select("doc_id", "label", F.col("idx").cast("long").alias("idx"))


@query(f"{with_views('px')} SELECT image_id AS cell_id, round(avg(v), 6) AS mean, round(ln(max(value) + 1e-9), 6) AS log_max FROM px GROUP BY image_id")
def u1_inference(spark, d):
    """A stand-in model over single-cell images in batches, and the logarithm of an output."""
    images_ = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), "embedding")

    def model(pdf):
        import numpy as np
        import pandas as pd

        data = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 64))
        return pd.DataFrame({"cell_id": pdf["cell_id"], "mean": data.mean(1), "top": np.maximum(np.floor((data.max(1, initial=-2) + 1) * 10000), 0)})

    out = features.infer(images_, model, "cell_id long, mean double, top double")
    return out.select("cell_id", F.round("mean", 6).alias("mean"), F.round(features.log_transform(F.col("top")), 6).alias("log_max"))


@query()
def i2_segment_global_threshold(spark, d):
    """Otsu threshold, peaks, watershed; labels per image."""
    return images.segment_threshold(A.pixels(spark, d), speckle=0)


@query()
def i3_segment_local_threshold(spark, d):
    return images.segment_local(A.pixels(spark, d))


@query(f"""{with_views('px', 'nuc')}, s AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM nuc GROUP BY image_id), near AS (SELECT image_id, y + oy AS y, x + ox AS x, min(cell_id) AS cell_id FROM nuc, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(oy, ox) GROUP BY 1, 2, 3)
    SELECT image_id, y::INT AS y, x::INT AS x, coalesce(nuc.cell_id, near.cell_id) AS cell_id FROM near FULL JOIN nuc USING (image_id, y, x) JOIN s USING (image_id) WHERE y >= 0 AND x >= 0 AND y < h AND x < w""")
def i15_expand_nuclei(spark, d):
    nuc = A.nuclei(A.pixels(spark, d)).withColumn("value", F.col("cell_id"))
    return images.expand_nuclei(nuc, 1)


@query()
def i17_segment_cytosol(spark, d):
    return images.segment_cytosol(A.pixels(spark, d))


def _blurred(sigma: float, source: str) -> str:
    """Views: weights of the kernel, and `blurred` of source(image_id, y, x, v), borders repeated."""
    reach = int(4 * sigma + 0.5)
    one = lambda axis, other, inner: f"SELECT p.image_id, p.y, p.x, sum(w * q.v) AS v FROM {inner} p CROSS JOIN weight JOIN {inner} q ON q.image_id = p.image_id AND q.{other} = p.{other} AND q.{axis} = least(greatest(p.{axis} + i, 0), 7) GROUP BY 1, 2, 3"
    return f"""raw_weight AS (SELECT i, exp(-0.5 * pow(i / {sigma}, 2)) AS w FROM range({-reach}, {reach + 1}) t(i)), weight AS (SELECT i, w / (SELECT sum(w) FROM raw_weight) AS w FROM raw_weight),
    down AS ({one('y', 'x', source)}), blurred AS ({one('x', 'y', 'down')})"""


@query(f"{with_views('px')}, src AS (SELECT image_id, y, x, value::DOUBLE AS v FROM px), {_blurred(1.0, 'src')} SELECT image_id, y, x, round(v, 3) AS out FROM blurred")
def p30_gaussian_blur(spark, d):
    return images.blur(A.pixels(spark, d), 1.0).withColumn("out", F.round("out", 3))


@query(f"""{with_views('px')}, src AS (SELECT image_id, y, x, (value - min(value) OVER i) / nullif(max(value) OVER i - min(value) OVER i, 0)::DOUBLE AS v FROM px WINDOW i AS (PARTITION BY image_id)), {_blurred(2.0, 'src')},
    lit AS (SELECT src.*, blurred.v AS b, max(blurred.v) OVER (PARTITION BY src.image_id) AS bright FROM src JOIN blurred USING (image_id, y, x)) SELECT image_id, y, x, round(greatest(0, least(1, v + CASE WHEN v < b THEN bright - b ELSE 0 END)), 6) AS out FROM lit""")
def i21_illumination(spark, d):
    return images.illumination(A.pixels(spark, d)).withColumn("out", F.round("out", 6))


@query()
def i19_register_neighbours(spark, d):
    """Shifts between neighbouring tiles."""
    rows = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("source"))
    pairs = rows.join(rows.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("source").alias("target")), "a").select("a", "b", "source", "target")
    return images.register_pairs(pairs, A.SIDE)


def _tile_graph(spark, d):
    """All customers as tiles in chains of 1,009."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    edges = c.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(c.select(F.col("node").alias("b")).hint("merge"), "b").where("a % 1009 != 0")
    return c, edges.select("a", "b", F.lit(8.0).alias("dy"), (F.col("a") % 3 - 1.0).alias("dx"), F.lit(1.0).alias("error"))


@query("""WITH n AS (SELECT c_custkey AS node FROM customer), s AS (SELECT node, CASE WHEN lag(node) OVER (ORDER BY node) IS NULL OR lag(node) OVER (ORDER BY node) % 1009 = 0 OR lag(node) OVER (ORDER BY node) <> node - 1 THEN 1 ELSE 0 END AS opens FROM n),
    g AS (SELECT node, sum(opens) OVER (ORDER BY node ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT node, min(node) OVER (PARTITION BY k) AS component FROM g""")
def g3_components(spark, d):
    """Connected tiles."""
    return graphs.components(*_tile_graph(spark, d))


@query("""WITH n AS (SELECT c_custkey AS node FROM customer), s AS (SELECT node, CASE WHEN lag(node) OVER (ORDER BY node) IS NULL OR lag(node) OVER (ORDER BY node) % 1009 = 0 THEN 1 ELSE 0 END AS opens FROM n),
    g AS (SELECT node, sum(opens) OVER (ORDER BY node ROWS UNBOUNDED PRECEDING) AS k FROM s), c AS (SELECT node, k, min(node) OVER (PARTITION BY k) AS component, row_number() OVER (PARTITION BY k ORDER BY node) AS r, count(*) OVER (PARTITION BY k) AS size FROM g)
    SELECT component, node AS centre FROM c WHERE r = (size + 1) // 2""")
def g7_centre_nodes(spark, d):
    nodes, edges = _tile_graph(spark, d)
    return graphs.centre_nodes(nodes, edges, graphs.components(nodes, edges))


_CHAINS = """WITH n AS (SELECT c_custkey AS node FROM customer), s AS (SELECT node, CASE WHEN lag(node) OVER (ORDER BY node) IS NULL OR lag(node) OVER (ORDER BY node) % 1009 = 0 THEN 1 ELSE 0 END AS opens FROM n),
    g AS (SELECT node, sum(opens) OVER (ORDER BY node ROWS UNBOUNDED PRECEDING) AS k FROM s), c AS (SELECT node, k, min(node) OVER (PARTITION BY k) AS component, row_number() OVER (PARTITION BY k ORDER BY node) AS r, count(*) OVER (PARTITION BY k) AS size FROM g),
    p AS (SELECT *, coalesce(sum(node % 3 - 1.0) OVER (PARTITION BY k ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS px FROM c), z AS (SELECT k, r AS rc, px AS pc FROM p WHERE r = (size + 1) // 2)"""


@query(_CHAINS + " SELECT node, component, ((r - rc) * 8)::DOUBLE AS y, (px - pc)::DOUBLE AS x FROM p JOIN z USING (k)")
def g5_positions(spark, d):
    """Shifts added up from each component's centre."""
    nodes, edges = _tile_graph(spark, d)
    centres = graphs.centre_nodes(nodes, edges, graphs.components(nodes, edges))
    return graphs.positions(edges, centres).select("node", "component", "y", "x")


_MAP = """f AS (SELECT node, component, ((r - rc) * 8)::DOUBLE AS y, (px - pc)::DOUBLE AS x, node * 8.0::DOUBLE AS ny, (node % 7)::DOUBLE AS nx FROM p JOIN z USING (k)),
    main AS (SELECT component AS c FROM f GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
    m AS (SELECT avg(ny) AS mny, avg(nx) AS mnx, avg(y) AS my, avg(x) AS mx, var_pop(ny) AS yy, var_pop(nx) AS xx, covar_pop(ny, nx) AS yx, covar_pop(ny, y) AS ny_y, covar_pop(ny, x) AS ny_x, covar_pop(nx, y) AS nx_y, covar_pop(nx, x) AS nx_x FROM f, main WHERE component = c),
    l AS (SELECT *, yy * xx - yx * yx AS det FROM m), k2 AS (SELECT *, CASE WHEN abs(det) < 1e-3 THEN 1 ELSE (ny_y * xx - nx_y * yx) / det END AS a, CASE WHEN abs(det) < 1e-3 THEN 0 ELSE (ny_x * xx - nx_x * yx) / det END AS b,
        CASE WHEN abs(det) < 1e-3 THEN 0 ELSE (nx_y * yy - ny_y * yx) / det END AS c2, CASE WHEN abs(det) < 1e-3 THEN 1 ELSE (nx_x * yy - ny_x * yx) / det END AS d2 FROM l),
    o AS (SELECT component, avg(my + a * (ny - mny) + c2 * (nx - mnx) - y) AS oy, avg(mx + b * (ny - mny) + d2 * (nx - mnx) - x) AS ox FROM f, k2 GROUP BY component),
    q AS (SELECT node, component, y + CASE WHEN component = c THEN 0 ELSE oy END AS y, x + CASE WHEN component = c THEN 0 ELSE ox END AS x FROM f JOIN o USING (component), main)
    SELECT node, component, round(y - (SELECT min(y) FROM q), 4) AS y, round(x - (SELECT min(x) FROM q), 4) AS x FROM q"""


@query(_CHAINS + ", " + _MAP)
def g6_fit_positions(spark, d):
    """All chains in one frame, by the linear map of the largest."""
    nodes, edges = _tile_graph(spark, d)
    centres = graphs.centre_nodes(nodes, edges, graphs.components(nodes, edges))
    nominal = nodes.select("node", (F.col("node") * 8.0).alias("y"), (F.col("node") % 7 * 1.0).alias("x"))
    out = graphs.fit_positions(graphs.positions(edges, centres), nominal)
    return out.select("node", "component", F.round("y", 4).alias("y"), F.round("x", 4).alias("x"))

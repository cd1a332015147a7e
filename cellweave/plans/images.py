"""Queries of the image, mask and feature operators over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, features, labels, pixels, sets, tiling
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


def r6(c, name: str):
    return F.round(c, 6).alias(name)


_KEY = "image_id, y, x"


@query(f"{with_views('px')} SELECT {_KEY}, value FROM px")
def s1_pixels(spark, d):
    """Arrays as a pixel table."""
    return A.pixels(spark, d).select("image_id", "y", "x", "value")


@query(f"{with_views('px')} SELECT {_KEY}, trunc(least(greatest((value::DOUBLE - 8000) / 4000, 0), 1) * 65535)::INT AS normalized FROM px")
def p3_range_normalization(spark, d):
    """P1, P2, P3."""
    return pixels.normalize_range(A.pixels(spark, d), 8000, 12000).select("image_id", "y", "x", "normalized")


_QN = "least(greatest(CASE WHEN hi = lo THEN value - lo ELSE (value - lo) / nullif(hi - lo, 0) END, 0), 1)"


@query(f"""{with_views('px')}, b AS (SELECT image_id, quantile_cont(value::DOUBLE, 0.001) AS lo, quantile_cont(value::DOUBLE, 0.999) AS hi FROM px GROUP BY image_id)
    SELECT {_KEY}, round({_QN}, 6) AS normalized FROM px JOIN b USING (image_id)""")
def p4_percentile_normalization(spark, d):
    """P4, P5, P11."""
    return pixels.normalize_quantiles(A.pixels(spark, d)).select("image_id", "y", "x", r6(F.col("normalized"), "normalized"))


@query(f"""{with_views('px')}, b AS (SELECT image_id, CASE WHEN max(value) > 12000 THEN quantile_cont(CASE WHEN value < 12000 THEN value::DOUBLE END, 0.05) ELSE quantile_cont(value::DOUBLE, 0.05) END AS lo,
    CASE WHEN max(value) > 12000 THEN quantile_cont(CASE WHEN value < 12000 THEN value::DOUBLE END, 0.95) ELSE quantile_cont(value::DOUBLE, 0.95) END AS hi FROM px GROUP BY image_id)
    SELECT {_KEY}, round({_QN}, 6) AS normalized FROM px JOIN b USING (image_id)""")
def p6_rescale_with_cutoff(spark, d):
    """Percentiles below a cutoff where it is exceeded."""
    return pixels.rescale_with_cutoff(A.pixels(spark, d), ["image_id"], 5, 95, 12000, top=None).select("image_id", "y", "x", r6(F.col("normalized"), "normalized"))


@query(f"""{with_views('px')}, b AS (SELECT image_id, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM px GROUP BY image_id)
    SELECT {_KEY}, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END, 6) AS normalized FROM px JOIN b USING (image_id)""")
def p7_min_max(spark, d):
    return pixels.min_max(A.pixels(spark, d)).select("image_id", "y", "x", r6(F.col("normalized"), "normalized"))


@query(f"""{with_views('px')}, b AS (SELECT image_id, floor(quantile_cont(value::DOUBLE, 0.25)) AS lo, floor(quantile_cont(value::DOUBLE, 0.75)) AS hi FROM px GROUP BY image_id)
    SELECT {_KEY}, trunc({_QN} * 65535)::INT AS normalized FROM px JOIN b USING (image_id)""")
def p8_normalize_truncated_bounds(spark, d):
    """Integer bounds, then back to 16 bits."""
    out = pixels.normalize_quantiles(A.pixels(spark, d), low=0.25, high=0.75, truncate=True)
    return out.select("image_id", "y", "x", pixels.to_uint(F.col("normalized")).alias("normalized"))


def _stack(spark, d):
    """Every four images as the planes (and channels) of one stack."""
    px = A.pixels(spark, d)
    return px.select(F.expr("image_id div 4").alias("stack"), (F.col("image_id") % 4).cast("int").alias("z"), "y", "x", "value")


_STACK = "stack AS (SELECT image_id // 4 AS stack, (image_id % 4)::INT AS z, y, x, value FROM px)"


@query(f"{with_views('px')}, {_STACK} SELECT stack, y, x, max(value)::INT AS value FROM stack WHERE z IN (0, 2) GROUP BY stack, y, x")
def p12_project_channels(spark, d):
    """Channels selected, then the largest value from 0 up."""
    return pixels.max_projection(_stack(spark, d).where("z in (0, 2)"), ["stack", "y", "x"], floor=0).select("stack", "y", "x", F.col("value").cast("int").alias("value"))


@query(f"{with_views('px')}, {_STACK} SELECT stack, y, x, max(value) AS value FROM stack GROUP BY stack, y, x")
def p13_max_intensity(spark, d):
    return pixels.max_projection(_stack(spark, d), ["stack", "y", "x"])


@query(f"{with_views('px')}, {_STACK} SELECT stack, CASE z WHEN 2 THEN 0 ELSE 1 END::INT AS c, y, x, value FROM stack WHERE z IN (0, 2)")
def p26_channel_selector(spark, d):
    """P14, P26, S1's remap."""
    return pixels.select_channels(_stack(spark, d).withColumnRenamed("z", "c"), [2, 0]).select("stack", "c", "y", "x", "value")


@query(f"{with_views('px')} SELECT image_id, c::INT AS c, y, x, value FROM px, range(3) AS r(c)")
def p27_channel_multiplier(spark, d):
    px = A.pixels(spark, d).withColumn("c", F.lit(0))
    return pixels.repeat_channel(px, 3).select("image_id", "c", "y", "x", "value")


@query(f"{with_views('px')} SELECT image_id, (CASE image_id % 4 WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END)::INT AS y, (CASE image_id % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END)::INT AS x, value FROM px")
def p29_right_angle_rotation(spark, d):
    px = A.pixels(spark, d)
    return pixels.rotate_right_angle(px, F.col("image_id") % 4, A.SIDE).select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")


@query(f"""{with_views('px')}, b AS (SELECT image_id, quantile_cont(value::DOUBLE, 0.1) AS base FROM px GROUP BY image_id), s AS (SELECT {_KEY}, value - base AS v FROM px JOIN b USING (image_id)),
    t AS (SELECT image_id, quantile_cont(v, 0.9) AS top FROM s GROUP BY image_id)
    SELECT {_KEY}, round(least(greatest(v / nullif(top, 0), 0), 1), 6) AS r, round(least(greatest(v / nullif(top, 0), 0), 1) * 0.5, 6) AS g, round(least(greatest(v / nullif(top, 0), 0), 1) * 0.0, 6) AS b FROM s JOIN t USING (image_id)""")
def p23_colorize(spark, d):
    out = pixels.colorize(A.pixels(spark, d), (1.0, 0.5, 0.0), clip=10)
    return out.select("image_id", "y", "x", *[r6(F.col(c), c) for c in "rgb"])


@query(f"""{with_views('px')}, l AS (SELECT image_id // 2 AS pair, image_id % 2 AS k, y, x, least(value / 14000, 1) AS unit FROM px)
    SELECT pair, y, x, round(least(sum(unit * CASE k WHEN 0 THEN 1 ELSE 0.25 END), 1), 6) AS r, round(least(sum(unit * CASE k WHEN 0 THEN 0.5 ELSE 0.5 END), 1), 6) AS g, round(least(sum(unit * CASE k WHEN 0 THEN 0 ELSE 1 END), 1), 6) AS b FROM l GROUP BY pair, y, x""")
def p24_composite(spark, d):
    px, unit = A.pixels(spark, d), F.least(F.col("value") / 14000, F.lit(1.0))
    first = F.col("image_id") % 2 == 0
    parts = {"r": (1.0, 0.25), "g": (0.5, 0.5), "b": (0.0, 1.0)}
    layers = px.select(F.expr("image_id div 2").alias("pair"), "y", "x", *[(unit * F.when(first, a).otherwise(b)).alias(c) for c, (a, b) in parts.items()])
    return pixels.composite(layers, ["pair", "y", "x"]).select("pair", "y", "x", *[r6(F.col(c), c) for c in "rgb"])


@query(f"{with_views('px', 'nuc')} SELECT image_id, y, x, cell_id, dense_rank() OVER (ORDER BY cell_id) AS new_id FROM nuc")
def p18_dense_labels(spark, d):
    return labels.dense_labels(A.nuclei(A.pixels(spark, d))).select("image_id", "y", "x", "cell_id", "new_id")


_BORDER = "(SELECT DISTINCT cell_id FROM mosaic WHERE cell_id <> 0 AND (y IN (0, (SELECT max(y) FROM mosaic)) OR x IN (0, (SELECT max(x) FROM mosaic))))"


def _mosaic(spark, d):
    m = A.mosaic(A.pixels(spark, d))
    ends = m.agg(F.max("y"), F.max("x")).first()
    return m, (ends[0] or 0) + 1, (ends[1] or 0) + 1


@query(f"{with_views('mosaic')} SELECT y, x, cell_id + 10 AS cell_id FROM mosaic WHERE cell_id <> 0 AND cell_id NOT IN {_BORDER}")
def p19_shift_labels(spark, d):
    """P19 without labels at borders."""
    m, h, w = _mosaic(spark, d)
    return labels.shift_labels(m.where("cell_id != 0"), 10, h, w, remove_edges=True).select("y", "x", "cell_id")


@query(f"{with_views('mosaic')} SELECT y, x, CASE WHEN cell_id <> 0 THEN cell_id - 1 ELSE cell_id END AS cell_id FROM mosaic")
def p20_subtract(spark, d):
    return pixels.subtract_from_labels(_mosaic(spark, d)[0], 1).select("y", "x", "cell_id")


@query(f"{with_views('mosaic')} SELECT cell_id FROM {_BORDER}")
def f1_edge_labels(spark, d):
    m, h, w = _mosaic(spark, d)
    return labels.edge_labels(m, h, w)


@query(f"{with_views('px', 'nuc')} SELECT DISTINCT image_id, cell_id FROM nuc WHERE y IN (0, 7) OR x IN (0, 7)")
def f2_edge_labels_by_image(spark, d):
    return labels.edge_labels(A.nuclei(A.pixels(spark, d)), A.SIDE, A.SIDE, ["image_id"])


@query(f"{with_views('mosaic')} SELECT y, x, cell_id FROM mosaic WHERE cell_id <> 0 AND cell_id NOT IN {_BORDER}")
def f3_remove_edge_labels(spark, d):
    m, h, w = _mosaic(spark, d)
    return labels.remove_edge_labels(m.where("cell_id != 0"), h, w).select("y", "x", "cell_id")


@query(f"""{with_views('px', 'nuc')}, gone AS (SELECT DISTINCT cell_id FROM nuc WHERE cell_id % 5 = 0), ids AS (SELECT DISTINCT cell_id FROM nuc WHERE cell_id % 5 <> 0),
    new AS (SELECT i.cell_id, i.cell_id - (SELECT count(*) FROM gone g WHERE g.cell_id < i.cell_id) AS new_id FROM ids i) SELECT image_id, y, x, new_id AS cell_id FROM nuc JOIN new USING (cell_id)""")
def f4_remove_and_reindex(spark, d):
    """F4, F5."""
    nuc = A.nuclei(A.pixels(spark, d))
    return labels.compact_after_removal(nuc, nuc.where("cell_id % 5 = 0").select("cell_id"))


@query(f"{with_views('px', 'nuc')} SELECT image_id, y, x, cell_id FROM nuc WHERE cell_id IN (SELECT cell_id FROM nuc GROUP BY cell_id HAVING count(*) BETWEEN 8 AND 20)")
def f6_size_filter(spark, d):
    return labels.size_filter(A.nuclei(A.pixels(spark, d)), 8, 20).select("image_id", "y", "x", "cell_id")


_INTERIOR = """i AS (SELECT * FROM mosaic WHERE y BETWEEN 1 AND (SELECT max(y) - 1 FROM mosaic) AND x BETWEEN 1 AND (SELECT max(x) - 1 FROM mosaic)),
    n AS (SELECT i.cell_id, m.cell_id AS other FROM i, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dy, dx) JOIN mosaic m ON m.y = i.y + o.dy AND m.x = i.x + o.dx),
    c AS (SELECT cell_id, count(*) FILTER (WHERE other = 0) AS b, count(*) FILTER (WHERE other <> cell_id) AS f FROM n GROUP BY cell_id),
    p AS (SELECT cell_id, (1 + coalesce(b, 0)) / (1 + coalesce(f, 0)) AS proportion FROM (SELECT DISTINCT cell_id FROM mosaic) LEFT JOIN c USING (cell_id))"""


@query(f"{with_views('mosaic')}, {_INTERIOR} SELECT cell_id, round(proportion, 6) AS proportion FROM p")
def a6_contact_proportion(spark, d):
    m, h, w = _mosaic(spark, d)
    return labels.contact_proportion(m, h, w).select("cell_id", r6(F.col("proportion"), "proportion"))


@query(f"{with_views('mosaic')}, {_INTERIOR} SELECT y, x, CASE WHEN proportion < 0.6 THEN 0 ELSE cell_id END AS cell_id FROM mosaic JOIN p USING (cell_id)")
def f7_contact_filter(spark, d):
    m, h, w = _mosaic(spark, d)
    return labels.contact_filter(m, h, w, 0.6).select("y", "x", "cell_id")


_FIT = "fit AS (SELECT avg(ln(n)) AS mu, sqrt(var_pop(ln(n)) + 1e-6) AS sigma FROM sizes), lim AS (SELECT exp(mu - 1.959963984540054 * sigma) AS lo, exp(mu + 1.959963984540054 * sigma) AS hi FROM fit)"


@query(f"{with_views('px', 'nuc')}, sizes AS (SELECT cell_id, count(*) AS n FROM nuc GROUP BY cell_id), {_FIT} SELECT cell_id, n FROM sizes, lim WHERE n < lo OR n > hi")
def f8_size_outliers(spark, d):
    """A normal fit to log sizes."""
    return labels.size_outliers(A.nuclei(A.pixels(spark, d)))


@query(f"{with_views('px', 'nuc')}, sizes AS (SELECT cell_id, count(*) AS n FROM nuc GROUP BY cell_id), {_FIT} SELECT round(lo, 6) AS low, round(hi, 6) AS high FROM lim")
def a7_size_thresholds(spark, d):
    return labels.size_thresholds(labels.label_sizes(A.nuclei(A.pixels(spark, d)))).select(r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query(f"{with_views('px', 'nuc')} SELECT image_id, bool_or(value > 13000) AS any_bright, bool_and(value > 7000) AS all_lit FROM px GROUP BY image_id")
def f15_any_all(spark, d):
    """F15, F16."""
    px = A.pixels(spark, d).withColumns({"bright": (F.col("value") > 13000).cast("int"), "lit": (F.col("value") > 7000).cast("int")})
    return labels.any_nonzero(px, ["image_id"], "bright").join(labels.all_nonzero(px, ["image_id"], "lit"), "image_id").select("image_id", F.col("any").alias("any_bright"), F.col("all").alias("all_lit"))


@query(f"{with_views('px', 'nuc')} SELECT image_id, y, x, cell_id, (CASE WHEN cell_id % 3 = 0 THEN 2 ELSE 1 END)::INT AS kept FROM nuc")
def f17_recode_classes(spark, d):
    nuc = A.nuclei(A.pixels(spark, d))
    return labels.recode_selected(nuc, nuc.where("cell_id % 3 = 0")).select("image_id", "y", "x", "cell_id", "kept")


_BOX = "b AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM mosaic), c AS (SELECT least(greatest(10, 16), h - 16) AS cy, least(greatest(w - 3, 16), w - 16) AS cx FROM b)"


@query(f"{with_views('mosaic')}, {_BOX} SELECT y - cy + 16 AS y, x - cx + 16 AS x, value FROM mosaic, c WHERE y >= cy - 16 AND y < cy + 16 AND x >= cx - 16 AND x < cx + 16")
def f14_bounding_box(spark, d):
    """A box whose centre is kept so far inside that it doesn't leave the image."""
    m, h, w = _mosaic(spark, d)
    cy, cx = min(max(10, 16), h - 16), min(max(w - 3, 16), w - 16)
    near = m.where((F.col("y") >= cy - 16) & (F.col("y") < cy + 16) & (F.col("x") >= cx - 16) & (F.col("x") < cx + 16))
    return near.select((F.col("y") - cy + 16).alias("y"), (F.col("x") - cx + 16).alias("x"), "value")


@query(f"{with_views('px', 'nuc')} SELECT cell_id, round(avg(y), 6) AS y, round(avg(x), 6) AS x, count(*) AS n FROM nuc GROUP BY cell_id")
def a1_centroids(spark, d):
    """A1, A2, A3, A10, A11."""
    return labels.centroids(A.nuclei(A.pixels(spark, d))).select("cell_id", r6(F.col("y"), "y"), r6(F.col("x"), "x"), "n")


def _cells(spark, d):
    px = A.pixels(spark, d)
    nuc = A.nuclei(px).select("image_id", "y", "x", F.lit(True).alias("n"))
    both = px.join(nuc, ["image_id", "y", "x"], "left")
    return both.select((F.col("image_id") + 1).alias("cell_id"), F.coalesce("n", F.lit(False)).alias("nucleus"), (F.col("y").between(1, 6) & F.col("x").between(1, 6)).alias("cytosol"), F.col("value").alias("dna"), (20000 - F.col("value")).alias("rna"))


def _stats_sql(channel: str, value: str, mask: str, on: str) -> str:
    v = f"CASE WHEN {on} THEN {value}::DOUBLE END"
    return ", ".join(
        f"round({e}, 6) AS {channel}_{s}_{mask}"
        for s, e in zip(features.STATS, (f"avg({v})", f"quantile_cont({v}, 0.5)", f"quantile_cont({v}, 0.75)", f"quantile_cont({v}, 0.25)", f"coalesce(sum({v}), 0)", f"coalesce(sum({v}), 0) / nullif(count(*) FILTER (WHERE {on}), 0)"), strict=True)
    )


_MASKS = {"nucleus": "nucleus", "cytosol": "cytosol", "cytosol_only": "nucleus <> cytosol"}
_CELLS = f"{with_views('px', 'nuc')}, cells AS (SELECT px.image_id + 1 AS cell_id, nuc.cell_id IS NOT NULL AS nucleus, y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AS cytosol, value AS dna, 20000 - value AS rna FROM px LEFT JOIN nuc USING (image_id, y, x))"
_FEATURES = f"SELECT cell_id, {', '.join(f'count(*) FILTER (WHERE {on}) AS {m}_area' for m, on in _MASKS.items())}, {', '.join(_stats_sql(c, c, m, on) for c in ('dna', 'rna') for m, on in _MASKS.items())} FROM cells GROUP BY cell_id"


@query(f"{_CELLS} {_FEATURES}")
def a4_cell_statistics(spark, d):
    """Areas and intensity statistics per cell, channel and mask."""
    return features.cell_statistics(_cells(spark, d), ["nucleus", "cytosol"], ["dna", "rna"], digits=6)


@query(f"{_CELLS}, f AS ({_FEATURES}) SELECT cell_id, CASE WHEN nucleus_area > 20 THEN 'large' ELSE 'small' END AS cell_set, nucleus_area FROM f WHERE nucleus_area > 20 OR nucleus_area < 12")
def e2e_select_cells(spark, d):
    """The reference flow's last query: features, thresholds on an area, named cell sets."""
    f = features.cell_statistics(_cells(spark, d), ["nucleus", "cytosol"], ["dna"])
    return f.where("nucleus_area > 20 or nucleus_area < 12").select("cell_id", F.when(F.col("nucleus_area") > 20, "large").otherwise("small").alias("cell_set"), "nucleus_area")


@query(f"""{with_views('lines')} SELECT cell_id, count(*) FILTER (WHERE x > 10) AS body_area, {', '.join(_stats_sql('value', 'value', 'body', 'x > 10').split(', ', 99))} FROM lines GROUP BY cell_id""")
def u3_single_channel_statistics(spark, d):
    """Statistics of one channel, over the larger pixel table."""
    cells = A.line_pixels(spark, d).withColumn("body", F.col("x") > 10)
    return features.cell_statistics(cells, ["body"], ["value"], digits=6)


_OTSU = """e AS (SELECT min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM px), k AS (SELECT least(floor((value - lo) / nullif((hi - lo) / 512, 0)), 511)::INT AS k, count(*) AS n FROM px, e GROUP BY 1),
    g AS (SELECT i::INT AS k, coalesce(n, 0) AS n, lo + (i + 0.5) * ((hi - lo) / 512) AS centre FROM range(512) AS r(i) CROSS JOIN e LEFT JOIN k ON k.k = i),
    w AS (SELECT k, centre, sum(n) OVER u AS ln, sum(n) OVER dn AS hn, sum(n * centre) OVER u AS lw, sum(n * centre) OVER dn AS hw FROM g WINDOW u AS (ORDER BY k ROWS UNBOUNDED PRECEDING), dn AS (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    s AS (SELECT k, centre, ln * hn * pow(lw / nullif(ln, 0) - hw / nullif(hn, 0), 2) AS spread FROM w WHERE k < 511)"""


@query(f"{with_views('px')}, {_OTSU} SELECT round(centre, 6) AS threshold FROM s ORDER BY spread DESC NULLS LAST, k LIMIT 1")
def a9_global_otsu(spark, d):
    return labels.otsu_threshold(A.pixels(spark, d)).select(r6(F.col("threshold"), "threshold"))


_MATCH = """m AS (SELECT n.cell_id AS nid, c.cell_id AS cid FROM nuc n LEFT JOIN cyt c USING (image_id, y, x)), p AS (SELECT nid, cid, count(*) AS n FROM m GROUP BY nid, cid),
    w AS (SELECT nid, sum(n) AS size, bool_and(cid IS NOT NULL) AS inside FROM p GROUP BY nid), matches AS (SELECT nid AS nucleus_id, min(cid) AS cytosol_id FROM p JOIN w USING (nid) WHERE inside AND n >= 0.5 * size GROUP BY nid)"""
_ONE = "lookup AS (SELECT * FROM matches WHERE cytosol_id IN (SELECT cytosol_id FROM matches GROUP BY cytosol_id HAVING count(*) = 1))"


def _matches(spark, d):
    px = A.pixels(spark, d)
    nuc, cyt = A.nuclei(px), A.cytosol(px)
    matched = nuc.withColumnRenamed("cell_id", "n").select("image_id", "y", "x", F.col("n").alias("cell_id"))
    return nuc, cyt, labels.match_nuclei(matched, cyt, by=["image_id"])


@query(f"{with_views('nuc', 'cyt')}, {_MATCH} SELECT nucleus_id, cytosol_id FROM matches")
def j1_match_nuclei(spark, d):
    return _matches(spark, d)[2].select("nucleus_id", "cytosol_id")


@query(f"{with_views('nuc', 'cyt')}, {_MATCH}, {_ONE} SELECT nucleus_id, cytosol_id FROM lookup")
def j2_lookup_table(spark, d):
    return labels.one_to_one(_matches(spark, d)[2]).select("nucleus_id", "cytosol_id")


@query(f"{with_views('nuc', 'cyt')}, {_MATCH} SELECT DISTINCT cell_id AS cytosol_id FROM cyt WHERE cell_id NOT IN (SELECT cytosol_id FROM matches)")
def j3_unassigned_cytosols(spark, d):
    _, cyt, found = _matches(spark, d)
    return labels.unassigned(cyt, found).select("cytosol_id")


@query(f"{with_views('nuc', 'cyt')}, {_MATCH}, {_ONE} SELECT image_id, y, x, nucleus_id AS cell_id FROM cyt JOIN lookup ON cell_id = cytosol_id")
def j4_relabel_cytosol(spark, d):
    """J4, F11."""
    _, cyt, found = _matches(spark, d)
    return labels.relabel_cytosol(cyt, labels.one_to_one(found).select("nucleus_id", "cytosol_id"))


@query(f"{with_views('nuc', 'cyt')}, {_MATCH} SELECT cytosol_id, count(*) AS n_nuclei FROM matches GROUP BY cytosol_id HAVING count(*) > 1")
def a13_multinucleated(spark, d):
    """A12, A13."""
    return labels.multinucleated(_matches(spark, d)[2])


_CENTERS = "centers AS (SELECT cell_id, round_even(avg(y), 0)::INT AS cy, round_even(avg(x), 0)::INT AS cx FROM mosaic WHERE cell_id <> 0 GROUP BY cell_id), size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM mosaic)"


def _centers(spark, d, half):
    m, h, w = _mosaic(spark, d)
    return m, features.inside_border(features.rounded_centers(labels.centroids(m)), half, h, w)


@query(f"{with_views('mosaic')}, {_CENTERS} SELECT cell_id, cy, cx FROM centers, size WHERE cy > 6 AND cy < h - 6 AND cx > 6 AND cx < w - 6")
def f12_cells_inside(spark, d):
    return _centers(spark, d, 6)[1]


@query(f"""{with_views('mosaic')}, {_CENTERS}, c AS (SELECT cell_id, cy, cx FROM centers, size WHERE cy > 6 AND cy < h - 6 AND cx > 6 AND cx < w - 6)
    SELECT c.cell_id, (m.y - cy + 6)::INT AS y, (m.x - cx + 6)::INT AS x, m.cell_id = c.cell_id AS own, CASE WHEN m.cell_id = c.cell_id THEN value ELSE 0 END AS value FROM c JOIN mosaic m ON m.y >= cy - 6 AND m.y < cy + 6 AND m.x >= cx - 6 AND m.x < cx + 6""")
def j5_extract_cells(spark, d):
    """J5's crop: windows around centres by a join on tiles, then the exact range."""
    m, centers = _centers(spark, d, 6)
    return features.extract_cells(m.select("y", "x", "value"), m.where("cell_id != 0").select("y", "x", "cell_id"), centers, 6)


@query(f"{with_views('px', 'nuc')} SELECT cell_id, avg(y) AS y, avg(x) AS x, 'seg_nucleus' AS region FROM nuc GROUP BY cell_id")
def k12_attach_coordinates(spark, d):
    """J7, K12, P31."""
    nuc = A.nuclei(A.pixels(spark, d))
    return features.attach_coordinates(nuc.select("cell_id").distinct(), labels.centroids(nuc), "seg_nucleus").select("cell_id", "y", "x", "region")


@query(f"{with_views('px', 'nuc')} SELECT cell_id, count(*) AS n_points, min(y)::INT AS first_y, max(x)::INT AS last_x FROM nuc GROUP BY cell_id")
def a23_outlines(spark, d):
    out = labels.outlines(A.nuclei(A.pixels(spark, d)))
    return out.select("cell_id", F.size("outline").cast("long").alias("n_points"), F.col("outline")[0]["y"].alias("first_y"), F.array_max(F.col("outline.x")).alias("last_x"))


@query(f"{with_views('px')} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(value), 6) AS value FROM px GROUP BY 1, 2, 3")
def i4_block_mean(spark, d):
    return blocks.block_mean(A.pixels(spark, d), 2, ["image_id"]).select("image_id", "y", "x", r6(F.col("value"), "value"))


@query(f"""{with_views('px')}, s AS (SELECT image_id, (y // 3)::INT AS y, (x // 3)::INT AS x, sum(value) / 9 AS value FROM px GROUP BY 1, 2, 3), t AS (SELECT image_id, max(value) AS most FROM s GROUP BY image_id)
    SELECT image_id, y, x, CASE WHEN most > 0 THEN trunc(value / most * 65535) ELSE 0 END::INT AS value FROM s JOIN t USING (image_id)""")
def i6_downsample_padded(spark, d):
    """Padded blocks, stretched to the full range."""
    return blocks.downsample(A.pixels(spark, d), 3, ["image_id"], padded=True).select("image_id", "y", "x", "value")


@query(f"{with_views('px')} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, value FROM px WHERE y % 2 = 0 AND x % 2 = 0 AND y < 7 AND x < 7")
def i5_stride(spark, d):
    """I5, I9."""
    return blocks.stride(A.pixels(spark, d), 2, A.SIDE, A.SIDE).select("image_id", "y", "x", "value")


@query(f"""{with_views('px')}, t AS (SELECT *, y // 3 AS ty, x // 3 AS tx, y < 6 AND x < 6 AS whole FROM px), b AS (SELECT image_id, ty, tx, quantile_cont(value::DOUBLE, 0.5) AS med, max(value) AS most FROM t WHERE whole GROUP BY 1, 2, 3)
    SELECT {_KEY}, CASE WHEN whole AND most > 0 THEN greatest(value - med, 0) ELSE value END::DOUBLE AS corrected FROM t LEFT JOIN b USING (image_id, ty, tx)""")
def i7_rolling_background(spark, d):
    return blocks.background_corrected(A.pixels(spark, d), 3, A.SIDE, A.SIDE, ["image_id"]).select("image_id", "y", "x", "corrected")


_SOBEL = ", ".join(f"({a}, {b}, {wy}, {wx})" for (a, b), (wy, wx) in blocks.SOBEL.items())


@query(f"""{with_views('px')}, {_STACK}, n AS (SELECT s.stack, s.z, s.y - o.dy AS y, s.x - o.dx AS x, s.value * o.wy AS gy, s.value * o.wx AS gx FROM stack s, (VALUES {_SOBEL}) AS o(dy, dx, wy, wx)),
    e AS (SELECT stack, z, y, x, (sum(gy) * sum(gy) + sum(gx) * sum(gx)) / 16 AS edge FROM n WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY stack, z, y, x),
    r AS (SELECT stack, y, x, value, row_number() OVER (PARTITION BY stack, y, x ORDER BY edge DESC, z) AS k FROM stack JOIN e USING (stack, z, y, x)) SELECT stack, y::INT AS y, x::INT AS x, value FROM r WHERE k = 1""")
def i8_focus_stack(spark, d):
    return blocks.focus_stack(_stack(spark, d), A.SIDE, A.SIDE, ["stack"]).select("stack", "y", "x", "value")


@query(f"{with_views('nuc')} SELECT image_id, (y * 2 + dy)::INT AS y, (x * 2 + dx)::INT AS x, cell_id FROM nuc, range(2) AS a(dy), range(2) AS b(dx)")
def i10_upscale(spark, d):
    return blocks.upscale(A.nuclei(A.pixels(spark, d)), 2).select("image_id", "y", "x", "cell_id")


_DISK1 = ", ".join(f"({a}, {b})" for a, b in blocks.disk(1))


@query(f"""{with_views('px')}, n AS (SELECT image_id, y - dy AS y, x - dx AS x, value FROM px, (VALUES {_DISK1}) AS o(dy, dx))
    SELECT image_id, y::INT AS y, x::INT AS x, quantile_cont(value::DOUBLE, 0.5) AS value FROM n WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def i14_median_filter(spark, d):
    return blocks.median_filter(A.pixels(spark, d), 1, A.SIDE, A.SIDE, ["image_id"])


@query(f"""{with_views('px')}, b AS (SELECT image_id, y, x, (value > 10000)::INT AS value FROM px), n AS (SELECT image_id, y - dy AS y, x - dx AS x, value FROM b, (VALUES {_DISK1}) AS o(dy, dx))
    SELECT image_id, y::INT AS y, x::INT AS x, min(value) AS value FROM n WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY 1, 2, 3""")
def f13_threshold_erode(spark, d):
    """A thresholded image eroded by a disk."""
    binary = A.pixels(spark, d).withColumn("value", (F.col("value") > 10000).cast("int"))
    return blocks.erode(binary, 1, A.SIDE, A.SIDE, ["image_id"])


_LEVEL = "SELECT image_id, (y // {f})::INT AS y, (x // {f})::INT AS x, round(avg(value), 6) AS value, {k}::INT AS scale FROM px GROUP BY 1, 2, 3"


@query(f"{with_views('px')} SELECT image_id, y, x, value::DOUBLE AS value, 0::INT AS scale FROM px " + " ".join("UNION ALL " + _LEVEL.format(f=f, k=k) for k, f in enumerate((2, 4, 8), 1)))
def i18_pyramid(spark, d):
    """I18, K3, K17."""
    return blocks.pyramid(A.pixels(spark, d), by=["image_id"]).select("image_id", "y", "x", r6(F.col("value"), "value"), "scale")


@query(f"{with_views('mosaic')}, p AS (SELECT image_id, image_id // 25 * 7 AS oy, image_id % 25 * 7 AS ox FROM (SELECT DISTINCT image_id FROM px)) SELECT (y + oy)::INT AS y, (x + ox)::INT AS x, round(avg(value), 6) AS value FROM px JOIN p USING (image_id) GROUP BY 1, 2")
def i22_assemble_mosaic(spark, d):
    """Overlapping tiles averaged."""
    px = A.pixels(spark, d).withColumnRenamed("image_id", "tile_id")
    at = px.select("tile_id").distinct().select("tile_id", (F.expr(f"tile_id div {A.MOSAIC_TILES}") * 7).alias("oy"), (F.col("tile_id") % A.MOSAIC_TILES * 7).alias("ox"))
    return blocks.assemble(px, at).select("y", "x", r6(F.col("value"), "value"))


def _half(spark, d):
    nuc = A.nuclei(A.pixels(spark, d))
    return nuc, sets.ids(nuc.where("cell_id % 2 = 0")), sets.ids(nuc.where("cell_id % 3 = 0"))


@query(f"""{with_views('nuc')}, a AS (SELECT DISTINCT cell_id FROM nuc WHERE cell_id % 2 = 0), b AS (SELECT DISTINCT cell_id FROM nuc WHERE cell_id % 3 = 0)
    SELECT 'union' AS op, cell_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', cell_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'symmetric', cell_id FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def t1_id_sets(spark, d):
    """T1, T2, T3, T4, T9."""
    _, a, b = _half(spark, d)
    named = {"union": sets.union(a, b), "difference": sets.difference(a, b), "symmetric": sets.symmetric_difference(a, b)}
    out = None
    for name, df in named.items():
        one = df.select(F.lit(name).alias("op"), "cell_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{with_views('nuc')} SELECT image_id, y, x, cell_id FROM nuc WHERE cell_id % 2 = 0")
def t5_restrict(spark, d):
    nuc, a, _ = _half(spark, d)
    return sets.restrict(nuc, a).select("image_id", "y", "x", "cell_id")


@query(f"{with_views('nuc', 'cyt')}, a AS (SELECT DISTINCT cell_id FROM nuc), b AS (SELECT DISTINCT cell_id FROM cyt) SELECT (SELECT count(*) FROM a ANTI JOIN b USING (cell_id)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (cell_id)) AS only_b, (SELECT count(*) FROM a SEMI JOIN b USING (cell_id)) AS \"both\"")
def t6_compare_ids(spark, d):
    """T6, T7, S5's checks."""
    px = A.pixels(spark, d)
    return sets.compare(sets.ids(A.nuclei(px)), sets.ids(A.cytosol(px)))


def _plan_sql(rows: str, overlap: int) -> str:
    return f"""s AS (SELECT (max(y) + 1)::INT AS h, (max(x) + 1)::INT AS w FROM mosaic), n AS (SELECT h, w, {rows} FROM s), g AS (SELECT *, i // nc AS r, i % nc AS c FROM n, range(10000) AS t(i) WHERE i < nr * nc)
    SELECT i::INT AS id, greatest(r * (h // nr) - {overlap}, 0)::INT AS y0, (CASE WHEN r = nr - 1 THEN h ELSE least((r + 1) * (h // nr) + {overlap}, h) END)::INT AS y1, greatest(c * (w // nc) - {overlap}, 0)::INT AS x0, (CASE WHEN c = nc - 1 THEN w ELSE least((c + 1) * (w // nc) + {overlap}, w) END)::INT AS x1 FROM g"""


@query(f"{with_views('mosaic')}, {_plan_sql('greatest((h + 63) // 64, 1) AS nr, greatest((w + 63) // 64, 1) AS nc', 5)}")
def l1_sharding_plan(spark, d):
    _, h, w = _mosaic(spark, d)
    return tiling.shard_plan(spark, int(h), int(w), 4096, 5)


@query(f"{with_views('mosaic')}, {_plan_sql('greatest(round_even(h / 64.0, 0)::INT, 1) AS nr, greatest(round_even(w / 64.0, 0)::INT, 1) AS nc', 0)}")
def l2_tiling_plan(spark, d):
    _, h, w = _mosaic(spark, d)
    return tiling.tile_plan(spark, int(h), int(w), 64)


@query(f"{with_views('mosaic')}, p AS ({_plan_sql('greatest((h + 63) // 64, 1) AS nr, greatest((w + 63) // 64, 1) AS nc', 5).replace('s AS', 'WITH s AS', 1)}) SELECT id AS shard, count(*) AS n_pixels, sum(value)::BIGINT AS total FROM p JOIN mosaic ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY id")
def l5_pixels_by_shard(spark, d):
    """Every shard's pixels, overlaps included."""
    m, h, w = _mosaic(spark, d)
    shared = tiling.with_shards(m, tiling.shard_plan(spark, int(h), int(w), 4096, 5))
    return shared.groupBy("shard").agg(F.count("*").alias("n_pixels"), F.sum("value").alias("total"))


@query(f"{with_views('mosaic')}, p AS ({_plan_sql('greatest((h + 63) // 64, 1) AS nr, greatest((w + 63) // 64, 1) AS nc', 5).replace('s AS', 'WITH s AS', 1)}) SELECT id, y0, y1, x0, x1 FROM p WHERE id % 3 <> 0")
def l6_missing_shards(spark, d):
    """A plan through JSON and back, less what is done."""
    _, h, w = _mosaic(spark, d)
    plan = tiling.plan_from_json(tiling.plan_to_json(tiling.shard_plan(spark, int(h), int(w), 4096, 5))).drop("ys", "xs")
    return tiling.missing_shards(plan, plan.where("id % 3 = 0"))


@query(f"""{with_views('mosaic')}, n AS (SELECT m.y, m.x, max(o.value) AS out FROM mosaic m JOIN mosaic o ON o.y BETWEEN m.y - 1 AND m.y + 1 AND o.x BETWEEN m.x - 1 AND m.x + 1 AND abs(o.y - m.y) + abs(o.x - m.x) <= 1 GROUP BY 1, 2) SELECT y, x, out::DOUBLE AS out FROM n""")
def l8_tiled_dilation(spark, d):
    """A NumPy kernel over tiles with halos gives what it would give on the whole image."""
    from ..functions.kernels import dilate

    m, _, _ = _mosaic(spark, d)
    return tiling.per_tile(m.select("y", "x", "value"), 64, 1, lambda a: dilate(a, 1))

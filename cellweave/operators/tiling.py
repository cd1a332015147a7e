"""Shards and tiles: plans, halos, per-shard work, and the merge of overlapping shards' labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graphs import _cut as _written

WINDOW = "struct<y:struct<start:int,stop:int,step:int>,x:struct<start:int,stop:int,step:int>>"


def shard_plan(spark: SparkSession, height: int, width: int, shard_px: int, overlap: int) -> DataFrame:
    """shard(id, y0, y1, x0, x1): squares of about shard_px pixels, the overlap on each side, clipped to the image."""
    side = max(math.isqrt(shard_px), 1)
    return _plan(spark, height, width, max(-(-height // side), 1), max(-(-width // side), 1), overlap)


def tile_plan(spark: SparkSession, height: int, width: int, side: int) -> DataFrame:
    """As shard_plan with the rounded number of tiles, one at least, and no overlap."""
    return _plan(spark, height, width, max(round(height / side), 1), max(round(width / side), 1), 0)


def _plan(spark: SparkSession, height: int, width: int, rows: int, cols: int, overlap: int) -> DataFrame:
    h, w = height // rows, width // cols
    grid = spark.range(rows * cols).select(F.col("id").cast("int").alias("id"), F.expr(f"cast(id div {cols} as int)").alias("r"), F.expr(f"cast(id % {cols} as int)").alias("c"))

    def ends(k: str, n: int, size: int, full: int) -> list:
        low = F.greatest(F.col(k) * size - overlap, F.lit(0))
        high = F.when(F.col(k) == n - 1, F.lit(full)).otherwise(F.least((F.col(k) + 1) * size + overlap, F.lit(full)))
        return [low.cast("int"), high.cast("int")]

    (y0, y1), (x0, x1) = ends("r", rows, h, height), ends("c", cols, w, width)
    return grid.select("id", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))


def plan_to_json(plan: DataFrame) -> DataFrame:
    """id and its window as JSON with start, stop and step of both axes; steps from columns ys and xs, null without them."""
    step = {a: F.col(f"{a}s") if f"{a}s" in plan.columns else F.lit(None).cast("int") for a in "yx"}
    window = F.struct(*[F.struct(F.col(f"{a}0").alias("start"), F.col(f"{a}1").alias("stop"), step[a].alias("step")).alias(a) for a in "yx"])
    return plan.select("id", F.to_json(F.struct("id", window.alias("window")), {"ignoreNullFields": "false"}).alias("json"))


def plan_from_json(rows: DataFrame) -> DataFrame:
    """id, y0, y1, x0, x1, and the steps ys and xs."""
    parsed = F.from_json("json", f"id int, window {WINDOW}")
    ends = [F.col(f"p.window.{a}.{part}").alias(a + k) for a in "yx" for part, k in (("start", "0"), ("stop", "1"))]
    return rows.select(parsed.alias("p")).select("p.id", *ends, F.col("p.window.y.step").alias("ys"), F.col("p.window.x.step").alias("xs"))


def with_shards(px: DataFrame, plan: DataFrame) -> DataFrame:
    """Each pixel once for every shard whose window holds it. The plan is a small table; it joins by ranges of a bucket of its own smallest side."""
    side = plan.agg(F.min(F.least(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))).first()[0] or 1
    wide = plan.withColumn("by", F.explode(F.sequence(F.expr(f"y0 div {side}"), F.expr(f"(y1 - 1) div {side}")))).withColumn("bx", F.explode(F.sequence(F.expr(f"x0 div {side}"), F.expr(f"(x1 - 1) div {side}"))))
    keyed = px.withColumn("by", F.expr(f"y div {side}")).withColumn("bx", F.expr(f"x div {side}"))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return keyed.join(wide.withColumnRenamed("id", "shard"), ["by", "bx"]).where(inside).drop("by", "bx")


def with_halo(px: DataFrame, tile: int, halo: int) -> DataFrame:
    """Columns ty, tx, core: each pixel once for its tile and again for the neighbours within `halo`, so that a tile's neighbourhoods are whole. A halo wider than a tile is refused, as it would reach past the neighbours."""
    if halo > tile:
        raise ValueError("the halo has to be no wider than a tile")
    reach = lambda c: F.explode(F.expr(f"sequence(cast(greatest({c} - {halo}, 0) div {tile} as int), cast(({c} + {halo}) div {tile} as int))"))
    sent = px.withColumn("ty", reach("y")).withColumn("tx", reach("x")) if halo else px.withColumns({c: F.expr(f"cast({a} div {tile} as int)") for c, a in (("ty", "y"), ("tx", "x"))})
    return sent.withColumn("core", (F.col("ty") == F.expr(f"y div {tile}")) & (F.col("tx") == F.expr(f"x div {tile}")))


def per_tile(px: DataFrame, tile: int, halo: int, kernel: Callable[[np.ndarray], np.ndarray], by: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """A NumPy neighbourhood kernel over dense tiles with halos: (by..., y, x, out) for each tile's own pixels that exist."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        grid = np.full((y.max() - y0 + 1, x.max() - x0 + 1), fill, np.float64)
        grid[y - y0, x - x0] = rows["value"].to_numpy()
        out = rows.loc[rows["core"], [*by, "y", "x"]].copy()
        out["out"] = kernel(grid)[out["y"].to_numpy() - y0, out["x"].to_numpy() - x0].astype(np.float64)
        return out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in px.schema if f.name in (*by, "y", "x"))
    return with_halo(px, tile, halo).groupBy(*by, "ty", "tx").applyInPandas(run, f"{fields}, out double")


def segment_shards(px: DataFrame, plan: DataFrame, segmenter: Callable[[np.ndarray], np.ndarray], by: str = "image_id") -> DataFrame:
    """A segmenter (grid of values -> grid of labels, 0 for background) over each shard of each image: (by, shard, y0, y1, x0, x1, y, x, cell_id).

    px(by, y, x, value); pixels that don't exist are 0, shards without pixels give nothing, and errors end the job. The
    plan's windows bound what a task holds. Any model that labels an array is a segmenter.
    """
    kind = px.schema[by].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y0, y1, x0, x1 = (int(rows[c].iloc[0]) for c in ("y0", "y1", "x0", "x1"))
        grid = np.zeros((y1 - y0, x1 - x0))
        grid[rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0] = rows["value"].to_numpy()
        labels = np.asarray(segmenter(grid))
        if labels.shape != grid.shape:
            raise ValueError("a segmenter has to label every pixel of its window")
        y, x = np.nonzero(labels)
        window = {c: np.full(len(y), v, np.int32) for c, v in (("y0", y0), ("y1", y1), ("x0", x0), ("x1", x1))}
        return pd.DataFrame({by: rows[by].iloc[0], "shard": rows["shard"].iloc[0], **window, "y": (y + y0).astype(np.int32), "x": (x + x0).astype(np.int32), "cell_id": labels[y, x].astype(np.int64)})

    shared = with_shards(px.select(by, "y", "x", "value"), plan)
    return shared.groupBy(by, "shard").applyInPandas(run, f"{by} {kind}, shard int, y0 int, y1 int, x0 int, x1 int, y int, x int, cell_id long")


def merge_shards(labels: DataFrame, by: str = "image_id") -> DataFrame:
    """Shard labels (by, shard, y0, y1, x0, x1, y, x, cell_id; 0 and missing pixels are background) to one mask per image.

    In the order of shards: labels that touch their shard's border go; where a new cell meets a finished one, the new one
    stays, unless the old one is cut by the window's border, when the old one stays. Ids continue over shards. Cells
    decide this among themselves: pixels are joined where windows overlap, to pairs of cells, and are written once.
    """
    cell = [by, "shard", "cell_id"]
    border = lambda w: F.col("y").isin(F.col(f"{w}y0"), F.col(f"{w}y1") - 1) | F.col("x").isin(F.col(f"{w}x0"), F.col(f"{w}x1") - 1)
    whole = labels.where("cell_id != 0").withColumn("cut", border(""))
    whole = whole.join(whole.groupBy(*cell).agg(F.bool_or("cut").alias("edge")).where("not edge").drop("edge"), cell)
    px = _written(whole.select(*cell, "y", "x"))
    shards = _written(labels.select(by, F.col("shard").alias("later"), *[F.col(c).alias(f"l_{c}") for c in ("y0", "y1", "x0", "x1")]).distinct())
    # each finished pixel under every later window that holds it, by windows of a bucket of the least side
    side = shards.agg(F.min(F.least(F.col("l_y1") - F.col("l_y0"), F.col("l_x1") - F.col("l_x0")))).first()[0] or 1
    wide = shards.withColumn("by_", F.explode(F.sequence(F.expr(f"l_y0 div {side}"), F.expr(f"(l_y1 - 1) div {side}")))).withColumn("bx_", F.explode(F.sequence(F.expr(f"l_x0 div {side}"), F.expr(f"(l_x1 - 1) div {side}"))))
    keyed = px.withColumns({"by_": F.expr(f"y div {side}"), "bx_": F.expr(f"x div {side}")})
    inside = (F.col("later") > F.col("shard")) & (F.col("y") >= F.col("l_y0")) & (F.col("y") < F.col("l_y1")) & (F.col("x") >= F.col("l_x0")) & (F.col("x") < F.col("l_x1"))
    seen = keyed.join(wide, [by, "by_", "bx_"]).where(inside).withColumn("cut", border("l_"))
    new = px.select(by, F.col("shard").alias("later"), F.col("cell_id").alias("new_id"), "y", "x")
    met = seen.join(new, [by, "later", "y", "x"], "left")
    pairs = met.groupBy(*cell, "later", "new_id").agg(F.bool_or("cut").alias("cut"))
    cut = pairs.groupBy(*cell, "later").agg(F.bool_or("cut").alias("cut"))
    pairs = _written(pairs.where("new_id is not null").drop("cut").join(cut, [*cell, "later"]))
    # an old cell that isn't cut goes at the first window where a new one meets it; a cut one bars the new one, if both are there
    gone = pairs.where("not cut").groupBy(*cell).agg(F.min("later").alias("until"))
    bars = _written(pairs.where("cut").join(gone, cell, "left").where("until is null or until > later").select(by, "shard", "cell_id", "later", "new_id"))
    cells = px.select(*cell).distinct()
    barred = None
    old, fresh = [F.col(c) for c in cell], [F.col(by), F.col("later").alias("shard"), F.col("new_id").alias("cell_id")]
    while True:  # a bar counts if its own cell isn't barred; settled after as many rounds as bars follow on each other
        held = bars if barred is None else bars.join(barred, cell, "left_anti")
        now = _written(held.select(*fresh).distinct())
        if barred is not None and now.count() == barred.count() and now.join(barred, cell, "left_anti").isEmpty():
            break
        barred = now
    born = cells.join(barred, cell, "left_anti")
    top = shards.select(by, F.col("later").alias("shard")).join(born.groupBy(by, "shard").agg(F.max("cell_id").alias("top")), [by, "shard"], "left")
    before = Window.partitionBy(by).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = top.select(by, "shard", F.coalesce(F.sum("top").over(before), F.lit(0)).alias("shift"))  # a row per shard
    alive = born.join(gone, cell, "left_anti").join(shift, [by, "shard"])
    return px.join(alive, cell).select(by, "y", "x", (F.col("cell_id") + F.col("shift")).alias("cell_id"))


def missing_shards(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Shards still to do when a run is resumed."""
    return plan.join(done.select("id").distinct(), "id", "left_anti")

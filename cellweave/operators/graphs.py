"""Tile registration graphs as tables of edges: components, spanning paths, positions, and the global fit.

Paths run over blocks of consecutive nodes: a task takes all paths inside its block at once, and what leaves the block is
passed on in the next round. So rounds are block borders crossed, not hops, and no task holds more than a block. Tables
of nodes are joined by shuffles, so what the driver gets doesn't grow with them.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _both(edges: DataFrame, *columns: str) -> DataFrame:
    back = [(-F.col(c)).alias(c) if c in ("dy", "dx") else F.col(c) for c in columns]
    return edges.select("a", "b", *columns).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *back))


#: Node numbers that make a block, and nodes of a component whose eccentricities are found at once, at most.
BLOCK, SOURCES = 4096, 64


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cellweave-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = f"{_shared(df.sparkSession)}/graphs/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame) -> DataFrame:
    """df, a row for each node, to be joined by sorted shuffles: small as its files are, it is never sent to the driver and on to all executors."""
    return df.hint("merge")


def _rounds(most: int | None) -> Iterator[int]:
    """1, 2, ... without an end, or an error beyond `most`: a loop that isn't done has no right result."""
    for k in count(1):
        if most is not None and k > most:
            raise RuntimeError(f"not settled after {most} rounds")
        yield k


def components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): the least node that edges lead to, by passing labels on and jumping over them."""
    both = _cut(_both(edges))
    now = _cut(nodes.select("node", F.col("node").alias("component")))
    for _ in _rounds(most):
        seen = both.join(_dealt(now.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = now.join(_dealt(seen), now["node"] == seen["a"], "left").select("node", F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = _cut(step.join(_dealt(jump), "component", "left").select("node", F.least("component", "further").alias("component")))
        settled = step.join(_dealt(now.withColumnRenamed("component", "was")), "node").where("component != was").isEmpty()
        now = step
        if settled:
            return now


PATHS = "node long, component long, y double, x double, cost double, left boolean"


def _paths_in_block(key: tuple, arcs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Cheapest paths from the known nodes of one block along its arcs. Nodes outside the block (left) are told of, not gone on from."""
    out: dict[int, list[tuple]] = {}
    for a, b, dy, dx, error in arcs[["a", "b", "dy", "dx", "error"]].itertuples(index=False):
        out.setdefault(a, []).append((b, dy, dx, error))
    best = {r.node: (r.cost, r.component, r.y, r.x) for r in known.itertuples(index=False)}
    own, queue, before = set(out) | set(best), [(v[0], n) for n, v in best.items()], dict(best)
    heapq.heapify(queue)
    while queue:
        cost, node = heapq.heappop(queue)
        if cost > best[node][0] or node not in own:
            continue
        _, component, y, x = best[node]
        for b, dy, dx, error in out.get(node, ()):
            if b not in best or cost + error < best[b][0] - 1e-12:
                best[b] = (cost + error, component, y + dy, x + dx)
                heapq.heappush(queue, (cost + error, b))
    rows = [(n, v[1], v[2], v[3], v[0], n not in own) for n, v in best.items() if before.get(n) != v]
    return pd.DataFrame(rows, columns=["node", "component", "y", "x", "cost", "left"])


def _arcs(edges: DataFrame, block: int) -> DataFrame:
    return _cut(_both(edges, "dy", "dx", "error").withColumn("block", F.expr(f"a div {block}L")))


def _cheapest(arcs: DataFrame, sources: DataFrame, block: int, most: int | None) -> DataFrame:
    """(node, component, y, x, cost) along the cheapest path from each component's source (node, component)."""
    zero = F.lit(0.0)
    now = _cut(sources.select("node", "component", zero.alias("y"), zero.alias("x"), zero.alias("cost")))
    fresh = now
    for _ in _rounds(most):
        dealt = fresh.withColumn("block", F.expr(f"node div {block}L"))
        moved = _cut(arcs.groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(_paths_in_block, PATHS))
        if moved.isEmpty():
            return now
        both = now.withColumn("new", F.lit(0)).unionByName(moved.drop("left").withColumn("new", F.lit(1)))
        # of equal costs what was there stays; nodes that got a better path from another block are gone on from
        best = both.groupBy("node").agg(F.min(F.struct("cost", "new", "component", "y", "x")).alias("m"))
        step = _cut(best.select("node", "m.component", "m.y", "m.x", "m.cost", "m.new"))
        now = step.drop("new")
        fresh = step.where("new = 1").drop("new").join(_dealt(moved.where("left").select("node").distinct()), "node", "left_semi")
        if fresh.isEmpty():
            return now


def centre_nodes(nodes: DataFrame, edges: DataFrame, parts: DataFrame, most: int | None = None, block: int = BLOCK, sources: int = SOURCES) -> DataFrame:
    """(component, centre): the first node of least eccentricity (in hops) of each component.

    Paths from some nodes bound every other node's eccentricity from both sides; the next to ask are those that may have
    the least. A chain or a grid takes a few single sweeps; where bounds don't tell, as on rings, sweeps take twice as
    many nodes each time, up to `sources`, each over its own copy of the open components' edges. A row per node is kept.
    """
    top = nodes.agg(F.max("node")).first()[0]
    stride = ((top or 0) // block + 1) * block
    labelled = _cut(edges.select("a", "b").join(_dealt(parts.withColumnRenamed("node", "a")), "a"))
    far, many = F.lit(float("inf")), 1
    state = _cut(nodes.join(_dealt(parts), "node").select("node", "component", F.lit(0.0).alias("low"), far.alias("high")))
    for _ in _rounds(most):
        rank = F.struct("low", "node")
        closed = F.when(F.col("low") == F.col("high"), rank)
        best = state.groupBy("component").agg(F.min(closed).alias("centre"))
        open_ = state.where("low < high").join(best, "component").where(F.col("centre").isNull() | (rank < F.col("centre")))
        asked = open_.groupBy("component", (F.col("node") % many).alias("k")).agg(F.min(rank).alias("next"))
        asked = _cut(asked.select("component", (F.col("next.node") + F.col("k") * stride).alias("node"), "k"))
        if asked.isEmpty():
            return best.select("component", F.col("centre.node").alias("centre"))
        copies = labelled.join(asked.select("component", "k"), "component")
        place = lambda c: (F.col(c) + F.col("k") * stride).alias(c)
        hops = _arcs(copies.select(place("a"), place("b"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"), F.lit(1.0).alias("error")), block)
        reached = _cheapest(hops, asked.select("node", "component"), block, most).select((F.col("node") % stride).alias("node"), F.expr(f"node div {stride}").alias("k"), "component", F.col("cost").alias("d"))
        reached = _cut(reached)
        ecc = reached.groupBy("component", "k").agg(F.max("d").alias("ecc"))
        bounds = reached.join(ecc, ["component", "k"]).groupBy("node").agg(F.max(F.greatest("d", F.col("ecc") - F.col("d"))).alias("l"), F.min(F.col("ecc") + F.col("d")).alias("h"))
        joined = state.join(_dealt(bounds), "node", "left")
        state = _cut(joined.select("node", "component", F.greatest("low", F.coalesce("l", F.lit(0.0))).alias("low"), F.least("high", F.coalesce("h", far)).alias("high")))
        many = min(2 * many, sources)


def positions(edges: DataFrame, centres: DataFrame, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """(node, component, y, x, cost): shifts added up along the cheapest path from each component's centre. Negative errors are refused."""
    usable = edges.where("error < double('inf')")
    if not usable.where("error < 0").isEmpty():
        raise ValueError("negative errors have no cheapest paths")
    return _cheapest(_arcs(usable, block), centres.select(F.col("centre").alias("node"), "component"), block, most)


def fit_positions(found: DataFrame, nominal: DataFrame) -> DataFrame:
    """All tiles in one frame: a linear map nominal -> found of the largest component (identity if it is degenerate) predicts the others' places; the least position becomes the origin."""
    joined = found.join(_dealt(nominal.select("node", F.col("y").alias("ny"), F.col("x").alias("nx"))), "node")
    size = joined.groupBy("component").agg(F.count("*").alias("n"))
    main = size.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("c")).first()["c"]
    m = joined.where(F.col("component") == main).agg(*[F.avg(c).alias(f"m_{c}") for c in ("ny", "nx", "y", "x")], F.covar_pop("ny", "ny").alias("yy"), F.covar_pop("nx", "nx").alias("xx"), F.covar_pop("ny", "nx").alias("yx"), *[F.covar_pop(p, q).alias(f"{p}_{q}") for p in ("ny", "nx") for q in ("y", "x")]).first()
    det = m["yy"] * m["xx"] - m["yx"] ** 2
    if abs(det) < 1e-3:
        a, b, c, d = 1.0, 0.0, 0.0, 1.0
    else:
        a, b = ((m[f"ny_{q}"] * m["xx"] - m[f"nx_{q}"] * m["yx"]) / det for q in ("y", "x"))
        c, d = ((m[f"nx_{q}"] * m["yy"] - m[f"ny_{q}"] * m["yx"]) / det for q in ("y", "x"))
    py = m["m_y"] + a * (F.col("ny") - m["m_ny"]) + c * (F.col("nx") - m["m_nx"])
    px = m["m_x"] + b * (F.col("ny") - m["m_ny"]) + d * (F.col("nx") - m["m_nx"])
    offset = joined.groupBy("component").agg(F.avg(py - F.col("y")).alias("oy"), F.avg(px - F.col("x")).alias("ox"))
    placed = joined.join(offset, "component").select("node", "component", (F.col("y") + F.when(F.col("component") == main, 0.0).otherwise(F.col("oy"))).alias("y"), (F.col("x") + F.when(F.col("component") == main, 0.0).otherwise(F.col("ox"))).alias("x"))
    least = placed.agg(F.min("y"), F.min("x")).first()
    return placed.select("node", "component", (F.col("y") - least[0]).alias("y"), (F.col("x") - least[1]).alias("x"))


def grid_edges(spark: SparkSession, tiles: DataFrame) -> DataFrame:
    """Neighbour pairs (a, b) of tiles (node, gy, gx) on a grid."""
    right = tiles.select(F.col("node").alias("b"), F.col("gy").alias("gy"), (F.col("gx") - 1).alias("gx"))
    below = tiles.select(F.col("node").alias("b"), (F.col("gy") - 1).alias("gy"), F.col("gx").alias("gx"))
    return tiles.withColumnRenamed("node", "a").join(_dealt(right.unionByName(below)), ["gy", "gx"]).select("a", "b")

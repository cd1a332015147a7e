import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import graphs

EDGE = "a long, b long, dy double, dx double, error double"


@pytest.mark.parametrize("n, block", [(9, 4096), (1000, 600)])
def test_long_chains_settle_or_raise(spark, n, block):
    nodes = spark.createDataFrame([(k,) for k in range(n)], "node long")
    edges = spark.createDataFrame([(k, k + 1, 8.0, 1.0, 1.0) for k in range(n - 1)], EDGE)
    parts = graphs.components(nodes, edges)
    assert {r["component"] for r in parts.collect()} == {0}
    centres = graphs.centre_nodes(nodes, edges, parts, block=block)
    middle = (n - 1) // 2
    assert [tuple(r) for r in centres.collect()] == [(0, middle)]
    got = {r["node"]: (r["y"], r["x"]) for r in graphs.positions(edges, centres, block=block).collect()}
    assert got == {k: (8.0 * (k - middle), 1.0 * (k - middle)) for k in range(n)}
    for run in (lambda: graphs.components(nodes, edges, most=1), lambda: graphs.centre_nodes(nodes, edges, parts, most=1, block=2)):
        with pytest.raises(RuntimeError):
            run()


def brute_force(nodes, edges):
    """Component, centre (least eccentricity in hops, the first of ties) and cheapest cost from it, of each node."""
    near = {n: {} for n in nodes}
    for a, b, _, _, e in edges:
        near[a][b] = near[b][a] = min(e, near[a].get(b, e))

    def costs(source, weight):
        best, left = {source: 0.0}, {source}
        while left:
            n = left.pop()
            for m, e in near[n].items():
                if best[n] + weight(e) < best.get(m, float("inf")):
                    best[m] = best[n] + weight(e)
                    left.add(m)
        return best

    hops = {n: costs(n, lambda e: 1) for n in nodes}
    component = {n: min(hops[n]) for n in nodes}
    centre = {c: min((n for n in nodes if component[n] == c), key=lambda n: (max(hops[n].values()), n)) for c in set(component.values())}
    return component, centre, {n: costs(centre[component[n]], lambda e: e)[n] for n in nodes}


@pytest.mark.parametrize("block", [4096, 20])
def test_against_brute_force(spark, block):
    """Grids with gaps, a tree, single tiles, equal and unequal errors, blocks that cut every path."""
    rng = random.Random(4)
    nodes = list(range(40)) + [100, 101, 102, 103, 200]
    edges = [(k, k + 1) for k in range(35) if k % 6 != 5 and k != 14] + [(k, k + 6) for k in range(30) if k not in (3, 9)] + [(100, 102), (102, 101), (102, 103)]
    edges = [(a, b, float(rng.randint(5, 9)), float(rng.randint(-2, 2)), rng.choice([0.5, 1.0, 1.25])) for a, b in edges]
    df, table = spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, EDGE)
    component, centre, cost = brute_force(nodes, edges)
    parts = graphs.components(df, table)
    assert {r["node"]: r["component"] for r in parts.collect()} == component
    centres = graphs.centre_nodes(df, table, parts, block=block)
    assert {r["component"]: r["centre"] for r in centres.collect()} == centre
    got = {r["node"]: r for r in graphs.positions(table, centres, block=block).collect()}
    assert {n: round(r["cost"], 9) for n, r in got.items()} == {n: round(c, 9) for n, c in cost.items()}
    shift = {(a, b): (dy, dx, e) for a, b, dy, dx, e in edges} | {(b, a): (-dy, -dx, e) for a, b, dy, dx, e in edges}
    for n, r in got.items():  # some neighbour leads there, by its own place, shift and cost
        assert r["cost"] == 0 or any(b == n and abs(got[a]["cost"] + e - r["cost"]) < 1e-9 and (got[a]["y"] + dy, got[a]["x"] + dx) == (r["y"], r["x"]) for (a, b), (dy, dx, e) in shift.items())


def test_negative_errors_are_refused(spark):
    with pytest.raises(ValueError):
        graphs.positions(spark.createDataFrame([(1, 2, 0.0, 0.0, -1.0)], EDGE), spark.createDataFrame([(1, 1)], "component long, centre long"))


def ring_like():
    """A ring, a wheel with a rim of 60, and a grid with a hole, as one graph of three components."""
    ring = [(k, (k + 1) % 90) for k in range(90)]
    wheel = [(200 + k, 200 + (k + 1) % 60) for k in range(60)] + [(200 + k, 300) for k in range(0, 60, 15)]
    cells = [(y, x) for y in range(12) for x in range(12) if not (3 <= y < 9 and 2 <= x < 10)]
    grid = [(400 + 12 * y + x, 400 + 12 * p + q) for y, x in cells for p, q in ((y, x + 1), (y + 1, x)) if (p, q) in set(cells)]
    return [(a, b, 1.0, 0.0, 1.0) for a, b in ring + wheel + grid]


@pytest.mark.parametrize("sources", [1, 16])
def test_centres_of_rings(spark, sources):
    edges = ring_like()
    nodes = sorted({n for a, b, *_ in edges for n in (a, b)})
    _, centre, _ = brute_force(nodes, edges)
    df, table = spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, EDGE)
    parts = graphs._cut(graphs.components(df, table))
    most = 20 if sources > 1 else None
    if sources == 1:  # one at a time needs a sweep for every other node of a ring
        df, table = df.where("node < 90"), table.where("a < 90")
        with pytest.raises(RuntimeError):
            graphs.centre_nodes(df, table, parts.where("node < 90"), most=10, sources=1)
        return
    assert {r["component"]: r["centre"] for r in graphs.centre_nodes(df, table, parts, most=most, sources=sources).collect()} == centre


def test_node_tables_are_not_broadcast(spark, monkeypatch):
    """joins of tables with a row for each node are shuffled however small their files are."""
    plans, cut = [], graphs._cut
    monkeypatch.setattr(graphs, "_cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    nodes = spark.range(50).withColumnRenamed("id", "node")
    edges = nodes.where("node % 10 != 9").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"), F.lit(1.0).alias("dy"), F.lit(0.0).alias("dx"), F.lit(1.0).alias("error"))
    parts = graphs.components(nodes, edges)
    assert {(r.node, r.component) for r in parts.collect()} == {(n, n // 10 * 10) for n in range(50)}
    joins = [p for p in plans if "Join" in p]
    assert joins and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joins)
    at = nodes.select("node", F.col("node").cast("double").alias("y"), F.lit(0.0).alias("x"))
    fitted = graphs.fit_positions(graphs.positions(edges, graphs.centre_nodes(nodes, edges, parts)), at)
    assert "SortMergeJoin" in fitted._jdf.queryExecution().sparkPlan().toString() and fitted.count() == 50

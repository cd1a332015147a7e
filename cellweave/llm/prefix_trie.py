"""Prefix trie of conversations by the Euler-tour technique.

Every distinct prefix of turns is a node, named by its smallest member and its depth. Each node gets an enter and an
exit arc; arcs are linked to one tour (children by conv_id), the tour is list-ranked over the executors, and sums over
a subtree are differences of the tour's sums at the node's two arcs.

Ranking goes in two steps: arcs are dealt by ranges of conv_id, within which each task shortens all runs of the tour to
one link; the links that are left double their reach, four steps a round, until all reach the tour's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Conversations that share the first turns of one, and heads are of 0 to HEADS - 1 turns.
FAMILY, HEADS = 20, 4
#: Arcs that a task shortens at once, and conv_ids joined in one string of an end's digest.
ARCS_AT_ONCE, IDS_AT_ONCE = 200_000, 4096
_ROOT = bytes(32)
_PREFIXES = "conv_id long, depth long, node binary, parent binary, words long, ends boolean"


def rebuild(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """turns (conv_id, turn, role, text) to rebuilt conversations: conv_id, part, i, role, text, in the order of part and i.

    Conversation c begins with the first h turns of c - c % family (all if it has fewer, none if it isn't there), then
    come its own turns after its first h; h is crc32 of the decimal c, modulo heads. Each conversation also has one row
    of part 0 without text, so that those that end up without turns stay. Turns are ordered by turn (null first), then
    by role and text; rows without a conv_id belong to no conversation and are left out; null roles and texts are empty;
    repeated rows are repeated turns.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    within = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = common.materialize(rows.withColumn("i", F.row_number().over(within).cast("long") - 1).drop("turn"), "turns")
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    each = rows.where("i = 0").select("conv_id")
    first = rows.where(F.col("i") < heads - 1).withColumnRenamed("conv_id", "base")
    taken = each.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base").where(F.col("i") < head)
    part = lambda df, k: df.select("conv_id", F.lit(k).alias("part"), "i", "role", "text")
    return part(each.select("conv_id", F.lit(0).cast("long").alias("i"), F.lit("").alias("role"), F.lit("").alias("text")), 0).unionByName(part(taken, 1)).unionByName(part(rows.where(F.col("i") >= head), 2))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """A row per prefix of each conversation, the empty one included: conv_id, depth, node, parent, words, ends.

    node is SHA-256 over the parent's and the last turn, so equal prefixes share it; words are those of the last text;
    ends marks the whole conversation. A conversation is read as a stream by one task, whose memory doesn't grow with it.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            out = []
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for conv, part, role, text in zip(ids, parts, common.as_bytes(batch.column(3)), common.as_bytes(batch.column(4)), strict=True):
                if last is not None:
                    out.append((*last, part == 0))
                if part == 0:
                    last = (conv, 0, _ROOT, None, 0)
                else:
                    node = hashlib.sha256(last[2] + len(role).to_bytes(8, "little") + role + text).digest()
                    last = (conv, last[1] + 1, node, last[2], len(text.split()))
            yield _batch(out)
        if last is not None:
            yield _batch([(*last, True)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "depth", "node", "parent", "words", "ends"])

    order = ["conv_id", "part", "i"]
    return rebuilt.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "part", "i", "role", "text").mapInArrow(chain, _PREFIXES)


def end_digests(rows: DataFrame) -> DataFrame:
    """prefixes() to (node, ends_sha256): SHA-256 of the ends' decimal conv_ids, ascending, comma-joined.

    Ids are sorted by ranges and joined to strings of IDS_AT_ONCE first, so a node where many conversations end is dealt
    to many tasks; only the digest itself runs over the strings in order.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(ids):
                to = at + 1
                while to < len(ids) and nodes[to] == nodes[at] and to - at < IDS_AT_ONCE:
                    to += 1
                out.append((nodes[at], ids[at], ",".join(map(str, ids[at:to]))))
                at = to
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.binary(), pa.int64(), pa.string()], strict=True)], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(2)), strict=True):
                if n != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield pa.record_batch([pa.array([n for n, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ends = rows.where("ends").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = ends.mapInArrow(join, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def _with_next(nodes: DataFrame) -> DataFrame:
    """nodes with next_id, the next child of the same parent by conv_id (null for the last).

    A sort by ranges; rows at the ends of ranges look at the first row of the next range, one row a range, so that a
    parent of any number of children is dealt to many tasks.
    """
    fields = nodes.schema
    order = ["parent_conv_id", "depth", "conv_id"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, begun = TaskContext.get().partitionId(), None, False

        def linked(rows: pa.Table, last: bool) -> pa.RecordBatch:
            """rows but the last one, which is held back unless it is the partition's."""
            nonlocal begun
            n = rows.num_rows if last else rows.num_rows - 1
            key = [rows[c].fill_null(-(1 << 63)).to_numpy() for c in order]
            same = (key[0][1:] == key[0][:-1]) & (key[1][1:] == key[1][:-1])
            after = pa.array(np.append(key[2][1:], 0), mask=np.append(~same, True))
            first, end = np.zeros(n, bool), np.zeros(n, bool)
            if n:
                first[0], begun, end[-1] = not begun, True, last
            out = rows.slice(0, n)
            for name, column in (("next_id", after.slice(0, n)), ("range", pa.array(np.full(n, number, np.int64))), ("first", pa.array(first)), ("last", pa.array(end))):
                out = out.append_column(name, column)
            return out

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows > 1:
                yield from linked(held, False).to_batches()
                held = held.slice(held.num_rows - 1)
        if held is not None and held.num_rows:
            yield from linked(held, True).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    rows = nodes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(link, f"{kinds}, next_id long, range long, first boolean, last boolean")
    rows = common.materialize(rows, "siblings")
    firsts = rows.where("first").select("range", *[F.col(c).alias(f"{c}2") for c in order])
    ranges = Window.orderBy("range")  # a row for each range
    before = firsts.select((F.lag("range").over(ranges)).alias("range"), *[f"{c}2" for c in order]).where("range is not null")
    on = F.col("last") & (rows["range"] == before["range"]) & (F.col("parent_conv_id") == F.col("parent_conv_id2")) & (F.col("depth") == F.col("depth2"))
    return rows.join(before, on, "left").select(*nodes.columns, F.coalesce("next_id", "conv_id2").alias("next_id"))


def tour(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, next_id, first_child, weights...) to arcs: conv_id, side, to_conv, to_side, and the weights at enter arcs.

    side is twice the depth, one more for the exit. The exit of the root leads nowhere.
    """
    side = F.col("depth") * 2
    inside, after = F.col("first_child").isNotNull(), F.col("next_id").isNotNull()
    arc = lambda *c: F.struct(*[x.cast("long").alias(n) for n, x in zip(("side", "to_conv", "to_side", "leaves", "saved"), c, strict=True)])
    enter = arc(side, F.coalesce("first_child", "conv_id"), F.when(inside, side + 2).otherwise(side + 1), F.when(inside, 0).otherwise(1), (F.col("n_convs") - 1) * F.col("words"))
    leave = arc(side + 1, F.coalesce("next_id", "parent_conv_id"), F.when(after, side).otherwise(side - 1), F.lit(0), F.lit(0))
    return nodes.select("conv_id", F.explode(F.array(enter, leave)).alias("arc")).select("conv_id", "arc.*")


_RUNS = "conv_id long, side long, to_conv long, to_side long, n long, leaves long, saved long, head boolean"


def shorten(arcs: DataFrame, parts: int) -> DataFrame:
    """Each arc with the link that leaves its range (to_conv, to_side), and sums of n, leaves and saved from it up to there.

    head: no arc of the range leads to it, so links from other ranges may. Ranges are by conv_id and side, where most of
    a tour with children by conv_id stays; with any order the result is right, only longer to rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        conv, side = rows["conv_id"].to_numpy(), rows["side"].to_numpy()
        none = rows["to_conv"].is_null().to_numpy()
        to_conv, to_side = rows["to_conv"].fill_null(0).to_numpy(), rows["to_side"].fill_null(0).to_numpy()
        ids, where = np.unique(conv, return_inverse=True)
        wide = max(int(side.max()), int(to_side.max())) + 2
        keys = where * wide + side
        order = np.argsort(keys, kind="stable")
        near = np.minimum(np.searchsorted(ids, to_conv), len(ids) - 1)
        asked = near * wide + to_side
        found = order[np.minimum(np.searchsorted(keys, asked, sorter=order), len(keys) - 1)]
        here = ~none & (ids[near] == to_conv) & (keys[found] == asked)
        step = np.where(here, found, -1)
        head = np.ones(len(step), bool)
        head[step[here]] = False
        sums = [np.ones(len(step), np.int64), rows["leaves"].to_numpy().copy(), rows["saved"].to_numpy().copy()]
        tail = np.arange(len(step))
        while (more := step >= 0).any():
            at = step[more]
            for s in sums:
                s[more] += s[at]
            tail[more] = tail[at]
            step[more] = step[at]
        out = [rows["conv_id"], rows["side"], rows["to_conv"].take(pa.array(tail)), rows["to_side"].take(pa.array(tail)), *map(pa.array, sums), pa.array(head)]
        yield from pa.table(out, names=["conv_id", "side", "to_conv", "to_side", "n", "leaves", "saved", "head"]).to_batches(max_chunksize=50_000)

    return arcs.select("conv_id", "side", "to_conv", "to_side", "leaves", "saved").repartitionByRange(parts, "conv_id", "side").mapInArrow(run, _RUNS)


def _sums(a: str, b: str) -> list[Column]:
    return [(F.col(f"{a}.{c}") + F.coalesce(F.col(f"{b}.{c}"), F.lit(0))).alias(c) for c in ("n", "leaves", "saved")]


def _reach(links: DataFrame, other: DataFrame) -> DataFrame:
    """links, each as far again as the link that it leads to."""
    on = (F.col("a.to_conv") == F.col("b.conv_id")) & (F.col("a.to_side") == F.col("b.side"))
    open_ = links.where("to_conv is not null").alias("a").join(other.alias("b"), on)
    open_ = open_.select("a.conv_id", "a.side", "b.to_conv", "b.to_side", *_sums("a", "b"))
    return open_.unionByName(links.where("to_conv is null"))


def rank(arcs: DataFrame, parts: int) -> DataFrame:
    """arcs to (conv_id, side, n, leaves, saved): sums from each arc, itself included, to the end of the tour.

    n is the arc's place counted from the end. Rounds are half the logarithm of the links between ranges.
    """
    runs = common.materialize(shorten(arcs, parts), "tour-runs")
    links = common.materialize(runs.where("head").drop("head"), "tour-links")
    while not links.where("to_conv is not null").isEmpty():
        twice = _reach(links, links)
        step = common.materialize(_reach(twice, twice), "tour-links")
        common.drop_materialized(links)
        links = step
    on = (F.col("a.to_conv") == F.col("b.conv_id")) & (F.col("a.to_side") == F.col("b.side"))
    return runs.alias("a").join(links.alias("b"), on, "left").select("a.conv_id", "a.side", *_sums("a", "b"))


def trie(rebuilt: DataFrame) -> DataFrame:
    """rebuild()'s conversations to their trie, a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, enter and leave (places in the tour, from 0).

    n_leaves: nodes of the subtree without children; saved_tokens: over the subtree, (n_convs - 1) times the words of a
    node's last text. The root has no parent; without conversations there are no nodes. Equal prefixes are one node,
    repeated conversations included; columns besides those of rebuild() don't matter.
    """
    rows = common.materialize(prefixes(rebuilt), "prefixes")
    nodes = rows.groupBy("node", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = common.materialize(nodes, "trie-nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "words", "node")
    linked = _with_next(nodes)
    below = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    linked = common.materialize(linked.join(below, ["conv_id", "depth"], "left"), "trie")
    n_arcs = 2 * linked.count()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = rank(tour(linked), max(least, -(-n_arcs // ARCS_AT_ONCE)))
    sign = F.when(F.col("side") % 2 == 0, 1).otherwise(-1)
    place = lambda k: F.lit(n_arcs) - F.max(F.when(F.col("side") % 2 == k, F.col("n")))
    sums = ranked.groupBy("conv_id", F.floor(F.col("side") / 2).alias("depth")).agg(
        F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"), place(0).alias("enter"), place(1).alias("leave")
    )
    out = linked.join(sums, ["conv_id", "depth"]).join(end_digests(rows), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "enter", "leave",
    )

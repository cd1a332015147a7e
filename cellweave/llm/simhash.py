"""SimHash near-dedup with pigeonring filtering.

Two 64-bit fingerprints within d bits, cut into d + 1 segments on a ring, have at some segment a chain whose first l
segments differ in at most floor(l * d / (d + 1)) bits, for every l at once. So the first segment of the chain is equal
and the second differs in one bit at most: these two make the join key (26 bits for d = 4), the longer chains prune
what the key brings together, and the full Hamming distance decides.

Fingerprints stand for all documents that share them, so copies never meet. Within a key, links are emitted as a
spanning forest, not as all pairs: that has the same components. A key with more than TOGETHER members is cut into blocks
of so many, and each two of its blocks meet in a task of their own, so no task holds or compares a whole hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED = 42
#: Members of one key up to which neighbours are compared in pairs; larger ones grow their forest outwards.
PAIRWISE = 32
#: Members of one key that meet in one place; larger keys are dealt out by pairs of blocks of this size.
TOGETHER = 8192
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_CHUNK = 1 << 18


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 segments of 64 bits; two of them and a chain's number have to fit a 64-bit key."""
    if not 2 <= distance <= 15:
        raise ValueError("the distance has to lie between 2 and 15 bits")
    count = distance + 1
    widths = [64 // count + (k < 64 % count) for k in range(count)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """A text's SimHash: ASCII lower case, words between ASCII white space, shingles with repeats, XXH64; no words: 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros((8, 256), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        a, b = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(hashes[:, k], minlength=256)
    ones = (counts @ _BITS).reshape(-1)
    return int(((ones * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", tell_texts: bool = False) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every whole text; null texts have no words. With tell_texts also text_sha256, null as empty."""
    names = ["doc_id", "fp"] + ["text_sha256"] * tell_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                fps = np.array([fingerprint(t, shingle) for t in common.as_bytes(part.column(1))], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), pa.array(fps, pa.int64()), *part.columns[2:]], names)

    sha = [F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")] * tell_texts
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *sha).mapInArrow(run, "doc_id long, fp long" + ", text_sha256 string" * tell_texts)


def _keys(fps: DataFrame, distance: int) -> DataFrame:
    """(key, fp, probe): each fingerprint under its own segments i and i + 1, and as a probe with each 1-bit of segment i + 1 cleared.

    Of two fingerprints that differ in one bit there, the one that has it meets the other's own key; so each pair meets
    once for each of its chains.
    """
    parts = segments(distance)
    own, probes = [], []
    for i, (shift, width) in enumerate(parts):
        nxt, nxt_width = parts[(i + 1) % len(parts)]
        a = f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"
        b = f"(shiftrightunsigned(fp, {nxt}) & {(1 << nxt_width) - 1}L)"
        own.append(f"struct(shiftleft({i}L, 58) | shiftleft({a}, {nxt_width}) | {b} AS key, 0 AS probe)")
        cleared = f"filter(sequence(0, {nxt_width - 1}), p -> (shiftrightunsigned({b}, p) & 1L) = 1L)"
        probes.append(f"transform({cleared}, p -> struct(shiftleft({i}L, 58) | shiftleft({a}, {nxt_width}) | ({b} & ~shiftleft(1L, p)) AS key, 1 AS probe))")
    everything = f"concat(array({', '.join(own)}), {', '.join(probes)})"
    return fps.select("fp", F.expr(f"inline({everything})"))


def _chains(distance: int) -> np.ndarray:
    """For each chain, the bits of its first 1, 2, ... segments."""
    masks = np.array([((1 << w) - 1) << s for s, w in segments(distance)], np.uint64)
    return np.array([np.bitwise_or.accumulate(np.roll(masks, -k)) for k in range(len(masks))])


def _linked(x: np.ndarray, chain: np.ndarray | int, distance: int) -> np.ndarray:
    """Indexes of the differences x that pass their chain's budgets, and then the full distance.

    The key has seen to the first two segments. Each longer chain is asked of those that the shorter ones have left.
    """
    masks, left = _chains(distance), np.arange(len(x))
    for step in range(3, len(masks)):
        bits = masks[chain if np.ndim(chain) == 0 else chain[left], step - 1]
        left = left[np.bitwise_count(x[left] & bits) <= step * distance // len(masks)]
    return left[np.bitwise_count(x[left]) <= distance]


def _forest(fp: np.ndarray, probe: np.ndarray, chain: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one key that span its components: outwards from a member at a time, against those not yet reached."""
    out_a, out_b = [fp[:0]], [fp[:0]]
    while len(fp):
        queue, fp, probe = [(fp[0], probe[0])], fp[1:], probe[1:]
        while queue and len(fp):
            at, probes = queue.pop()
            hit = _linked(fp ^ at, chain, distance)
            if probes:
                hit = hit[probe[hit] == 0]
            if len(hit):
                out_a.append(np.full(len(hit), at))
                out_b.append(fp[hit])
                queue.extend(zip(fp[hit], probe[hit], strict=True))
                fp, probe = np.delete(fp, hit), np.delete(probe, hit)
    return np.concatenate(out_a), np.concatenate(out_b)


def links_of_run(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key."""
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begins, len(key)))
    run = np.repeat(size, size)
    out_a, out_b = [fp[:0]], [fp[:0]]
    some = (run > 1) & (run <= PAIRWISE)
    k, f, p = key[some], fp[some], probe[some]
    for d in range(1, min(PAIRWISE, len(k))):
        same = k[d:] == k[:-d]
        if not same.any():
            break
        pair = np.flatnonzero(same & (p[d:] + p[:-d] < 2))
        hit = pair[_linked(f[pair] ^ f[pair + d], k[pair] >> 58, distance)]
        out_a.append(f[hit])
        out_b.append(f[hit + d])
    for at, n in zip(begins[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
        a, b = _forest(fp[at : at + n], probe[at : at + n], int(key[at]) >> 58, distance)
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


_FOUND = "a long, b long, key long, block long, fp long, probe int"


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
    return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *none], ["a", "b", "key", "block", "fp", "probe"])


def _left_over(rows: list[np.ndarray], seen: int, together: int) -> pa.RecordBatch:
    n = len(rows[0])
    block = (seen + np.arange(n)) // together
    return pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(rows[0]), pa.array(block), pa.array(rows[1].view(np.int64)), pa.array(rows[2].astype(np.int32))], ["a", "b", "key", "block", "fp", "probe"])


def _within_keys(distance: int, together: int):
    """Over rows sorted by key: links of keys with at most `together` members; the members of other keys with the number of their block. Holds no more than that and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot, seen = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)], None, 0
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(np.int64)]
            rows = [np.concatenate(x) for x in zip(held, now, strict=True)]
            while len(rows[0]):
                key = rows[0]
                if hot is None:
                    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    sizes = np.diff(np.append(begins, len(key)))
                    large = begins[sizes > together]
                    cut = int(large[0] if len(large) else begins[-1])  # the last key may go on
                    yield _batch(*links_of_run(*(x[:cut] for x in rows), distance))
                    rows = [x[cut:] for x in rows]
                    if not len(large):
                        break
                    hot, seen = int(key[cut]), 0
                n = int(np.searchsorted(rows[0], hot, side="right"))
                yield _left_over([x[:n] for x in rows], seen, together)
                rows, seen = [x[n:] for x in rows], seen + n
                if len(rows[0]):
                    hot = None
            held = rows
        yield _batch(*links_of_run(*held, distance))

    return run


def _between_blocks(distance: int):
    """Over rows sorted by (key, low, high): links among the members of two blocks of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(5)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            changes = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:3]], axis=0)) + 1
            for begin, end in zip([0, *changes[:-1]], changes, strict=False):
                yield _batch(*span([x[begin:end] for x in held]))
            if len(changes):
                held = [x[changes[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield _batch(*span(held))

    def span(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return _forest(rows[3].view(np.uint64), rows[4].astype(np.int64), int(rows[0][0]) >> 58, distance)

    return run


def link_forest(fps: DataFrame, distance: int = 4, together: int | None = None) -> DataFrame:
    """(a, b): links within `distance` bits between distinct fingerprints (column fp), enough to span each component.

    A key of n members is dealt over n / together blocks and each pair of blocks is one group of at most 2 * together
    members: exact, spread over tasks, and bounded in each of them.
    """
    together = together or TOGETHER
    keyed = _keys(fps, distance).repartition("key").sortWithinPartitions("key").select("key", "fp", F.col("probe").cast("int"))
    found = common.materialize(keyed.mapInArrow(_within_keys(distance, together), _FOUND), "links")
    links, members = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", "block", "fp", "probe")
    if members.isEmpty():
        return links
    blocks = common.materialize(members.groupBy("key").agg((F.max("block") + 1).alias("blocks")), "hot-keys")
    met = members.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", "probe")
    met = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return links.unionByName(met.mapInArrow(_between_blocks(distance), _FOUND).select("a", "b"))


def _components(docs: DataFrame, distance: int, shingle: int, **how) -> DataFrame:
    """Per row of docs: doc_id, fp, component (the least fingerprint linked), component_id, and text_sha256 if told apart."""
    rows = common.materialize(fingerprints(docs, shingle, **how), "fingerprints")
    distinct = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    parts = common.materialize(connected_components(link_forest(distinct.select("fp"), distance)), "components")
    whole = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(whole.join(named, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, **how) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links of at most `distance` bits).

    Null texts have no words and fingerprint zero, which links as any other. Rows with a null doc_id link too but never
    name a component; a component of such rows alone has a null name. Repeated rows are rows of one component; columns
    besides id and text are left out, whatever their names; an empty input gives no rows.
    """
    return _components(docs, distance, shingle, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """docs, with one document of each component: the one with the least doc_id (null ids last), and of several texts under that id the one with the least SHA-256.

    Rows that repeat both id and text of the one that stays are that document, and stay too. All columns are kept; an
    empty input gives no rows.
    """
    found = common.materialize(_components(docs, distance, shingle, tell_texts=True).select("doc_id", "text_sha256", "component"), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_sha256")).alias("first")
    groups = found.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1")
    gone = found.join(groups, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_sha256") == F.col("first.text_sha256"))))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return common.without(docs, gone.select("doc_id", "text_sha256").distinct(), {"doc_id": F.col("doc_id").cast("long"), "text_sha256": sha})

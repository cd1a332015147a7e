"""Line dedup by two Bloom filters, of the line hashes seen once and of those seen twice.

Only lines that the second filter suspects leave their document: they are shuffled whole, counted exactly, and lose all
places but one. Filters are a table of 64-bit slots, a few hashes each, so they grow with the corpus, are built from
hashes alone and are looked up by an equi-join; a task holds a block of slots at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of a key, and documents that hold it, from which on it counts as repeated.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Hashes for each 64-bit slot of a filter on average, the bits that each sets in it, and the slots that a task builds at once.
SLOT_HASHES, BITS, BLOCK_SLOTS = 4, 4, 1 << 14
_BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased (other letters are kept as they are)."""
    return line.strip(_BLANK).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in map(key_of, text.split(b"\n")) if _long_enough(k, least)}


def _hash(key: bytes) -> int:
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and ref, a hash of both. Where refs meet, two documents are only looked at together; ids and keys decide."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("ref"))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ref, hashes: for each document the distinct hashes of its keys of at least least_chars code points; documents without any are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                found = [list({_hash(k) for k in _keys(t, least_chars)}) for t in common.as_bytes(part.column(0))]
                rows = pa.record_batch([part.column(1), pa.array(found, pa.list_(pa.int64()))], ["ref", "hashes"])
                yield rows.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return _numbered(docs, id_col, text_col).select("text", "ref").mapInArrow(cut, "ref long, hashes array<long>")


def _slot(h: Column, slots: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6 * BITS), F.lit(slots))


def _mask(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    for k in range(BITS):
        out |= np.uint64(1) << ((h.view(np.uint64) >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _in_mask(h: Column, bits: Column) -> Column:
    """Whether all bits of a hash are set in a slot."""
    inside = F.lit(True)
    for k in range(BITS):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        inside &= F.call_function("getbit", bits, place) == 1
    return inside


def filters(hashes: DataFrame, slots: int) -> DataFrame:
    """hashes (h, one row for each place) to (slot, once, twice): bits that at least one place, and at least two places, have set.

    A hash that is in two places has all its bits in twice, so no repeat is missed. Each task of the input first keeps
    what it has seen of a hash to one row, so a hot hash is a row for each slice, not for each place.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(n > 1)], ["h", "again"])

    def build(table: pa.Table) -> pa.Table:
        slot, mask = table["slot"].to_numpy(), _mask(table["h"].to_numpy())
        mask = np.concatenate([mask, mask[table["again"].to_numpy()]])
        slot = np.concatenate([slot, slot[table["again"].to_numpy()]])
        order = np.argsort(slot, kind="stable")
        slot, mask = slot[order], mask[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        once, twice = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
        for bit in map(np.uint64, range(64)):
            places = np.add.reduceat((mask >> bit) & np.uint64(1), first)
            once |= (places > 0).astype(np.uint64) << bit
            twice |= (places > 1).astype(np.uint64) << bit
        return pa.table({"slot": slot[first], "once": once.view(np.int64), "twice": twice.view(np.int64)})

    rows = hashes.select("h").mapInArrow(seen, "h long, again boolean").withColumn("slot", _slot(F.col("h"), slots))
    return rows.groupBy(F.floor(F.col("slot") / BLOCK_SLOTS).alias("block")).applyInArrow(build, "slot long, once long, twice long")


def suspects(hashed: DataFrame) -> DataFrame:
    """line_hashes() (written) to (ref, hashes): the hashes of each document that the filter of twice-seen hashes holds."""
    places = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    slots = max(1, places // SLOT_HASHES)
    each = hashed.select("ref", F.explode("hashes").alias("h"))
    twice = common.materialize(filters(each, slots), "line-filters").where("twice <> 0").select("slot", "twice")
    found = each.withColumn("slot", _slot(F.col("h"), slots)).join(twice, "slot").where(_in_mask(F.col("h"), F.col("twice")))
    return found.groupBy("ref").agg(F.collect_set("h").alias("hashes"))


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ref, doc_id, key: the keys that each document has to give up, as another one with a larger doc_id keeps them.

    A row of docs is a document, whatever its id; rows that share the largest doc_id of a key all keep its lines; a null
    id is smaller than any other. Tables of the steps are deleted.
    """
    hashed = common.materialize(line_hashes(docs, least_chars, id_col, text_col), "line-hashes")
    suspected = common.materialize(suspects(hashed), "line-suspects")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                texts, asked = common.as_bytes(part.column(0)), part.column(3).to_pylist()
                found = [[k for k in _keys(t, least_chars) if _hash(k) in a] for t, a in zip(texts, map(set, asked), strict=True)]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                keys = pa.array([k for f in found for k in f], pa.binary())
                yield pa.record_batch([keys, part.column(1).take(pa.array(at)), part.column(2).take(pa.array(at))], ["key", "doc_id", "ref"])

    rows = _numbered(docs, id_col, text_col).join(suspected, "ref").select("text", "doc_id", "ref", "hashes")
    places = common.materialize(rows.mapInArrow(held, "key binary, doc_id long, ref long"), "line-places")
    often = places.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs).select("key", "last")
    often = common.materialize(often, "repeated-lines")  # so that both sides of the join are plain shuffles, whose hot keys AQE can split
    out = common.materialize(places.join(often, "key").where("doc_id < last or doc_id is null and last is not null").select("ref", "doc_id", "key"), "lost-lines")
    for table in (hashed, suspected, places, often):
        common.drop_materialized(table)
    return out


def without_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text without the lines it loses, n_lines (before), n_dropped, kept_sha256 (hex of the UTF-8).

    Lines end at \\n; null and empty texts are one empty line. A line's key is the line without ASCII white space at both
    ends, A-Z lower-cased; keys of at least least_chars code points in at least least_docs rows lose all their lines but
    those of the largest doc_id that holds them (null ids are the smallest; rows that share that id all keep theirs).
    Repeats of a line within a document that keeps it stay. Rows that repeat id and text are documents of their own.
    Columns besides id and text are left out, whatever their names; an empty table gives no rows. Any text has to fit in
    a row; a document's lost keys are one list, no longer than its text.
    """
    lost = repeated_lines(docs, least_chars, least_docs, id_col, text_col)
    lost = lost.groupBy("ref", "doc_id").agg(F.collect_set("key").alias("lost")).select(F.col("ref").alias("ref2"), F.col("doc_id").alias("id2"), "lost")
    rows = _numbered(docs, id_col, text_col)
    rows = rows.join(lost, (F.col("ref") == F.col("ref2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left").select("text", "doc_id", "lost")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                kept, lines, dropped = [], [], []
                for text, gone in zip(common.as_bytes(part.column(0)), part.column(2).to_pylist(), strict=True):
                    all_lines = text.split(b"\n")
                    left = [x for x in all_lines if key_of(x) not in set_of] if (set_of := set(gone or ())) else all_lines
                    kept.append(b"\n".join(left))
                    lines.append(len(all_lines))
                    dropped.append(len(all_lines) - len(left))
                digests = [hashlib.sha256(k).hexdigest() for k in kept]
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.record_batch([part.column(1), texts, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)], ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(keep, "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string")

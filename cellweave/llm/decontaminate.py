"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Benchmark and corpus words become numbers of the benchmark's vocabulary (0 for any other word), the automaton runs over
them once per document, and word numbers lead back to places in the original text.

A worker holds one automaton, of at most BLOCK_BYTES of benchmark text, and keeps it for all its tasks. A larger benchmark
takes one job a block, each of which writes what it finds; a document's findings meet by its text's SHA-256.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
#: Benchmark text that one automaton holds and that is sent to executors at once; a larger benchmark takes several passes.
BLOCK_BYTES = 2 << 20
#: Words are runs of ASCII letters and digits (lower-cased) and of anything beyond ASCII; all else becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def word_spans(text: bytes, positions: np.ndarray) -> list[tuple[int, int]]:
    """Byte offsets in the original text of the words at these positions."""
    mask = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [(int(edge[2 * p]), int(edge[2 * p + 1])) for p in positions]


class Automaton:
    """Windows of some benchmark items: `size` consecutive words, or a shorter item's all."""

    #: The one that this worker made last, by its block's key.
    _made: dict[str, Automaton] = {}

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW) -> None:
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        lengths, owners = array("b"), array("i")  # of each window, by its number
        self.more: dict[int, list[int]] = {}  # further owners of windows that several items have
        for k, (_, text) in enumerate(items):
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            for at in range(max(len(ids) - size, 0) + 1 if ids else 0):
                window = ids[at : at + size]
                known = self.automaton.get(window, -1)
                if known < 0:
                    self.automaton.add_word(window, len(owners))
                    lengths.append(len(window))
                    owners.append(k)
                elif owners[known] != k:
                    self.more.setdefault(known, []).append(k)
        self.lengths, self.owners = lengths, owners
        if len(owners):
            self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, items: list[tuple[str, bytes]], size: int) -> Automaton:
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(items, size)
        return cls._made[key]

    def scan(self, tokens: list[bytes]) -> tuple[set[str], np.ndarray]:
        """Items with a window in these words, and the positions of the words hit."""
        windows, hit = set(), set()
        if len(self.owners):
            get = self.vocabulary.get
            for end, window in self.automaton.iter(tuple([get(w, 0) for w in tokens])):
                windows.add(window)
                hit.update(range(end - self.lengths[window] + 1, end + 1))
        found = {self.items[self.owners[w]] for w in windows} | {self.items[k] for w in windows for k in self.more.get(w, ())}
        return found, np.array(sorted(hit), np.int64)


def _parts(item: str, text: bytes, most: int, size: int) -> Iterator[tuple[str, bytes]]:
    """An item, or where its text is longer than a block, stretches of its words that share their windows' overlaps."""
    if len(text) <= most:
        yield item, text
        return
    tokens, begin = words(text), 0
    while begin == 0 or begin + size - 1 < len(tokens):
        end, held = begin, 0
        while end < len(tokens) and (end - begin < size or held < most):
            held += len(tokens[end]) + 1
            end += 1
        yield item, b" ".join(tokens[begin:end])
        begin = max(end - size + 1, begin + 1)


def _blocks(items: DataFrame, most: int, size: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in blocks of about `most` bytes of text, one at a time on the driver. One empty block without items."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    block: list[tuple[str, bytes]] = []
    held = sent = 0
    for row in rows.toLocalIterator():
        for item, text in _parts(row["item_id"], bytes(row["text"]), most, size):
            if block and held + len(text) > most:
                yield block
                block, held, sent = [], 0, sent + 1
            block.append((item, text))
            held += len(text)
    if block or not sent:
        yield block


STATE = "n_words long, hits array<int>, found array<string>"


def _scanned(sent, key: str, size: int):
    """A block's automaton over texts."""

    @F.arrow_udf(STATE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            automaton = Automaton.of(key, sent.value, size)
            n, hits, found = [], [], []
            for text in as_texts(texts):
                tokens = words(text)
                items, positions = automaton.scan(tokens)
                n.append(len(tokens))
                hits.append(positions.tolist())
                found.append(sorted(items))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], ["n_words", "hits", "found"])

    return run


@F.arrow_udf(T.LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) for t in as_texts(texts)], pa.int64())


def as_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, one at a time."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def found_in(docs: DataFrame, items: DataFrame, state: str, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """docs with the column `state`: n_words, hits (positions of words hit), found (items).

    A benchmark of one block is scanned for where docs are read, without a shuffle. Of a larger one each block's findings
    are written in a job of its own, so that a worker never holds two automata, and joined to docs by their texts' hash.
    """
    blocks = _blocks(items, block_bytes, size)
    block, rest = next(blocks), next(blocks, None)
    context = docs.sparkSession.sparkContext
    if rest is None:
        return docs.withColumn(state, _scanned(context.broadcast(block), uuid.uuid4().hex, size)(F.col(text_col)))
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    written = []
    for one in chain([block, rest], blocks):
        sent = context.broadcast(one)
        hits = docs.select(sha.alias("sha"), _scanned(sent, uuid.uuid4().hex, size)(F.col(text_col)).alias("s")).where(F.size("s.hits") > 0)
        written.append(common.materialize(hits.select("sha", "s.hits", "s.found").dropDuplicates(["sha"]), "benchmark-hits"))
        sent.destroy()
    merged = reduce(DataFrame.unionByName, written).groupBy("sha").agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "found")])
    merged = common.materialize(merged, "benchmark-findings")
    for table in written:
        common.drop_materialized(table)
    key, hit, found = common.fresh(docs, "sha", "hits", "found")
    none = [F.array().cast(t) for t in ("array<int>", "array<string>")]
    joined = docs.withColumn(key, sha).join(merged.select(F.col("sha").alias(key), F.col("hits").alias(hit), F.col("found").alias(found)), key, "left")
    whole = F.struct(_n_words(F.col(text_col)).alias("n_words"), F.coalesce(hit, none[0]).alias("hits"), F.coalesce(found, none[1]).alias("found"))
    return joined.withColumn(state, whole).select(*docs.columns, state)


def contaminated(state: str) -> Column:
    n_hit = F.size(F.col(state)["hits"])
    return (n_hit > 0) & (n_hit * 20 >= F.col(state)["n_words"])


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (ids sorted as strings, comma-joined), items_sha256, contaminated.

    A document is contaminated if a word is hit and the words hit are a twentieth of its words or more. Null and empty
    texts have no words; items with a null id or no words have no windows; an item_id given twice counts once. Null and
    repeated doc_ids are judged row by row; columns of docs besides doc_id and text are left out, whatever their names; no
    documents give no rows, an empty benchmark hits nothing.
    """
    rows = found_in(docs.select(F.col("doc_id").cast("long"), "text"), items, "state", size, block_bytes)
    joined = F.array_join("state.found", ",")
    return rows.select(
        "doc_id",
        F.col("state.n_words").alias("n_words"),
        F.size("state.hits").cast("long").alias("n_hit"),
        F.size("state.found").cast("long").alias("n_items"),
        joined.alias("items"),
        F.sha2(joined, 256).alias("items_sha256"),
        contaminated("state").alias("contaminated"),
    )


def hit_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, items and spans (byte offsets in the original UTF-8 of the words hit), for the documents with a hit."""

    @F.arrow_udf("array<struct<begin:long,end:long>>")
    def spans(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = [[{"begin": a, "end": b} for a, b in word_spans(t, np.array(h, np.int64))] for t, h in zip(as_texts(texts), hits.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))

    rows = found_in(docs.select(F.col("doc_id").cast("long"), "text"), items, "state", size, block_bytes).where(F.size("state.hits") > 0)
    return rows.select("doc_id", F.col("state.found").alias("items"), spans("text", "state.hits").alias("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated rows; judged and filtered where they are read, so no text is shuffled."""
    state = common.fresh(docs, "state")[0]
    return found_in(docs, items, state, size, block_bytes).where(~contaminated(state)).drop(state)

"""Alignment of two tokenizers' tokens by byte ranges.

Both token sequences of a document cover the same bytes. Per batch, pandas merge_asof, keyed by document, finds for each
token start the token of the other side that covers it; both directions together are all overlaps, overlaps with equal
ends are links, and a link closes a group. Counts of linked ids over the corpus are a shuffle of each batch's distinct
id pairs, and go back to the batch that asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import PieceEncoder, byte_bpe_path
from .tokens import byte_level as _byte_level

#: Text bytes encoded at once, whose id pairs are listed together, and known pieces that a worker keeps for each side.
SLICE_BYTES, ENTRIES = 2 << 20, 250_000
#: Text bytes of a slice aligned at once (a longer document is still taken whole): some 100 bytes for each are needed meanwhile.
ALIGNED_BYTES = 256 << 10


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Side(PieceEncoder):
    """An encoder that also knows its tokens' bytes, and which pieces they don't spell."""

    entries = ENTRIES
    token_bytes: list[bytes]

    def _spell(self) -> None:
        """Token bytes as one Arrow array, and their numbers; set once the vocabulary is read."""
        self.spelling = pa.array(self.token_bytes, pa.large_binary())
        self.token_sizes = np.array([len(t) for t in self.token_bytes])

    def _forget(self) -> None:
        super()._forget()
        self.wrong = np.zeros(0, bool)

    def _make_room(self, room: int) -> None:
        again, wrong = self.met > 1, self.wrong
        super()._make_room(room)
        if len(self.known) == again.sum():
            self.wrong = wrong[again]

    def _remember(self, pieces: list[bytes]) -> None:
        n = len(self.known)
        super()._remember(pieces)
        self.wrong = np.append(self.wrong, self._misspelt(self.flat[self.begins[n] :], self.begins[n:] - self.begins[n], pieces))

    def _misspelt(self, ids: np.ndarray, begins: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Which pieces differ from their tokens' bytes: in length, or else byte by byte."""
        asked = np.fromiter(map(len, pieces), np.int64, len(pieces))
        wrong = np.diff(np.append(0, np.cumsum(self.token_sizes[ids]))[begins]) != asked
        same = ~wrong
        spelt = self.spelling.take(pa.array(ids[np.repeat(same, np.diff(begins))], pa.int64()))
        ours, theirs = (np.frombuffer(x or b"", np.uint8) for x in (spelt.buffers()[2], b"".join(compress(pieces, same))))
        ends = np.append(0, np.cumsum(asked[same]))
        differ = np.append(0, np.cumsum(ours[: ends[-1]] != theirs))
        wrong[same] = np.diff(differ[ends]) > 0
        return wrong

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, where each text's begin, and whether the text's tokens spell it."""
        _, _, pieces, before = self._pieces(texts)
        where = self._looked_up(pieces)
        bad = np.append(0, np.cumsum(self.wrong[where]))
        return *self._joined(where, before), np.diff(bad[before]) == 0


class ByteLevelSide(_Side):
    """A byte-level vocabulary of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        byte_of, vocabulary = _byte_level(), self.tokenizer.get_vocab()
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self._spell()


def _mark_spaces(data: np.ndarray, cut: np.ndarray) -> None:
    """No piece of a sentencepiece vocabulary holds a newline, or a space after something else: nothing is merged across their starts."""
    cut[1:] |= (data[1:] == 10) | ((data[1:] == 32) & (data[:-1] != 32))


class SentencePieceSide(_Side):
    """A sentencepiece vocabulary with byte fallback that puts a space before each text; texts come with that space."""

    mark = staticmethod(_mark_spaces)

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = [p for i, p in enumerate(pieces) if "\n" in p or "▁" in p.lstrip("▁")]
        if inner:
            raise ValueError(f"pieces go on after white space: {inner[:3]}")
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        self._spell()
        self._forget()

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The model adds a space: it stands for the one that a piece begins with, or is taken off again before a newline."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        got = self.model.encode([t[1:] if t.startswith(" ") else t for t in texts], num_threads=1)
        return [[self.space] if t == " " else ids if t.startswith(" ") else ids[1:] for t, ids in zip(texts, got, strict=True)]


@dataclass
class Aligned:
    """Some documents, those with tokens joined end to end. Token places are within them."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray  # tokens of each document
    n_b: np.ndarray
    overlap_a: np.ndarray  # places of tokens that share bytes, ordered
    overlap_b: np.ndarray
    link_a: np.ndarray  # places of tokens that end together, ordered: the last of each group
    link_b: np.ndarray
    n_links: np.ndarray  # of each document


def _covering(ours: np.ndarray, doc: np.ndarray, theirs: np.ndarray, their_doc: np.ndarray) -> np.ndarray:
    """The place of the other side's token that covers each start."""
    left = pd.DataFrame({"doc": doc, "start": ours})
    right = pd.DataFrame({"doc": their_doc, "start": theirs, "place": np.arange(len(theirs))})
    return pd.merge_asof(left, right, on="start", by="doc")["place"].to_numpy().astype(np.int64)


def _kept(flat: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.where(ok, np.diff(at), 0)
    return flat[np.repeat(ok, np.diff(at))], n


class Aligner:
    """One per Python worker and pair of vocabularies."""

    def __init__(self, a: ByteLevelSide, b: SentencePieceSide) -> None:
        self.a, self.b = a, b
        self.size_a, self.size_b = a.token_sizes, b.token_sizes
        after = lambda n, ends: [f"{i}{e}".encode() for i in range(n) for e in ends]
        self.words = pa.array(after(len(self.size_a), ",|") + after(len(self.size_b), ",;"), pa.large_binary())

    @staticmethod
    @cache
    def of(path_a: str, path_b: str) -> Aligner:
        return Aligner(ByteLevelSide.of(path_a), SentencePieceSide.of(path_b))

    def aligned(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
        """A slice's rows (texts in its second column), encoded together, and aligned some at a time."""
        flat_a, n_a, flat_b, n_b = self._encoded(batch.column(1))
        ends_a, ends_b, at = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b)), 0
        for rows in common.slices(batch, 1, ALIGNED_BYTES):
            to = at + len(rows)
            yield rows, self._align(flat_a[ends_a[at] : ends_a[to]].astype(np.int64), n_a[at:to], flat_b[ends_b[at] : ends_b[to]].astype(np.int64), n_b[at:to])
            at = to
        pa.default_memory_pool().release_unused()  # what a slice has freed doesn't stay with the worker

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each side's ids of all texts that have tokens, and the number of each text."""
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()))
        flat_a, at_a, ok_a = self.a.encoded(spaced)
        flat_b, at_b, ok_b = self.b.encoded(spaced)
        ok = ok_a & ok_b & (pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) > 0)
        return *_kept(flat_a, at_a, ok), *_kept(flat_b, at_b, ok)

    def _align(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> Aligned:
        doc_a, doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        size_a, size_b = self.size_a[ids_a], self.size_b[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)  # both sides of a document have the same bytes, so ends go on over documents
        start_a, start_b = end_a - size_a, end_b - size_b
        over_a, over_b = _covering(start_a, doc_a, start_b, doc_b), _covering(start_b, doc_b, start_a, doc_a)
        more = start_a[over_b] < start_b  # equal starts are found from both sides
        left = np.concatenate([np.arange(len(ids_a)), over_b[more]])
        right = np.concatenate([over_a, np.flatnonzero(more)])
        order = np.argsort(np.maximum(start_a[left], start_b[right]), kind="stable")
        left, right = left[order], right[order]
        linked = end_a[left] == end_b[right]
        link_a, link_b = left[linked], right[linked]
        return Aligned(ids_a, ids_b, n_a, n_b, left, right, link_a, link_b, np.bincount(doc_a[link_a], minlength=len(n_a)))

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each document's groups as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        last_a, last_b = np.zeros(len(x.ids_a), np.int64), np.zeros(len(x.ids_b), np.int64)
        last_a[x.link_a], last_b[x.link_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b, upto_a = np.append(0, x.link_b + 1), x.link_a + 1
        codes = np.empty(len(x.ids_a) + len(x.ids_b), np.int64)
        codes[np.arange(len(x.ids_a)) + before_b[group_a]] = 2 * x.ids_a + last_a
        codes[np.arange(len(x.ids_b)) + upto_a[group_b]] = 2 * (len(self.size_a) + x.ids_b) + last_b
        text = self.words.take(pa.array(codes))
        ends = np.frombuffer(text.buffers()[1], np.int64, len(codes) + 1, text.offset * 8)
        data = memoryview(text.buffers()[2] or b"")
        at = ends[np.append(0, np.cumsum(x.n_a + x.n_b))].tolist()
        return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(at[:-1], at[1:], strict=True)]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ids_a, ids_b, overlaps and groups, both as arrays of (a, b), places in ids_a and ids_b.

    An overlap is two tokens that share bytes; a group is named by its last two tokens, which end together. Texts that
    are null or empty, or that the tokens of a side don't spell, have no tokens; rows that repeat an id or a text are rows
    of their own; other columns are left out, whatever their names; an empty table gives no rows. A document is aligned
    at once, at some 100 bytes for each byte of its text.
    """
    path_a, path_b = path_a or byte_bpe_path(), path_b or piece_bpe_path()
    places = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        for batch in batches:
            for part, x in chain.from_iterable(map(aligner.aligned, common.slices(batch, 1, SLICE_BYTES))):
                first_a, first_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                doc_of = np.repeat(np.arange(len(x.n_a)), x.n_a)

                def pairs(left: np.ndarray, right: np.ndarray) -> pa.Array:
                    doc = doc_of[left]
                    sizes = np.bincount(doc, minlength=len(x.n_a))
                    both = pa.StructArray.from_arrays([pa.array(left - first_a[doc], pa.int32()), pa.array(right - first_b[doc], pa.int32())], ["a", "b"])
                    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), both).cast(places)

                yield pa.record_batch([part.column(0), _lists(x.ids_a, x.n_a), _lists(x.ids_b, x.n_b), pairs(x.overlap_a, x.overlap_b), pairs(x.link_a, x.link_b)], ["doc_id", "ids_a", "ids_b", "overlaps", "groups"])

    kinds = "doc_id long, ids_a array<int>, ids_b array<int>, overlaps array<struct<a int, b int>>, groups array<struct<a int, b int>>"
    return _prepared(docs, id_col, text_col).mapInArrow(run, kinds)


_LINKS = "slice long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, pairs array<long>, counts array<long>"


def link_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document, with its links as places in its slice's list of id pairs, and a row per slice with that list (a << 32 | b) and the links of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner.of(path_a, path_b), TaskContext.get().partitionId() << 32
        for part in chain.from_iterable(common.slices(b, 1, SLICE_BYTES) for b in batches):
            sizes, linked, digests = [], [], []
            for _, x in aligner.aligned(part):
                sizes.append((x.n_a, x.n_b, x.n_links))
                linked.append(x.ids_a[x.link_a] << 32 | x.ids_b[x.link_b])
                digests += aligner.digests(x)
            pairs, codes, counts = np.unique(np.concatenate(linked), return_inverse=True, return_counts=True)
            n_a, n_b, n_links = map(np.concatenate, zip(*sizes, strict=True))
            n = len(part)
            none = lambda k, kind: pa.nulls(k, kind)
            longs = pa.list_(pa.int64())
            columns = [pa.array(np.full(n, number)), part.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(digests), _lists(codes, n_links), none(n, longs), none(n, longs)]
            names = [f.split(" ")[0] for f in _LINKS.split(", ")]
            yield pa.record_batch(columns, names)
            listed = [pa.array([number]), *[none(1, c.type) for c in columns[1:7]], pa.array([pairs], longs), pa.array([counts], longs)]
            yield pa.record_batch(listed, names)
            number += 1

    return docs.mapInArrow(run, _LINKS)


def pair_counts(slices: DataFrame) -> DataFrame:
    """(pair, n) to (pair, count, best): links of each id pair over the corpus, and whether no other pair of its B id has more.

    A B id has at most as many pairs as the other vocabulary has ids.
    """
    counts = slices.groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def alignment_digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see align() for odd rows.

    n_links: pairs of tokens that end together; count_sum: over them, the links of their id pair in the whole corpus;
    n_best: those whose count is the highest of their B id, ties included. Counts are joined per slice of the written
    table, so the shuffle holds each id pair once a slice, and a document is joined only with its slice's pairs.
    """
    path_a, path_b = path_a or byte_bpe_path(), path_b or piece_bpe_path()
    table = common.materialize(link_table(_prepared(docs, id_col, text_col), path_a, path_b), "token-links")
    asked = table.where("pairs is not null").select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("slice", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    judged = common.materialize(pair_counts(asked.select("pair", "n")), "pair-counts")
    answers = asked.join(judged, "pair").select(F.col("slice").alias("asked_by"), "place", "count", "best")

    def gather(rows: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts["place"].to_numpy())
        count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)
        links = rows["links"].combine_chunks()
        ends = np.append(0, np.cumsum(rows["n_groups"].to_numpy()))
        codes = links.flatten().to_numpy()
        total, good = (np.append(0, np.cumsum(v[codes]))[ends] for v in (count, best))
        n_links = pa.array(np.diff(ends))
        return pa.table([rows["doc_id"], rows["n_a"], rows["n_b"], rows["n_groups"], n_links, pa.array(np.diff(good)), pa.array(np.diff(total)), rows["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = table.where("pairs is null").drop("pairs", "counts")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("slice").cogroup(answers.groupBy("asked_by")).applyInArrow(gather, kinds)

"""Exact token ids and counts by the tokenizers library, at the cost of one library call per distinct word and task.

A text is cut where every split rule of the two vocabularies (byte_bpe_50k, word_bpe_49k) ends a pre-token whatever
follows: before ASCII white space that follows something else, and before one of ``,.!?;:`` that follows an ASCII
letter. Token sequences of such pieces join to the text's own, so each distinct piece is encoded once by the library
and looked up afterwards (prefixes.py counts the prefixes of pieces). Special strings hold neither white space nor these marks and stay in one piece, so the
library treats them by its default.
"""

from __future__ import annotations

from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

#: Pieces that a worker remembers, some 150 bytes each; beyond it, it keeps those that it has met again since. Bounds memory, never results.
CACHE_ENTRIES = 300_000
#: Pieces handed to the library at once, which holds some 1 KB for each until its ids are taken.
ENCODED_AT_ONCE = 10_000
#: Pieces that are written one after another into one text for the library, where they can be told apart again.
JOINED = 32
#: ASCII white space, before which a text is cut.
BLANKS = " \t\n\v\f\r"
#: Bytes of one text that are cut at once.
WINDOW = 8 << 20


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) < 5)


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data | np.uint8(32)) - np.uint8(97)) < 26


def _marks(data: np.ndarray) -> np.ndarray:
    out = data == ord(",")
    for mark in b".!?;:":
        out |= data == mark
    return out


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position is white space beyond ASCII (two or three bytes in UTF-8)."""
    p1, p2, p3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    general = (p3 == 0xE2) & (p2 == 0x80) & (((p1 >= 0x80) & (p1 <= 0x8A)) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
    others = ((p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)) | ((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80))
    return two | general | others


def mark_starts(data: np.ndarray, cut: np.ndarray) -> None:
    """Set cut where a piece of this buffer of UTF-8 can start, besides 0."""
    space = _spaces(data)
    cut[1:] |= space[1:] & ~space[:-1]
    cut[1:] |= _marks(data[1:]) & _letters(data[:-1])
    at = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    cut[at[_after_wide_space(data, at)]] = False


def byte_level() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next code point from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def _token_sizes(tokenizer) -> np.ndarray | None:
    """Bytes of each token of a vocabulary that spells texts byte by byte; None if it doesn't."""
    pre = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or type(pre).__name__ != "ByteLevel" or pre.add_prefix_space:
        return None
    byte_of, vocabulary = byte_level(), tokenizer.get_vocab()
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token) if all(c in byte_of for c in token) else len(token.encode())
    return sizes


class PieceEncoder:
    """One per Python worker and vocabulary."""

    _made: dict[tuple[type, str], PieceEncoder] = {}
    entries: int | None = None  # pieces that it remembers, where fewer than CACHE_ENTRIES
    sizes: np.ndarray | None = None  # bytes of each token, where they spell the text
    mark = staticmethod(mark_starts)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.sizes = _token_sizes(self.tokenizer)
        self._forget()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and each piece's number of ids."""
        got = self._encode(pieces)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), "<u4", int(lengths.sum())), lengths

    def _encode_joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same with fewer calls of the library, whose cost is more than that of a short piece: pieces that begin with a
        blank and don't end with one, between which every text is cut, are joined, and parted again by their tokens' sizes."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        joins = np.fromiter((t[0] in BLANKS and not t[-1].isspace() for t in texts), bool, len(texts))
        together = list(compress(pieces, joins))
        ids, _ = self._encode_flat([b"".join(together[at : at + JOINED]) for at in range(0, len(together), JOINED)])
        ends, asked = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
        last = np.searchsorted(ends, asked)
        if not len(ends) or ends[-1] != asked[-1] or (ends[last] != asked).any():
            return self._encode_flat(pieces)
        others, n = self._encode_flat(list(compress(pieces, ~joins)))
        lengths = np.zeros(len(pieces), np.int64)
        lengths[joins], lengths[~joins] = np.diff(last, prepend=-1), n
        which = np.repeat(joins, lengths)
        flat = np.zeros(len(which), "<u4")
        flat[which], flat[~which] = ids, others
        return flat, lengths

    def forget(self) -> None:
        """Give the memory of known pieces back, where a worker has done its task."""
        self._forget()

    def _forget(self) -> None:
        """Known pieces and their places, all their ids in a row, where each piece's begin, and in how many slices each was met."""
        self.known: dict[bytes, int] = {}
        self.flat, self.begins = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int32)

    def _make_room(self, room: int) -> None:
        """Forget pieces that only one slice had; all, where too few are those."""
        again = np.flatnonzero(self.met > 1)
        if len(again) > min(room, len(self.known) // 2):
            self._forget()
            return
        pieces = list(self.known)
        first, lengths = self.begins[again], np.diff(self.begins)[again]
        ends = np.append(0, np.cumsum(lengths))
        self.flat = self.flat[np.repeat(first - ends[:-1], lengths) + np.arange(ends[-1])]
        self.begins, self.met = ends, np.ones(len(again), np.int32)
        self.known = {pieces[k]: i for i, k in enumerate(again.tolist())}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if (cls, path) not in cls._made:
            cls._made[cls, path] = cls(path)
        return cls._made[cls, path]

    def _remember(self, pieces: list[bytes]) -> None:
        lengths, ids = [], []
        for at in range(0, len(pieces), ENCODED_AT_ONCE):
            flat, n = (self._encode_flat if self.sizes is None else self._encode_joined)(pieces[at : at + ENCODED_AT_ONCE])
            lengths.append(n)
            ids.append(flat)
        ends = np.cumsum(np.concatenate(lengths))
        self.begins = np.concatenate([self.begins, ends + self.begins[-1]])
        self.flat = np.concatenate([self.flat, *ids])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.met = np.append(self.met, np.zeros(len(pieces), np.int32))

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each distinct piece is among the known ones; new ones are encoded."""
        pieces = distinct.to_pylist()
        find = lambda: np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        places = find()
        most = self.entries or CACHE_ENTRIES
        if len(self.known) + np.count_nonzero(places < 0) > most:
            self._make_room(most - len(pieces))
            places = find()
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._remember([pieces[k] for k in new.tolist()])
        self.met[places] += 1
        return places

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Starts and ends of all pieces in the texts' buffer, them as an Arrow array, and the number before each text."""
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = np.zeros(len(data) + 1, bool)
        for at in range(0, len(data), WINDOW):  # three bytes more, for the character before the window
            low = max(0, at - 3)
            found = np.zeros(len(data[low : at + WINDOW]), bool)
            self.mark(data[low : at + WINDOW], found)
            cut[at : at + len(found) - (at - low)] = found[at - low :]
        cut[bounds] = True
        starts = np.flatnonzero(cut[: len(data)])
        ends = np.append(starts[1:], len(data)).astype(np.int64)[: len(starts)]
        offsets = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]) if len(starts) else pa.array([], pa.large_binary())
        return starts, ends, pieces, np.searchsorted(starts, bounds)

    def _looked_up(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        return self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin (one more than texts)."""
        _, _, pieces, before = self._pieces(texts.fill_null(""))
        where = self._looked_up(pieces)
        return self._joined(where, before)

    def _joined(self, where: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, lengths = self.begins[where], np.diff(self.begins)[where]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(first - ends[:-1], lengths)
        at += np.arange(ends[-1])
        return self.flat[at], ends[before]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

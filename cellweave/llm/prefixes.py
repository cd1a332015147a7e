"""Exact token counts of every prefix of a text, by a dynamic programme.

A text's pieces (see tokens.py) are independent of what follows them, so the count of a prefix is the tokens of the
pieces before its last one, plus those of the part of the last piece that it holds. A short piece's prefixes are counted
once per distinct piece: those of Latin words, which are most, by the programme over all new words at once, others by the
library. A long piece (a text without blanks, a hash, an encoded file) is cut at its pre-tokens, and a long pre-token
takes the programme over its own prefixes: of all vocabulary entries that end a prefix, one alone stays whole beside the
last token of the prefix before it, and count[i] = count[i - its length] + 1.
"""

from __future__ import annotations

import json
import string
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa

from .tokens import BLANKS, PieceEncoder

#: Characters up to which all of a piece's prefixes are handed to the library.
SHORT = 48  # at most 60: a character has at most four tokens
#: Characters after a pre-token from which its end no longer depends on what follows (contractions, blanks before a word).
SETTLED = 3
#: Pieces and characters of pieces that a worker remembers; beyond either it starts anew. Bounds memory, never results.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 8 << 20
#: Prefixes handed to the library at once.
ENCODED_AT_ONCE = 10_000
#: Letters that normalise one by one. A piece of a blank or none, letters, and ASCII marks or none is plain: the prefixes of its word are counted by the programme.
LETTERS = [c for c in map(chr, range(256)) if c.isalpha()]
#: Short pieces that are sorted and counted together.
TOGETHER = 100_000
#: Slots (a power of two) in which a worker remembers what the library said of two tokens. Bounds memory, never results.
PAIR_BITS = 20
#: What a character may be to a plain piece: no part of it, a letter, a mark, a blank that has no token, a blank that goes with its word.
_OTHER, _LETTER, _MARK, _DROPPED, _KEPT = range(5)


class _Word:
    """The programme over one pre-token's symbols: the last token and the count of each prefix that goes on."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.tail, self.last, self.count = merges, "", [""], [0]

    def extend(self, symbols: str) -> None:
        for s in symbols:
            self.tail = (self.tail + s)[-self.merges.longest :]
            found = self.merges.last_token(self.tail, self.last, len(self.last), "")
            self.count.append(self.count[len(self.last) - len(found)] + 1)
            self.last.append(found)

    def ended(self, more: str = "") -> int:
        """Tokens of the symbols so far, and `more`, as a whole word."""
        if more:
            branch = _Word(self.merges)
            branch.tail, branch.last, branch.count = self.tail, self.last[:], self.count[:]
            branch.extend(more)
            return branch.ended()
        if not self.tail or not self.merges.suffix:
            return self.count[-1]
        end = len(self.last) - 1
        found = self.merges.last_token(self.tail, self.last, end, self.merges.suffix)
        return self.count[end - len(found) + len(self.merges.suffix)] + 1


class Merges:
    """The vocabulary's merges, asked for whether two tokens stay two where they meet."""

    def __init__(self, path: str, closed) -> None:
        """closed: the library's own model, whose words end; `open` has the same merges without ends of words."""
        from tokenizers import models

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocabulary = set(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.open = models.BPE(vocab=model["vocab"], merges=merges)
        self.closed = closed
        self.longest = max(map(len, self.vocabulary))
        self.known: dict[tuple[str, str], bool] = {}

    def stay(self, a: str, b: str) -> bool:
        """Whether a (none at a word's start) and then b is what the library gives for their symbols."""
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            got = self.known[a, b] = self.asked(a, b)
        return got

    def asked(self, a: str, b: str) -> bool:
        ends = bool(self.suffix) and b.endswith(self.suffix)
        model, tail = (self.closed, b[: -len(self.suffix)]) if ends else (self.open, b)
        return [t.value for t in model.tokenize(a + tail)] == ([a, b] if a else [b])

    def last_token(self, tail: str, last: list[str], end: int, suffix: str) -> str:
        """The last token of the first `end` symbols, of which tail are the last ones, from the last tokens of shorter prefixes; with suffix, of a word that ends there."""
        for n in range(len(tail), 0, -1):
            token = tail[-n:] + suffix
            if token in self.vocabulary and self.stay(last[end - n], token):
                return token
        raise ValueError("a symbol that the vocabulary lacks")


class _Words:
    """The programme over many short words at once: from each place on, the vocabulary's entries are followed in a tree of their symbols."""

    def __init__(self, merges: Merges, symbols: set[str]) -> None:
        """symbols: all that words consist of."""
        self.merges, end = merges, merges.suffix
        self.code = np.zeros(max(map(ord, symbols)) + 1, np.uint8)
        self.code[sorted(map(ord, symbols))] = np.arange(1, len(symbols) + 1)
        self.tokens = ["", *sorted(t for t in merges.vocabulary if symbols.issuperset(t.removesuffix(end)) and t != end)]
        self.width = len(symbols) + 1
        code, below, opened, closed = self.code.tolist(), {}, [(1, 0)], []  # node 1 is the root, 0 none
        for k, token in enumerate(self.tokens[1:], 1):
            node, body = 1, token.removesuffix(end)
            for c in body:
                node = below.setdefault(node * self.width + code[ord(c)], len(below) + 2)
            (closed if body != token else opened).append((node, k))
        self.below = np.zeros((len(below) + 2) * self.width, np.int32)
        self.below[list(below)] = list(below.values())
        self.opened, self.closed = np.zeros(len(below) + 2, np.int32), np.zeros(len(below) + 2, np.int32)
        for of, found in ((self.opened, opened), (self.closed, closed if end else opened)):
            for node, k in found:
                of[node] = k
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # twice a pair's number, and one if they stay

    def _stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a.astype(np.int64) * len(self.tokens) + b
        slot = lambda of: (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        got = self.pairs[slot(pairs)]
        new = np.flatnonzero(got >> 1 != pairs)
        if len(new):
            asked, which = np.unique(pairs[new], return_inverse=True)
            said = [self.merges.asked(self.tokens[k // len(self.tokens)], self.tokens[k % len(self.tokens)]) for k in asked.tolist()]
            said = asked * 2 + np.array(said, np.int64)
            self.pairs[slot(asked)] = said
            got[new] = said[which]
        return (got & 1).astype(bool)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word's first 0, 1, 2, ... symbols as whole words, a row a word, of no meaning beyond its end. In sorted words, what one shares with the one before isn't counted again."""
        symbols = np.array(words, np.str_)
        symbols = self.code[symbols.view(np.uint32).reshape(len(words), -1)]
        size = symbols.shape[1]
        lengths = (symbols > 0).sum(axis=1)
        shared = np.zeros(len(words), np.int64)
        shared[1:] = np.where((symbols[1:] == symbols[:-1]).all(axis=1), size, (symbols[1:] != symbols[:-1]).argmax(axis=1))
        last = np.full((size + 1, len(words)), -1, np.int32)  # the last token of each prefix that goes on, and tokens up to there
        last[0] = 0
        count, whole = np.zeros((size + 1, len(words)), np.uint8), np.zeros((size + 1, len(words)), np.uint8)
        symbols, places = np.ascontiguousarray(symbols.T), np.arange(len(words))
        for i in range(size):
            if i:
                self._copy(i, shared, places, last, count, whole)
            rows = np.flatnonzero((lengths > i) & (last[i] >= 0))
            nodes = np.ones(len(rows), np.int32)
            for j in range(i, size):
                nodes = self.below[nodes * self.width + symbols[j][rows]]
                rows, nodes = rows[nodes > 0], nodes[nodes > 0]
                if not len(rows):
                    break
                own = shared[rows] <= j
                token = self.opened[nodes]
                found = np.flatnonzero(own & (token > 0) & (last[j + 1][rows] < 0))
                found = found[self._stay(last[i][rows[found]], token[found])]
                last[j + 1, rows[found]] = token[found]
                count[j + 1, rows[found]] = count[i][rows[found]] + 1
                token = self.closed[nodes]
                found = np.flatnonzero(own & (token > 0) & (whole[j + 1][rows] == 0))
                found = found[self._stay(last[i][rows[found]], token[found])]
                whole[j + 1, rows[found]] = count[i][rows[found]] + 1
        self._copy(size, shared, places, last, count, whole)
        columns = np.arange(1, size + 1)[:, None]
        for j, k in np.argwhere((whole[1:] == 0) & (columns <= lengths)).tolist():  # a symbol that the vocabulary lacks
            whole[j + 1, k] = len(self.merges.closed.tokenize(words[k][: j + 1]))
        return whole.T

    @staticmethod
    def _copy(i: int, shared: np.ndarray, places: np.ndarray, *states: np.ndarray) -> None:
        """What is known of the first i symbols, from the word that had them first to those that share them."""
        source = np.maximum.accumulate(np.where(shared < i, places, 0))
        for state in states:
            state[i] = state[i][source]


def _joins_before(char: str) -> bool:
    """Whether normalisation may join a character to those before it."""
    return unicodedata.category(char)[0] == "M" or "\u1160" <= char <= "\u11ff"


class PrefixCounter:
    """One per Python worker and vocabulary."""

    _made: dict[str, PrefixCounter] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        self.pieces = PieceEncoder.of(path)
        self.tokenizer = self.pieces.tokenizer
        self.model, self.normal, self.split = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.path, self._merges, self._words = path, None, None
        self.symbols = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self._tables()
        self._forget()

    @classmethod
    def of(cls, path: str) -> PrefixCounter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # places of pieces; their counts lie in flat, from begins on
        self.flat, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @property
    def merges(self) -> Merges:
        if self._merges is None:
            self._merges = Merges(self.path, self.model)
        return self._merges

    def _counted(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(texts), ENCODED_AT_ONCE):
            out += [len(e) for e in self.tokenizer.encode_batch_fast(texts[at : at + ENCODED_AT_ONCE], add_special_tokens=False)]
        return out

    def _tables(self) -> None:
        """By code point up to 255 (256: any other): what it is to a plain piece, and the letter by which it is counted; the symbols of letters."""
        split = lambda text: [t for t, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text) if self.normal else text)]
        self.kinds, self.letter = np.zeros(257, np.uint8), np.zeros(257, np.uint8)
        mapped = {c: self._mapped(c) for c in LETTERS}
        like = {m: ord(c) for c, m in reversed(mapped.items())}
        for c, m in mapped.items():
            self.kinds[ord(c)], self.letter[ord(c)] = _LETTER, like[m]
        for c in set(string.punctuation) - set("'").union(*self.special):  # contractions and special strings may hold letters
            self.kinds[ord(c)] = _MARK if split(f"a{c}{c}") == split("a") + split(c + c) else _OTHER
        for c in BLANKS:
            self.kinds[ord(c)] = _DROPPED if split(c + "a") == split("a") and not split(c) else _OTHER
        self.symbols_of, self.n_symbols = {ord(c): m for c, m in mapped.items()}, np.zeros(257, np.uint8)
        kept = split(" a")
        if not self.kinds[32] and len(kept) == 1 and kept[0][1:] == mapped["a"]:
            self.kinds[32], self.letter[32], self.symbols_of[32] = _KEPT, 32, kept[0][0]
        self.n_symbols[list(self.symbols_of)] = list(map(len, self.symbols_of.values()))

    def _of_plain(self, texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts are plain, and the counts of their prefixes, all in a row: nought at a blank that has no token, those of the word, and those of the marks beyond the whole word's."""
        codes = np.array(texts, np.str_)
        codes = np.minimum(codes.view(np.uint32).reshape(len(texts), -1), 256)
        kinds, columns = self.kinds[codes], np.arange(codes.shape[1])
        word = kinds == _LETTER
        word[:, 0] |= kinds[:, 0] >= _DROPPED
        run = np.where(word.all(axis=1), codes.shape[1], word.argmin(axis=1))
        plain = (run > (kinds[:, 0] >= _DROPPED)) & ((kinds == _MARK).sum(axis=1) == lengths - run)
        codes, run, lengths, blank = codes[plain], run[plain], lengths[plain], kinds[plain, 0] == _DROPPED
        words = np.where(columns < run[:, None], self.letter[codes], np.uint8(0))
        words[blank, :-1], words[blank, -1] = words[blank, 1:], 0
        distinct, which = np.unique(words.view(f"S{len(columns)}").ravel(), return_inverse=True)
        counts = self._of_words(distinct)[which]
        counts[blank, 1:] = counts[blank, :-1]
        counts[blank, 0] = 0
        marked: dict[str, list[int]] = {}
        where = np.flatnonzero(plain)
        for k in np.flatnonzero(run < lengths).tolist():
            marked.setdefault(texts[where[k]][run[k] :], []).append(k)
        tails = list({m[:k] for m in marked for k in range(1, len(m) + 1)})
        tails = dict(zip(tails, self._counted(tails), strict=True))
        for m, rows in marked.items():
            end = run[rows][:, None]
            more = np.array([tails[m[:k]] for k in range(1, len(m) + 1)], np.uint8)
            counts[np.array(rows)[:, None], end + np.arange(len(m))] = counts[rows, run[rows] - 1][:, None] + more
        return plain, counts[columns < lengths[:, None]]

    def _of_words(self, words: np.ndarray) -> np.ndarray:
        """A row of counts for each of these words (sorted, so that a prefix shared with the one before isn't counted again), of no meaning beyond its end."""
        codes = words.view(np.uint8).reshape(len(words), words.dtype.itemsize)
        if not len(words):
            return codes
        if self._words is None:
            self._words = _Words(self.merges, set("".join(self.symbols_of.values())))
        counts = self._words.counts(b"\n".join(words.tolist()).decode("latin-1").translate(self.symbols_of).split("\n"))
        ends = np.minimum(np.cumsum(self.n_symbols[codes], axis=1, dtype=np.int32), counts.shape[1] - 1)
        return np.take_along_axis(counts, ends, axis=1)

    def _remember(self, pieces: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        short, order, flat = np.flatnonzero(lengths <= SHORT), [], [self.flat]
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            plain, counts = self._of_plain([texts[k] for k in part.tolist()], lengths[part])
            others = [texts[k] for k in part[~plain].tolist()]
            prefixes = list({t[:k] for t in others for k in range(1, len(t) + 1)})
            known = dict(zip(prefixes, self._counted(prefixes), strict=True))
            order += [part[plain], part[~plain]]
            flat += [counts.astype(np.int32), np.array([known[t[:k]] for t in others for k in range(1, len(t) + 1)], np.int32)]
        order.append(np.flatnonzero(lengths > SHORT))
        self.flat = np.concatenate([*flat, *[self.of_long(texts[k]).astype(np.int32) for k in order[-1].tolist()]])
        order = np.concatenate(order)
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(lengths[order])])
        at = len(self.known)
        self.known.update(zip([pieces[k] for k in order.tolist()], range(at, at + len(order)), strict=True))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is among the known ones; new ones are counted."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        find = lambda asked: np.fromiter(map(self.known.get, asked, repeat(-1)), np.int64, len(asked))
        places = find(distinct)
        new = np.flatnonzero(places < 0)
        if len(self.known) + len(new) > CACHE_ENTRIES or len(self.flat) > CACHE_CHARS:
            self._forget()
            places[:], new = -1, np.arange(len(distinct))
        if len(new):
            missing = [distinct[k] for k in new.tolist()]
            self._remember(missing)
            places[new] = find(missing)
        return places[coded.indices.to_numpy(zero_copy_only=False)]

    def table(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the first 1, 2, ... characters of each text, all in a row, and where each text's begin (one more than texts)."""
        _, _, pieces, before = self.pieces._pieces(texts.fill_null(""))
        where = self._places(pieces)
        lengths = np.diff(self.begins)[where]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat((self.begins[where] - ends[:-1]).astype(np.int32), lengths)  # a slice's characters and the cache's are far fewer than 2^31
        at += np.arange(ends[-1], dtype=np.int32)
        counts = self.flat[at]
        whole = self.flat[self.begins[where + 1] - 1] if len(where) else np.zeros(0, np.int32)
        running = np.concatenate([[0], np.cumsum(whole, dtype=np.int64)])
        base = running[:-1] - np.repeat(running[before[:-1]], np.diff(before))  # tokens of the pieces before, in the same text
        counts += np.repeat(base.astype(np.int32), lengths)
        return counts, ends[before]

    def of_long(self, piece: str) -> np.ndarray:
        """Counts of all prefixes of one piece, whatever its length."""
        n = len(piece)
        encoded = self.tokenizer.encode(piece, add_special_tokens=False)
        # where pre-tokens begin and end, with the tokens up to there; text between them (blanks that the vocabulary drops) has none
        bounds, words, offsets = {0: 0}, encoded.word_ids, encoded.offsets
        if len(words):
            bounds[offsets[0][0]] = 0
        for k in range(len(words)):
            if k and words[k] != words[k - 1] and offsets[k][0] >= offsets[k - 1][1]:  # one character may normalise to two pre-tokens
                bounds[offsets[k - 1][1]] = bounds[offsets[k][0]] = k
        if len(words):
            bounds[offsets[-1][1]] = len(words)
        places = [a for a in sorted(bounds) if a == 0 or (a < n and not _joins_before(piece[a]))]
        starts = np.array([k for k in range(n) if k == 0 or not _joins_before(piece[k])])
        settled = np.zeros(n + 1, np.int64)  # characters that others may join count as one with those
        settled[1:] = starts[np.maximum(np.searchsorted(starts, np.arange(n), side="right") - SETTLED, 0)]
        for s, e in self._special_spans(piece):  # a cut special string is text like any other and may go with what is before it
            settled[s + 1 : e] = np.minimum(settled[s + 1 : e], s - SETTLED)
        from_place = np.maximum(np.searchsorted(places, settled, side="right") - 1, 0)
        out = np.zeros(n + 1, np.int64)
        direct: list[tuple[int, int]] = []
        long: dict[int, list[int]] = {}
        for k in range(1, n + 1):
            a = places[from_place[k]]
            after = places[from_place[k] + 1] if from_place[k] + 1 < len(places) else n
            if k - a <= SHORT or k > after:
                direct.append((a, k))
            else:
                long.setdefault(a, []).append(k)
        for a, ks in long.items():
            self._within(piece, a, ks, bounds[a], out)
        for (a, k), c in zip(direct, self._counted([piece[a:k] for a, k in direct]), strict=True):
            out[k] = bounds[a] + c
        return out[1:]

    def _special_spans(self, piece: str) -> list[tuple[int, int]]:
        spans = []
        for word in self.special:
            at = piece.find(word)
            while at >= 0:
                spans.append((at, at + len(word)))
                at = piece.find(word, at + 1)
        return spans

    def _within(self, piece: str, a: int, ks: list[int], base: int, out: np.ndarray) -> None:
        """out[k] for ks up to the end of the one pre-token (or run of blanks) that begins at a."""
        if not ks:
            return
        normal = self.normal
        part = piece[a : ks[-1]]
        normalized = normal.normalize_str(part) if normal else part
        whole = self.split.pre_tokenize_str(normalized)
        if not whole:  # blanks that the vocabulary drops
            out[ks] = base
            return
        if whole[0][1] != (0, len(normalized)):
            for k, c in zip(ks, self._counted([piece[a:k] for k in ks]), strict=True):
                out[k] = base + c
            return
        wanted, word, start = set(ks), _Word(self.merges), 0
        for k in range(1, len(part) + 1):
            if k < len(part) and normal and _joins_before(part[k]):
                if a + k in wanted:
                    out[a + k] = base + word.ended(self._mapped(part[start:k]))
                continue
            word.extend(self._mapped(part[start:k]))
            start = k
            if a + k in wanted:
                out[a + k] = base + word.ended()

    def _mapped(self, text: str) -> str:
        normal = self.normal
        text = normal.normalize_str(text) if normal else text
        return self.symbols.pre_tokenize_str(text)[0][0] if text else ""

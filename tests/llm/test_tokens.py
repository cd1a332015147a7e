import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm import common, packing, prefixes, token_counts, token_store, tokens
from cellweave.llm import queries
from cellweave.llm.common import new_path

PATHS = [tokens.byte_bpe_path(), tokens.word_bpe_path()]
PARTS = [" ", "  ", "\n", "\t", "a", "the", "The", "é", "́", " ", " ", "　", "\x1c", "\x85", ",", ".", "!", "'", "'s", "'ll", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "日本", "😀", "€", "İ", "Σ", "-"]


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=8))
def test_pieces_are_exact(path, texts):
    encoder, library = tokens.PieceEncoder.of(path), Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat, at = encoder.ids(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want


def every_prefix(library, text):
    return [len(e.ids) for e in library.encode_batch_fast([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)]


JOINED = [*PARTS, "か", "\u3099", "\u1100", "\u1161", "\u11a8", "Ｘ", "本" * 20, "n" * 30, "---", "<|endoftext|>" * 2, "ß"]


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("short", [48, 4])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(JOINED), max_size=30).map("".join), min_size=1, max_size=5))
def test_every_prefix_is_exact(path, short, texts):
    """Against the library on each prefix, with all pieces long and with few."""
    counter, was = prefixes.PrefixCounter.of(path), prefixes.SHORT
    library, prefixes.SHORT = counter.tokenizer, short
    counter._forget()
    try:
        got, at = counter.table(pa.array([*texts, None, ""]))
    finally:
        prefixes.SHORT = was
        counter._forget()
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [every_prefix(library, t) for t in texts] + [[], []]


class Asked:
    """A part of the library, with the texts that it was given."""

    def __init__(self, part, texts):
        self._part, self._texts = part, texts

    def __getattr__(self, name):
        return getattr(self._part, name)

    def tokenize(self, text):
        self._texts.append(text)
        return self._part.tokenize(text)

    def encode_batch_fast(self, texts, **how):
        self._texts.extend(texts)
        return self._part.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("path", PATHS)
def test_new_words_are_counted_together(path, monkeypatch):
    """New words with their blanks and marks are right at every prefix, and the library isn't asked prefix by prefix."""
    rng = random.Random(4)
    parts = ["th", "on", "re", "Enn", "ß", "É", "ê", "UX", "ÿ", "µ", "ing", "ä", "ch", "Q", "s"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(6000)]
    texts = ["".join(rng.choice([" ", " ", "\n", "\t", "\r\n", "\x0c", ""]) + w + rng.choice(["", "", ".", ",", "&&&", ".)", "---", "'s", "1", "<", "\0", "\u0301"]) for w in words[k : k + 20]) for k in range(0, 2000, 20)]
    asked: list[str] = []
    counter, library = prefixes.PrefixCounter(path), Tokenizer.from_file(path)
    counter.model, counter.tokenizer = Asked(counter.model, asked), Asked(counter.tokenizer, asked)
    counter.merges.open = Asked(counter.merges.open, asked)
    plain = [" " + w for w in words]
    got, at = counter.table(pa.array(plain))
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [every_prefix(library, t) for t in plain]
    assert len(asked) * 4 < len({t[:k] for t in plain for k in range(2, len(t) + 1)})
    monkeypatch.setattr(prefixes, "TOGETHER", 500)
    monkeypatch.setattr(prefixes, "CACHE_ENTRIES", 1500)
    monkeypatch.setattr(prefixes, "PAIR_BITS", 4)  # pairs that take each other's slots
    counter = prefixes.PrefixCounter(path)
    for part in (texts[:50], texts[50:], texts[:50]):
        got, at = counter.table(pa.array(part))
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [every_prefix(library, t) for t in part]


UNSPACED = ["日本語の文章はスペースなしで続きます。" * 12, "x1" * 150, "n" * 300, "ab" * 200, "-" * 300, " " * 300, "\u3000" * 90 + "x", "don't" * 60, "ไทยไม่มีช่องว่าง" * 15, "か\u3099" * 120, "\u1112\u1161\u11ab" * 60, "İ" * 120, "é" * 130, "<|endoftext|>" * 20, "QmFzZTY0+/=" * 30, "😀" * 80]


@pytest.mark.parametrize("path", PATHS)
def test_every_prefix_of_long_pieces(path):
    library, counter = Tokenizer.from_file(path), prefixes.PrefixCounter(path)
    for text in UNSPACED:
        assert counter.of_long(text).tolist() == every_prefix(library, text), text[:20]


def test_windows_and_forgetting(monkeypatch):
    texts = ["Hello, big world　 x  y. " * 40, "", None, "été, déjà vu " * 30]
    monkeypatch.setattr(tokens, "WINDOW", 7)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    encoder, library = tokens.PieceEncoder(PATHS[0]), Tokenizer.from_file(PATHS[0])
    for _ in range(2):
        flat, at = encoder.ids(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_new_pieces_are_joined_for_the_library(monkeypatch):
    """2,000 new words reach it in a few dozen texts; where sizes don't tell them apart, one by one; ids are the same."""
    texts = [" ".join(f"w{k}é" for k in range(1000)), "".join(f" x{k},\n<|endoftext|> {k}\u3000{k} " for k in range(1000))]
    library, handed, own = Tokenizer.from_file(PATHS[0]), [], tokens.PieceEncoder._encode
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens.PieceEncoder, "_encode", lambda self, pieces: handed.append(len(pieces)) or own(self, pieces))
    encoder = tokens.PieceEncoder(PATHS[0])
    for _ in range(2):
        flat, at = encoder.ids(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    encoder.ids(pa.array(texts[:1]))
    few, joined = sum(handed), tokens.PieceEncoder(PATHS[0])
    handed.clear()
    joined.ids(pa.array(texts[:1]))
    assert sum(handed) < 50 and few < 2500
    joined._forget()
    joined.sizes = joined.sizes + 1
    flat, at = joined.ids(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want


def reference_ids(rows, end):
    library = Tokenizer.from_file(PATHS[0])
    return [library.encode(r[1] or "", add_special_tokens=False).ids + [end] for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(got, rows, capacity):
    want = sorted((str(r[0]), i, s, n, c) for r, ids in zip(rows, reference_ids(rows, 0)) for i, s, n, c in pieces_of(ids, capacity))
    assert sorted((str(g["doc_id"]), g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    filled = defaultdict(list)
    for g in got:
        filled[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(filled)


def pieces_of(ids, capacity):
    at = 0
    for i, n in enumerate(packing.cut_lengths(len(ids), capacity)):
        yield i, at, n, crc(ids[at : at + n])
        at += n


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, docs, rows, capacity):
    got = packing.pack(docs, capacity).collect()
    n = check_packing(got, rows, capacity)
    total = sum(g["length"] for g in got)
    assert -(-total // capacity) <= n <= 1.05 * total / capacity + 2


def test_packing_skewed_and_empty(spark, empty_docs, clashing, rows):
    assert packing.pack(empty_docs).count() == 0
    many = [(i, "one", None, None, None) for i in range(700)]
    assert check_packing(packing.pack(spark.createDataFrame(many, "doc_id long, text string, a int, b int, c int"), 8).collect(), many, 8) == len(many) // (8 // len(reference_ids(many[:1], 0)[0]))
    check_packing(packing.pack(clashing, 128).collect(), rows, 128)


def test_common_lengths_are_dealt(spark):
    """A length of 5,000 pieces over 500 windows of about ten, one of three pieces over one."""
    rows = [(i, 0, 0, 7, i) for i in range(5000)] + [(i, 0, 0, 3, i) for i in range(5000, 5003)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.assign_slots(pieces, 20, ranked_at_once=10).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(5003))
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(filled) == 2500 and all(sorted(v) == [(0, 7), (7, 7), (14, 3), (17, 3)][: len(v)] for v in filled.values())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), max_size=30))
def test_plan_equals_best_fit_by_document(histogram):
    capacity, placed = 50, defaultdict(list)
    for length, rank, n, first, per, offset in packing.plan_runs(histogram, capacity):
        for r in range(n):
            placed[first + r // per].append((offset + r % per * length, length, rank + r))
    rooms = []
    for length in sorted(histogram, reverse=True):  # best fit decreasing, one at a time
        for _ in range(histogram[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                rooms.append(capacity - length)
            else:
                rooms.remove(fit)
                rooms.append(fit - length)
    assert len(placed) == len(rooms)
    ranks = defaultdict(list)
    for places in placed.values():
        at = 0
        for offset, length, rank in sorted(places):
            assert offset == at
            at += length
            ranks[length].append(rank)
        assert at <= capacity
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}


def stored_table(spark, docs, **how):
    path = new_path(spark, "prefix-table")
    token_counts.write_prefix_table(docs, path, **how)
    return token_counts.read_prefix_table(spark, path)


def counted(rows, limit):
    library = Tokenizer.from_file(PATHS[1])
    return sorted((str(r[0]), len((r[1] or "").encode()), n, n > limit) for r in rows for n in [len(library.encode(r[1] or "", add_special_tokens=False).ids)])


def test_token_counts(spark, docs, rows, empty_docs, clashing):
    """Null, empty and long texts, null and repeated ids, clashing columns, an empty table."""
    from pyspark.sql import functions as F

    for frame in (docs, clashing.select("*", F.lit(1).alias("prefix_tokens"), F.lit(2).alias("n_bytes"))):
        got = token_counts.within(stored_table(spark, frame), 100).collect()
        assert sorted((str(g["doc_id"]), g["n_bytes"], g["n_tokens"], g["over_limit"]) for g in got) == counted(rows, 100)
    assert token_counts.within(stored_table(spark, empty_docs), 100).count() == 0
    was, token_counts.SLICE_BYTES = token_counts.SLICE_BYTES, 500  # many slices of a batch
    try:
        got = token_counts.within(stored_table(spark, docs), 100).collect()
    finally:
        token_counts.SLICE_BYTES = was
    assert sorted((str(g["doc_id"]), g["n_bytes"], g["n_tokens"], g["over_limit"]) for g in got) == counted(rows, 100)


@pytest.mark.parametrize("budget", [0, 1, 20, 300])
def test_truncation_from_the_table(spark, rows, budget):
    """The longest prefix within the budget among all prefixes, of texts with and without spaces."""
    library = Tokenizer.from_file(PATHS[1])
    some = list(enumerate([r[1] for r in rows if r[1] is None or len(r[1]) < 800] + UNSPACED + ["a <|endoftext|> b <|endoftext|>" * 5]))
    docs = spark.createDataFrame(some, "doc_id long, text string")
    table = stored_table(spark, docs)
    cut = {r["doc_id"]: r["text"] for r in token_counts.truncated(table, docs, budget).collect()}
    fits = {r["doc_id"]: (r["fit_chars"], r["fit_tokens"]) for r in token_counts.within(table, budget).collect()}
    for i, text in some:
        counts = [0, *every_prefix(library, text or "")]
        best = max(k for k, n in enumerate(counts) if n <= budget)
        assert cut[i] == (text or "")[:best] and fits[i] == (best, counts[best])
    for n in (0, 1, 17, 1 << 30):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.tokens_up_to(table, n).collect()}
        assert got == {i: len(library.encode((t or "")[:n], add_special_tokens=False).ids) for i, t in some}


@pytest.mark.parametrize("near", [1, 3, 64])
def test_last_entry_within_a_budget(spark, monkeypatch, near):
    """Counts that skip the budget, fall below it later, near or far, or stay at it: the few entries stepped over or all, the last one is found."""
    monkeypatch.setattr(token_counts, "NEAR", near)
    rng = random.Random(near)
    tables = [[], [0], [7], [5, 5, 5, 6], [4, 6], [6, 5, 6], [5, *[6] * 200, 5, 6], [*range(1, 300)], [*range(1, 300), 4, 9], [5] * 70 + [6], [6, 7], [5] + [6] * 62 + [3, 9], [5] + [6] * 63 + [3, 9]]
    for _ in range(150):
        tables.append([0])
        for _ in range(rng.randint(0, 150)):
            tables[-1].append(max(0, tables[-1][-1] + rng.choice([0, 0, 0, 1, 1, 2, -1, -3])))
    rows = [(i, len(t), t) for i, t in enumerate(tables)]
    stored = spark.createDataFrame(rows, token_counts.TABLE)
    for budget in (0, 5, 40):
        got = {r.doc_id: (r.n_tokens, r.over_limit, r.fit_chars, r.fit_tokens) for r in token_counts.within(stored, budget).collect()}
        for i, _, t in rows:
            n = t[-1] if t else 0
            best = max((k + 1 for k, x in enumerate(t) if x <= budget), default=0)
            assert got[i] == (n, n > budget, best, t[best - 1] if best else 0), (t, budget)


def test_unspaced_text_over_the_limit(spark):
    """81,000 bytes without an ASCII blank: the table has an entry for each character, and the cut is no empty text."""
    text = "日本語文章" * 5400
    docs = spark.createDataFrame([(1, text), (2, "x1" * 5000)], "doc_id long, text string")
    table = stored_table(spark, docs)
    library = Tokenizer.from_file(PATHS[1])
    for r in token_counts.truncated(table, docs, 2048).collect():
        whole = text if r["doc_id"] == 1 else "x1" * 5000
        count = lambda k: len(library.encode(whole[:k], add_special_tokens=False).ids)  # noqa: B023, E731
        assert whole.startswith(r["text"]) and count(len(r["text"])) <= 2048 < count(len(r["text"]) + 1)


def test_table_is_delta_coded(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = new_path(spark, "prefix-table")
    token_counts.write_prefix_table(docs, path)
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            column = next(c for c in map(meta.row_group(g).column, range(meta.num_columns)) if c.path_in_schema.startswith("prefix_tokens"))
            assert "DELTA_BINARY_PACKED" in column.encodings
            assert column.num_values < 1000 or column.total_compressed_size < column.num_values


def test_op4_and_op6_on_whole_tables(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op4_token_counts(spark, tiny).collect()
    assert sorted((str(g["doc_id"]), g["n_bytes"], g["n_tokens"], g["over_limit"]) for g in got) == counted(rows, 2048)
    stored, at = sorted(queries.op6_token_store(spark, tiny).collect(), key=lambda r: r["start"]), 0
    for g, r, ids in zip(stored, rows, reference_ids(rows, 2), strict=True):
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r[0], at, len(ids), crc(ids))
        at += len(ids)


def test_token_store(spark, docs, rows, empty_docs):
    path = new_path(spark, "store")
    token_store.write_token_store(docs, path)
    store = token_store.read_token_store(spark, path)
    ids = dict(zip([(r[0], r[1] or "") for r in rows], reference_ids(rows, 2)))
    got = token_store.digest(store).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for g in got:
        assert g["start"] == at
        at += g["n_tokens"]
    want = sorted(((r[0], len(v), crc(v)) for r in rows for v in [ids[(r[0], r[1] or "")]]), key=repr)
    assert sorted(((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got), key=repr) == want
    assert store.where("doc_id = 5").first()["ids"] == ids[next((r[0], r[1] or "") for r in rows if r[0] == 5)]
    empty = new_path(spark, "store")
    token_store.write_token_store(empty_docs, empty)
    assert token_store.digest(token_store.read_token_store(spark, empty)).count() == 0


def test_token_store_layout_and_selective_reads(spark, clashing):
    """Dictionary-coded ids, delta-coded numbers, page indexes, several row groups; one id with one text in many files; columns read alone."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    path = new_path(spark, "store")
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again").alias("text")).repartition(4)
    other = clashing.select("*", F.lit(1).alias("row"), F.lit(2).alias("file_no")).select("doc_id", "text")
    docs = same.unionByName(other)
    token_store.write_token_store(docs, path)
    store = token_store.read_token_store(spark, path)
    assert store.where("doc_id is null").select("file_no").distinct().count() > 1
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema.split(".")[0]: c for c in map(meta.row_group(g).column, range(meta.num_columns))}
            assert any("DICTIONARY" in e for e in columns["ids"].encodings)
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "file_start", "n_tokens"))
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    few = token_store.tokens_of(store, 3, 5)
    assert sorted({r["doc_id"] for r in few.collect()}) == [3, 4, 5]
    plan = few._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,3), LessThanOrEqual(doc_id,5)]" in plan
    assert "ids" not in token_store.lengths(store)._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]
    got = token_store.digest(store).orderBy("start").collect()
    assert [r["start"] for r in got] == list(np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1])


def test_pieces_met_again_are_kept(monkeypatch):
    """A cache that overflows in nearly every slice gives the library's ids."""
    rng = random.Random(8)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 60)
    encoder, library = tokens.PieceEncoder(PATHS[0]), Tokenizer.from_file(PATHS[0])
    for _ in range(60):
        texts = [" ".join(f"w{int(rng.expovariate(0.03))}" for _ in range(rng.randint(0, 20))) for _ in range(3)]
        flat, at = encoder.ids(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) <= 120


@pytest.mark.parametrize("ids", [[None] * 4000, [7] * 4000])
def test_slots_of_one_id(spark, monkeypatch, ids):
    """All pieces under one id, or none, are dealt as evenly as others, and each gets a slot of its own."""
    monkeypatch.setattr(packing, "SUMMED_AT_ONCE", 7)
    pieces = spark.createDataFrame([(i, 0, 0, 3 + k % 2, 0) for k, i in enumerate(ids)], packing.PIECES).repartition(4)
    out = packing.assign_slots(common.materialize(pieces, "one-id"), 20, ranked_at_once=50).collect()
    taken = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert len(taken) == 4000 and len(set(taken)) == 4000
    for (s, o, n), (s2, o2, _) in zip(taken, taken[1:], strict=False):
        assert (s2, o2) == (s, o + n) or (s2 > s and o2 == 0)


def test_truncate_row_by_row(spark):
    """Three rows in, three rows out, whatever their ids; equal to trying every prefix."""
    library = Tokenizer.from_file(PATHS[1])
    rows = [(None, "one two three four"), (5, "one two three four"), (5, "internationalization of things"), (None, None), (7, "日本語 text")]
    got = token_counts.truncate(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    best = lambda t: max((t[:k] for k in range(len(t) + 1) if count(t[:k]) <= 2), key=len)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, best(t or "")) for i, t in rows), key=str)


def test_token_store_with_clashing_columns(spark, docs, rows):
    """Extra columns under the operator's own names are there when it writes."""
    from pyspark.sql import functions as F

    extra = docs.select("*", *[F.lit(9).alias(c) for c in ("row", "h", "file_no", "file_start", "n_tokens", "ids")])
    path = new_path(spark, "store")
    token_store.write_token_store(extra, path)
    ids = sorted(((r.doc_id, list(r.ids)) for r in token_store.read_token_store(spark, path).collect()), key=str)
    assert ids == sorted(((r[0], i) for r, i in zip(rows, reference_ids(rows, 2), strict=True)), key=str)

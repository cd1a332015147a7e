import hashlib
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import alignment, queries
from cellweave.llm.tokens import byte_bpe_path

from .conftest import SCHEMA


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_bpe_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.piece_bpe_path())


def spelt(libraries, text):
    """(id, bytes) of both sides by the libraries themselves."""
    a, b = libraries
    one = a.encode(" " + text, add_special_tokens=False)
    byte_of = alignment._byte_level()
    left = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    return left, right


def groups_of(libraries, text):
    if not text:
        return [], [], []
    left, right = spelt(libraries, text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], [], []
    out, i, j, at_a, at_b, ga, gb, links = [], 0, 0, 0, 0, [], [], []
    while i < len(left) or j < len(right):
        if at_a <= at_b:
            ga.append(left[i][0])
            at_a += len(left[i][1])
            i += 1
        else:
            gb.append(right[j][0])
            at_b += len(right[j][1])
            j += 1
        if at_a == at_b:
            links.append((ga[-1], gb[-1]))
            out.append((ga, gb))
            ga, gb = [], []
    return out, links, [(x, y) for x, y in ((left, right),)]


def brute(libraries, rows):
    found = [(r[0], *groups_of(libraries, r[1])[:2]) for r in rows]
    counts = Counter(p for _, _, links in found for p in links)
    best = Counter()
    for (a, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "the", " the", ",", ".", "'s", "é", "ü", "日本", "▁", "　", "\x00", "\r\n", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "🙂", "á", "\xa0", "123", "x" * 30, "﻿", "ﬁ", "Å", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_sides_equal_the_libraries(libraries):
    texts = [t for t in odd_texts(1, 4000) if t]
    spaced = pa.array([" " + t for t in texts], pa.large_string())
    for side, k in ((alignment.ByteLevelSide(byte_bpe_path()), 0), (alignment.SentencePieceSide(alignment.piece_bpe_path()), 1)):
        flat, at, ok = side.encoded(spaced)
        for t, a, b, good in zip(texts, at[:-1], at[1:], ok, strict=True):
            tokens = spelt(libraries, t)[k]
            fits = b"".join(x for _, x in tokens) == (" " + t).encode()
            assert good == fits, t
            assert not fits or flat[a:b].tolist() == [i for i, _ in tokens], t


def test_misspelt_pieces_of_equal_length():
    for side in (alignment.ByteLevelSide(byte_bpe_path()), alignment.SentencePieceSide(alignment.piece_bpe_path())):
        pieces = [b" the", " 日本µ".encode(), b" of", b" ,", b" a"]
        flat, n = side._encode_flat(pieces)
        begins = np.append(0, np.cumsum(n))
        assert not side._misspelt(flat, begins, pieces).any()
        assert side._misspelt(flat, begins, [b" thE", " 日本μ".encode(), b" of", b" , ", b""]).tolist() == [True, True, False, True, True]
        assert side._misspelt(flat[:0], begins[:1], []).tolist() == []


def test_memory_of_a_slice(monkeypatch):
    """A slice of many documents is encoded at once, not aligned at once: some 100 bytes for each of its text's would be needed."""
    rng, words = random.Random(4), ["the", "of", "alignment,", "tokens", "Ünder", "by", "x1"]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(300)]
    batch = pa.record_batch([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = alignment.link_table(SimpleNamespace(mapInArrow=lambda f, kinds: f), byte_bpe_path(), alignment.piece_bpe_path())
    list(run(iter([batch.slice(0, 1)])))  # the vocabularies are read
    tracemalloc.start()
    assert sum(map(len, run(iter([batch])))) == 301
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(map(len, texts)), peak


def test_equals_brute_force(libraries, spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(odd_texts(2, 300))]
    rows += [(900, None, "en", "s", 1), (None, "a b", None, None, None), (None, "a b", None, None, None), (3, "again three", "en", "s", 1)]
    assert got(alignment.alignment_digest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(libraries, rows)


def test_shared_fixture_in_small_slices(libraries, rows, clashing, monkeypatch):
    extra = clashing.select("*", *[F.lit(7).alias(c) for c in ("slice", "pair", "pairs", "counts", "links", "place", "best")])
    assert got(alignment.alignment_digest(extra)) == brute(libraries, rows)


def test_no_documents(empty_docs):
    assert got(alignment.alignment_digest(empty_docs)) == []
    assert alignment.align(empty_docs).count() == 0


def test_overlaps_are_all_pairs_that_share_bytes(libraries, spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(odd_texts(3, 150))]
    done = {r.doc_id: r for r in alignment.align(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, text, *_ in rows:
        r = done[doc_id]
        groups, _, both = groups_of(libraries, text)
        if not groups:
            assert not r.ids_a and not r.ids_b and not r.overlaps and not r.groups
            continue
        spans = []
        for side in both[0]:
            at, out = 0, []
            for _, x in side:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        shared = [(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b]
        assert sorted((o.a, o.b) for o in r.overlaps) == shared
        assert [(g.a, g.b) for g in r.groups] == [(i, j) for i, j in shared if spans[0][i][1] == spans[1][j][1]]
        assert r.ids_a == [i for i, _ in both[0][0]] and r.ids_b == [i for i, _ in both[0][1]]


def test_long_text(libraries, spark):
    rows = [(1, "a long text, " * 800_000, "en", "s", 1), (2, "short", "en", "s", 1)]
    out = got(alignment.alignment_digest(spark.createDataFrame(rows, SCHEMA)))
    short = brute(libraries, [(1, "a long text, " * 3, "en", "s", 1)])[0]
    assert out[0][1] / 800_000 == pytest.approx(short[1] / 3, rel=0.2) and out[0][3] > 2_000_000 and len(out) == 2


def test_query_on_the_whole_table(libraries, spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert got(queries.op13_token_alignment(spark, tiny)) == brute(libraries, rows)

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import exact_dedup, simhash
from cellweave.llm.components import connected_components


def reference_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    least = -(1 << 63)
    out = []
    for text, ids in groups.items():
        keep = max((i if i is not None else least for i in ids))
        keep = None if keep == least else keep
        kept = False
        for i in sorted(ids, key=lambda i: i if i is not None else least):
            now = i == keep and not kept
            kept |= now
            out.append((i, keep, len(ids), now, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def reported(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 16])
def test_exact(docs, rows, block):
    assert reported(exact_dedup.exact_duplicates(docs, block_bytes=block)) == reference_exact(rows)


def test_exact_with_colliding_hashes(spark):
    """All blocks share a handful of hashes: names have to come from the content."""
    texts = ["abcd" * 5, "abcd" * 5, "abce" * 5, "xyz", "xyz", "xy", "", None, "abcd" * 4 + "abcx", "q" * 100, "q" * 99 + "r", "q" * 100]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_duplicates(docs, block_bytes=4, hashed=F.pmod(F.xxhash64("block"), F.lit(2)))
    assert reported(found) == reference_exact(rows)


def test_exact_drop(docs, rows, clashing, empty_docs):
    want = sorted({(r[1], r[2]) for r in reference_exact(rows) if r[3]} and [(k, s) for k, _, _, kept, s in reference_exact(rows) if kept], key=repr)
    for frame in (docs, clashing):
        got = exact_dedup.drop_exact_duplicates(frame)
        assert got.columns == frame.columns
        assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()), key=repr) == want
    assert exact_dedup.drop_exact_duplicates(empty_docs).count() == 0 == exact_dedup.exact_duplicates(empty_docs).count()


def reference_fp(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reference_parts(rows, distance=4):
    """A number for each row, shared by rows that links lead to."""
    fps = [reference_fp(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def reference_near(rows, distance=4):
    parts, groups = reference_parts(rows, distance), defaultdict(list)
    for part, r in zip(parts, rows):
        groups[part].append(r[0])
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((r[0], f"{reference_fp(r[1]):016x}", name[part]) for part, r in zip(parts, rows)), key=repr)


def test_near(docs, rows, clashing, empty_docs):
    want = reference_near(rows)
    for frame in (docs, clashing):
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()), key=repr) == want
    assert simhash.near_duplicates(empty_docs).count() == 0
    for frame in (docs, clashing):
        kept = simhash.drop_near_duplicates(frame)
        assert kept.columns == frame.columns
        assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr) == one_of_each(rows)
    assert simhash.drop_near_duplicates(empty_docs).count() == 0


def one_of_each(rows):
    """Of each component the row with the least id, nulls last, then the least SHA-256; its repeats are it."""
    groups = defaultdict(list)
    for (i, t), part in zip([(r[0], r[1] or "") for r in rows], reference_parts(rows)):
        groups[part].append((i is None, i or 0, hashlib.sha256(t.encode()).hexdigest(), i, t))
    return sorted(((g[3], g[4]) for members in groups.values() for g in members if g[:3] == min(members)[:3]), key=repr)


def test_near_drop_tells_texts_of_one_id_apart(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(1, text), (5, text + " more"), (5, "something else entirely that has nothing to do with it"), (None, text), (7, "lonely")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[2], rows[4]])


def test_hot_keys_are_dealt_by_blocks(spark):
    """2,000 fingerprints under one key, in blocks of 100: the same components as brute force, and no group of more than two blocks."""
    import numpy as np

    rng = np.random.default_rng(5)
    high = rng.integers(0, 1 << 38, 1200, dtype=np.uint64) << np.uint64(26)  # the first two segments are zero
    near = np.concatenate([high[:200] ^ (np.uint64(1) << rng.integers(26, 64, 200, dtype=np.uint64)) for _ in range(4)])
    fps = np.unique(np.concatenate([high, near]))
    got = simhash.link_forest(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), together=100)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) < 20 * len(fps)
    listed = [int(f) for f in fps]
    want = [(a, listed[k]) for i, a in enumerate(listed) for k in np.flatnonzero(np.bitwise_count(fps[:i] ^ np.uint64(a)) <= 4)]
    assert components_of(listed, links) == components_of(listed, want)


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return {frozenset(g) for g in groups.values()}


def test_hash_equals_spark(spark):
    for text in ("", "a", "some words here", "é" * 40):
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("pairwise", [32, 2])
def test_links_span_all_components(spark, monkeypatch, pairwise):
    """Random balls of fingerprints, dense enough for large keys; both ways of linking within a key."""
    import random

    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng, fps = random.Random(3), {0}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randint(0, 63)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    import numpy as np

    keyed = sorted((r["key"], r["fp"], r["probe"]) for r in simhash._keys(spark.createDataFrame([(s,) for s in signed], "fp long"), 4).collect())
    key, fp, probe = (np.array(c) for c in zip(*keyed))
    a, b = simhash.links_of_run(key.astype(np.int64), fp.astype(np.int64).view(np.uint64), probe.astype(np.int64), 4)
    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 4
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = {f: f for f in fps}

    def find_want(x):
        while want[x] != x:
            x = want[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[find(x)] = find(y)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                want[find_want(x)] = find_want(y)
    label = lambda find: {frozenset(f for f in fps if find(f) == r) for r in {find(f) for f in fps}}
    assert label(find) == label(find_want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100), (7, 3), (201, 200), (200, 202), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellweave.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, family=20):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t)] for c, t in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def turn_rows(seed=1):
    rng = random.Random(seed)
    said = ["hello there", "one common first turn", "", " ", "a b\tc\nd", "ünï cödé x", "<|im_end|>"]
    rows = []
    for c in [*range(-45, 90), 1000, 1019, 5000, 10**12, 10**12 + 7]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice([*said, None])))
    rows += [(20, k, "user", f"turn {k} of a long one " * 3) for k in range(300)] + [(21, k, "user", f"turn {k} of a long one " * 3) for k in range(200)]
    rows += [(c, 0, "user", "ends where many end") for c in range(300, 420)] + [(None, 0, "user", "no conversation"), (None, None, None, None)]
    rows += rows[5:9]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    rows = turn_rows()
    return rows, spark.createDataFrame(rows, TURNS).repartition(4)


def test_equals_brute_force(turns):
    rows, df = turns
    assert got(prefix_trie.trie(prefix_trie.rebuild(df))) == brute(rows)


def test_small_strings_and_ranges(turns, monkeypatch):
    rows, df = turns
    monkeypatch.setattr(prefix_trie, "ARCS_AT_ONCE", 40)  # some sixty ranges, and so many links between them
    assert got(prefix_trie.trie(prefix_trie.rebuild(df))) == brute(rows)


def test_tour_nests(turns):
    """Places are a numbering of all arcs, and a child's lie within its parent's."""
    _, df = turns
    nodes = {(r.conv_id, r.depth): r for r in prefix_trie.trie(prefix_trie.rebuild(df)).collect()}
    assert sorted(p for r in nodes.values() for p in (r.enter, r.leave)) == list(range(2 * len(nodes)))
    for r in nodes.values():
        if r.depth:
            above = nodes[r.parent_conv_id, r.depth - 1]
            assert above.enter < r.enter < r.leave < above.leave


def test_clashing_columns(turns):
    rows, df = turns
    extra = df.select("*", *[F.lit(3).alias(c) for c in ("i", "part", "node", "depth", "parent", "words", "ends", "base", "side", "n")])
    assert got(prefix_trie.trie(prefix_trie.rebuild(extra))) == brute(rows)


def test_no_turns(spark):
    assert got(prefix_trie.trie(prefix_trie.rebuild(spark.createDataFrame([], TURNS)))) == []


def test_conversations_without_turns_are_at_the_root(spark):
    rows = [(c, 0, "user", "hi") for c in range(1, 20)] + [(7, 1, None, None)]
    assert got(prefix_trie.trie(prefix_trie.rebuild(spark.createDataFrame(rows, TURNS)))) == brute(rows)
    assert any(zlib.crc32(str(c).encode()) % 4 for c in range(1, 20))


def test_long_text(spark):
    text = "word " * 2_000_000
    rows = [(0, 0, "user", text), (1, 0, "user", text), (2, 0, "user", text + "x"), (2, 1, "assistant", "y")]
    assert got(prefix_trie.trie(prefix_trie.rebuild(spark.createDataFrame(rows, TURNS)))) == brute(rows)

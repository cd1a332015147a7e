import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import line_dedup

from .conftest import SCHEMA

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=20, docs=3):
    keys = [[x.strip(BLANK).translate(LOWER) for x in (r[1] or "").split("\n")] for r in rows]
    holders = defaultdict(list)
    order = lambda i: (i is not None, i or 0)
    for r, ks in zip(rows, keys, strict=True):
        for k in set(ks):
            if len(k) >= chars:
                holders[k].append(order(r[0]))
    last = {k: max(h) for k, h in holders.items() if len(h) >= docs}
    out = []
    for r, ks in zip(rows, keys, strict=True):
        lines = (r[1] or "").split("\n")
        left = [x for x, k in zip(lines, ks, strict=True) if k not in last or order(r[0]) == last[k]]
        out.append((r[0], len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def lines_rows():
    common = ["A line that many documents share, of one kind", "  a LINE that many documents share, of one kind\t", "Élan à la carte — vingt signes ici", "日本語の二十文字以上の行がここにあります。はいそうです", "short line", "exactly twenty chars"]
    rows = [(i, "\n".join(common[(i + j) % 6] for j in range(i % 5)) + f"\nown line of document number {i}\n", "en", "s", 1) for i in range(40)]
    rows += [(100, None, "en", "s", 1), (101, "", "en", "s", 1), (102, "\n", "en", "s", 1), (None, common[0], "en", "s", 1), (None, common[0], "en", "s", 1), (None, "only without an id is this line held", None, None, None)] + 3 * [(None, "only without an id is this line held", None, None, None)]
    rows += [(39, common[0] + "\n" + common[0], "en", "s", 1), (39, common[0], "en", "s", 1)]
    rows += [(200 + i, "two documents only hold this line" + "\n" * (i % 2), "en", "s", 1) for i in range(2)]
    rows += [(300 + i, "exactly nineteen ch\nexactly twenty char!", "en", "s", 1) for i in range(3)]
    rows += [(400 + i, ("x" * 1000 + f" {i % 3}\n") * 3000, "en", "s", 1) for i in range(9)]
    return rows


@pytest.fixture(scope="module")
def lines(spark):
    rows = lines_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_equals_brute_force(lines):
    rows, df = lines
    assert got(line_dedup.without_repeats(df)) == brute(rows)


def test_shared_fixture(rows, docs):
    assert got(line_dedup.without_repeats(docs)) == brute(rows)


def test_texts_are_those_hashed(lines):
    _, df = lines
    for r in line_dedup.without_repeats(df).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_columns_that_clash(docs, clashing, rows):
    extra = clashing.select("*", *[F.lit(1).alias(c) for c in ("ref", "hashes", "key", "last", "slot", "lost")])
    assert got(line_dedup.without_repeats(extra)) == brute(rows)


def test_no_documents(empty_docs):
    assert got(line_dedup.without_repeats(empty_docs)) == []


def test_no_line_is_long_enough(spark):
    rows = [(i, "short\nlines", "en", "s", 1) for i in range(5)]
    assert got(line_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_other_limits(lines):
    rows, df = lines
    assert got(line_dedup.without_repeats(df, least_chars=5, least_docs=2)) == brute(rows, 5, 2)


def test_filters_miss_no_repeat(spark):
    """All hashes that are in two rows or more have their bits in twice, whatever task and slice they come from; once holds all."""
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), 1 << 63, 3000)
    rows = [(int(x),) for x in np.concatenate([h, h[:500], np.full(2000, h[0])])]
    each = spark.createDataFrame(rows, "h long").repartition(7)
    slots = 300
    table = {r.slot: (np.uint64(r.once & (1 << 64) - 1), np.uint64(r.twice & (1 << 64) - 1)) for r in line_dedup.filters(each, slots).collect()}
    masks = line_dedup._mask(h)
    in_slot = [int((int(x) & (1 << 64) - 1) >> 6 * line_dedup.BITS) % slots for x in h]
    hits = [bool(table[s][1] & m == m) for s, m in zip(in_slot, masks, strict=True)]
    assert all(table[s][0] & m == m for s, m in zip(in_slot, masks, strict=True))
    assert all(hits[:500])
    assert sum(hits[500:]) < 2500 * 0.75  # ten hashes a slot here; most tables have four


def test_suspects_are_few(spark):
    """With the sizes of production, hardly any line that stands once is suspected."""
    rng = np.random.default_rng(4)
    rows = [(int(i), [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 20)]) for i in range(2000)]
    hashed = spark.createDataFrame(rows, "ref long, hashes array<long>")
    assert line_dedup.suspects(hashed).count() < 2000 * 20 * 0.02

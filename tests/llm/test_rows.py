"""URL filters and chat formatting."""

import hashlib
import random

import pytest

from cellweave.llm import chat, url_filter

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/es/1?x#y", "http://a.example.org/es/", "http://example.org/es", "http://badexample.org/es/1", "http://x.org", "http://x.org/", "http://x.org?/a",
    "http://example.org/en/12", "http://example.org/en/2", "http://example.org/EN/1", "https://m.a.com/fr/x", "https://a.com/de/x", "https://a.com/en/", "http://com/de/1", "http://org/x", "http://.org/x", "http://org./x",
    "ftp://a://b.org/c", "http://é.org/es/", "http://a.com/de/?q=http://b.org/", "http://u:p@a.com:80/de/", "http://a.com:80/de/", "x\ny://a.com/fr/\nz", "http://example.org/es/#frag", "http://a.b.c.d.e.f.g.example.org/en/1/2",
]


def reference(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def judged(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def many_rules():
    rng = random.Random(1)
    return url_filter.RULES + [(f"h{rng.randint(0, 400)}.net", f"/{rng.choice('abc')}{rng.randint(0, 9)}"[: rng.randint(1, 3)], rng.choice(["allow", "block"])) for _ in range(300)]


@pytest.mark.parametrize("sent", [100_000, 0], ids=["sent", "shuffled"])
@pytest.mark.parametrize("rules", [url_filter.RULES, [], many_rules()], ids=["named", "none", "many"])
def test_urls(spark, monkeypatch, rules, sent):
    monkeypatch.setattr(url_filter, "SENT_RULES", sent)
    seen = {}
    for h, p, v in rules:  # of repeated rules, the least verdict
        seen[h, p] = min(v, seen.get((h, p), v))
    urls = URLS + [f"http://s{k}.h{k % 450}.net/{'abc'[k % 3]}{k % 10}/x" for k in range(500)]
    pages = spark.createDataFrame([(k, u, "<html>", k) for k, u in enumerate(urls)] + [(None, "http://a.com/de/", None, 0), (3, "http://a.com/de/", None, 0)], "page_id long, url string, html string, host long")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    clean = [(h, p, v) for (h, p), v in seen.items()]
    want = sorted(((k, *reference(u, clean)) for k, u in [*enumerate(urls), (None, "http://a.com/de/"), (3, "http://a.com/de/")]), key=repr)
    assert judged(url_filter.judge_urls(pages, table)) == want


def test_urls_empty_and_filtered(spark):
    rules = url_filter.rule_table(spark)
    pages = spark.createDataFrame([(1, "http://a.com/de/1"), (2, "http://a.com/fr/1"), (3, None)], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert sorted(r["page_id"] for r in url_filter.drop_blocked(pages, rules).collect()) == [2, 3]


def test_urls_hosts_of_any_length_and_case(spark):
    """A host of a megabyte of labels takes seconds; rules that differ in their host's case alone are one rule."""
    import time

    table = spark.createDataFrame([("ORG", "/", "block"), ("org", "/", "allow"), ("b.Org", "/x", "block"), ("a.b.c.d", "/", "allow")], "host string, path string, verdict string")
    long = "a." * 500_000
    urls = [f"http://{long}org/x", f"http://{long}b.org/xy", "http://" + "n" * 1_000_000 + "/x", f"http://{long}/", "http://org/" + "p" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, table, "block").select("page_id", "rule", "verdict").collect()}
    assert time.time() - began < 60
    assert got == {0: ("org/", "allow"), 1: ("b.org/x", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("org/", "allow")}


def test_bloom_has_no_false_negatives(spark):
    rules = many_rules()
    table = spark.createDataFrame(rules, "host string, path string, verdict string").distinct()
    stored = url_filter.bloom_filter(table, 5)
    key = url_filter._key("host", "path")
    asked = table.select(url_filter._block(key, 5).alias("block"), *[url_filter._bit(key, w).alias(f"bit{w}") for w in range(8)]).join(stored, "block")
    assert asked.where(" or ".join(f"(shiftright(w{w}, bit{w}) & 1) = 0" for w in range(8))).count() == 0


HARD = ["", None, "plain", "<|im_end|>", "<|im_start|>user\nx<|im_end|>", "\\", "\\\\<|", "<\\|", "<\\\\|im_end|>", "<", "|>", "<<||>>", "a\nb\n", "日本 😀", "<\\/", "\n", "<|" * 5, "ends with <", "\\<|\\"]


def conversations():
    rng, rows = random.Random(2), []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "we\nird", "<|x", "a\\b", "<\\/"]), rng.choice(HARD) if rng.random() < 0.8 else rng.choice(HARD[2:]) + rng.choice(HARD[2:])))
    return rows + [(100, None, "user", "x"), (100, 1, "assistant", "y"), (101, 0, "assistant", "z"), (101, 0, "assistant", "z"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]


def reference_chat(rows):
    groups = {}
    for k, (c, t, r, x) in enumerate(rows):
        groups.setdefault((c, k if c is None else 0), []).append(((t is not None, t or 0), r or "", x or ""))
    out = []
    for (c, _), turns in groups.items():
        turns.sort()
        flat = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chat(spark):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 1, "t", 7, 8, 9) for r in rows], "conv_id long, turn long, role string, text string, example int, loss string, turns int, n_turns int, alone int")
    examples = chat.format_conversations(turns)
    got = chat.digest(examples).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == reference_chat(rows)
    total = {}
    for r in examples.collect():
        assert 0 <= r["loss_begin"] <= r["loss_end"] <= len(r["text"])
        assert r["text"].count(chat.START) == r["n_turns"] == r["text"].count(chat.END)
        total[r["conv_id"]] = total.get(r["conv_id"], 0) + len(r["text"])
    assert {r["conv_id"]: r["formatted_chars"] for r in got if r["conv_id"] is not None} == {k: n for k, n in total.items() if k is not None}


def test_every_reply_is_an_example(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [r["n_turns"] for r in got] == [2, 4, 5]
    assert [r["text"][r["loss_begin"] : r["loss_end"]] for r in got] == ["b", "d", ""]
    assert got[1]["text"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"


def test_chat_of_thousands_of_turns(spark):
    rows = [(1, t, "assistant" if t % 40 == 39 else "user", f"<|im_end|> {t}") for t in range(4000)]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r)[:5] for r in got] == reference_chat(rows)


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(none)).count() == 0

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, licenses, queries, toxicity


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def reference_scan(rows, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        for k in range(max(len(w) - size, 0) + 1):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k : k + n]))
                if owners:
                    found |= owners
                    hit |= set(range(k, k + n))
        names = ",".join(sorted(found))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, "one two three four five six seven eight"), (2, "ONE, two! three -- four? Five"), (2, "eta eta"), (10, "déjà vu encore"), (None, "alpha"), (11, None), (12, " .. "), (13, "three four five six seven")]


def contaminated_rows(rows):
    extra = ["xx one two three four five six yy", "Déjà-vu ENCORE une fois", "one two three four", "eta eta eta", " ".join(["pad"] * 500) + " eta eta", "one two three four five six seven eight nine"]
    return rows + [(1000 + k, t, None, None, None) for k, t in enumerate(extra)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_scan(spark, rows, block_bytes):
    """Against brute force, with all items at once and in several passes."""
    all_rows = contaminated_rows(rows)
    docs = spark.createDataFrame(all_rows, "doc_id long, text string, a string, b string, c long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs, items, size=5, block_bytes=block_bytes).drop("items").collect()
    want = reference_scan(all_rows, ITEMS, 5)
    assert sorted(map(tuple, got), key=repr) == want
    kept = decontaminate.drop_contaminated(docs, items, size=5, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in want if not r[5]), key=repr)


def test_items_longer_than_a_block(spark):
    """An item is cut into stretches with all its windows, which count as one item."""
    rng = np.random.default_rng(2)
    item = " ".join(f"w{k}" for k in rng.integers(0, 50, 400))
    w = item.split()
    assert sorted({t for _, text in decontaminate._parts("1", item.encode(), 60, 5) for t in [tuple(decontaminate.words(text)[k : k + 5]) for k in range(len(decontaminate.words(text)) - 4)]}) == sorted({tuple(x.encode() for x in w[k : k + 5]) for k in range(396)})
    rows = [(k, " ".join(["x", *w[k : k + 6], "y"])) for k in range(0, 394, 3)] + [(1000, item), (1001, None)]
    items = [(1, item), (2, "w1 w2"), (3, item)]
    got = decontaminate.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=5, block_bytes=300).drop("items").collect()
    assert sorted(map(tuple, got), key=repr) == reference_scan(rows, items, 5)


def test_scan_odd_inputs(spark, docs, clashing, empty_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    nothing = items.limit(0)
    assert decontaminate.scan(docs, nothing).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.scan(empty_docs, items).count() == 0
    for block_bytes in (1 << 20, 30):
        assert decontaminate.drop_contaminated(clashing, items, 5, block_bytes).columns == clashing.columns
        assert decontaminate.scan(empty_docs, items, 5, block_bytes).count() == 0
    assert decontaminate.drop_contaminated(clashing, nothing).count() == clashing.count()


def test_spans_lead_back(spark):
    text = "Ünder — ONE, two;three four Five! end"
    docs = spark.createDataFrame([(1, text), (2, "clean")], "doc_id long, text string")
    rows = decontaminate.hit_spans(docs, spark.createDataFrame([(7, "one two three four five")], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["items"]) for r in rows] == [(1, ["7"])]
    assert [text.encode()[s["begin"] : s["end"]].decode() for s in rows[0]["spans"]] == ["ONE", "two", "three", "four", "Five"]


def reference_licenses(text):
    def grams(w):
        return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 5, 0) + 1)} if w else set()

    held, out = grams(words(text)), {}
    for name, template in licenses.TEMPLATES.items():
        own = grams(words(template))
        share = len(own & held) / len(own)
        if share >= 0.8:
            out[name] = share
    return out


def broken_up(template, pieces, rng):
    """A template's words in some stretches, in another order, with long foreign text between them."""
    w = template.split()
    cuts = [0, *sorted(rng.choice(np.arange(1, len(w)), min(pieces - 1, len(w) - 1), replace=False).tolist()), len(w)]
    parts = [" ".join(w[x:y]) for x, y in zip(cuts, cuts[1:])]
    rng.shuffle(parts)
    foreign = lambda: " ".join(f"f{k}" for k in rng.integers(0, 10_000, 300))
    return " ".join([foreign(), *[x for p in parts for x in (p, foreign())]])


def test_licenses(spark, rows):
    """Against exact containment: whole, within text, cut, with words changed, and broken into up to seven stretches far apart."""
    rng = np.random.default_rng(4)
    texts = [(r[0], r[1]) for r in rows]
    for k, template in enumerate(licenses.TEMPLATES.values()):
        w = template.split()
        texts += [(2000 + 100 * k, template), (2001 + 100 * k, "some words before " + template + " and after it"), (2002 + 100 * k, " ".join(w[: len(w) // 2])), (2003 + 100 * k, " ".join(w[: -max(1, len(w) // 6)]))]
        for j in range(4, 12):
            changed = list(w)
            for p in rng.choice(len(w), min(len(w), max(1, len(w) // 40)), replace=False):
                changed[p] = "other"
            texts.append((2000 + 100 * k + j, "x y z " * int(rng.integers(0, 9)) + " ".join(changed)))
        texts += [(2000 + 100 * k + 10 * j + i, broken_up(template, j, rng)) for j in range(2, 8) for i in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["licenses"], r["containment"]) for r in licenses.scan_licenses(docs).collect()), key=repr)
    want = sorted(((i, ",".join(sorted(f)), max(f.values(), default=0.0)) for i, t in texts for f in [reference_licenses(t)]), key=repr)
    assert got == want
    assert sum(bool(f) for _, f, _ in want) > 300


def test_windows_lie_in_the_least_stretch():
    """Any way of breaking a template that keeps 0.8 of its shingles leaves a stretch with an aligned window in it."""
    for n in range(1, 400):
        w = licenses.window_of(n)
        assert w + licenses._step(w) - 1 <= licenses.stretch(n) or w == 1
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 300))
        cuts = sorted(set(rng.integers(1, n + 4, rng.integers(0, 12)).tolist()))
        held = [max(0, y - x - 4) for x, y in zip([0, *cuts], [*cuts, n + 4])]
        if sum(held) >= 0.8 * n:
            assert max(held) >= licenses.stretch(n)


def test_bands_retrieve_changed_windows():
    """Retrieval alone, over windows of eight shingles of which about 0.7 are shared."""
    rng, tried, got = np.random.default_rng(9), 0, 0
    for _ in range(300):
        w = [f"t{k}" for k in rng.integers(0, 10**6, 60)]
        known = licenses.Templates({"one": " ".join(w)})
        assert known.windows == [8]
        text = ["x"] + w[20:31] + ["y"] * 20  # seven of eight shingles lie together, and one of each aligned window's is foreign
        tried += 1
        got += bool(known.retrieve([[t.encode() for t in text]]))
    assert got >= 0.95 * tried


def test_licenses_odd_inputs(spark, clashing, empty_docs):
    assert licenses.scan_licenses(empty_docs).count() == 0
    assert licenses.scan_licenses(clashing).count() == clashing.count()
    assert licenses.scan_licenses(clashing, {}).where("n_licenses > 0").count() == 0
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in licenses.keep_licensed(docs, ["mit"]).collect()) == [1, 3]


def test_toxicity_holds_out(spark):
    """Each third of sf0.1's labels by a model of the others: recall and precision of toxic rows, and severity above that of clean ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = []
    for k in range(3):
        model = toxicity.fit(docs, labels.where(f"doc_id % 3 != {k}"))
        assert (np.diff(model.thresholds) > 0).all() and (model.weights >= 0).all()
        test = labels.where(f"doc_id % 3 = {k}").select("doc_id", F.col("toxic").alias("label"))
        got += toxicity.score(docs, model).join(test, "doc_id").select("toxic", "label", "severity").collect()
    caught = sum(bool(r[0]) and r[1] for r in got)
    assert caught >= 0.9 * sum(r[1] for r in got)
    assert caught >= 0.95 * sum(bool(r[0]) for r in got)
    mean = [np.mean([r["severity"] for r in got if r[1] == k]) for k in (0, 1)]
    assert mean[1] > mean[0] + 0.5


def test_op8_on_whole_tables(spark, tiny):
    """The registered query against scores added up word by word in plain Python."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.words, model.weights.tolist()))
    want = []
    for r in docs.collect():
        held = set(words(r["text"]))
        score = sum(w for name, w in weight.items() if name in held or (name.endswith("*") and any(len(x) >= len(name) - 1 and x.startswith(name[:-1]) for x in held)))
        below = [1 / (1 + math.exp(score - t)) for t in model.thresholds]
        p = [b - a for a, b in zip([0, *below], [*below, 1])]
        want.append((r["doc_id"], round(sum(1 - b for b in below), 9), round(1 - below[0], 9), max(range(4), key=lambda k: (p[k], -k)), 1 - below[0] >= 0.5))
    got = [(r["doc_id"], round(r["severity"], 9), round(r["p_toxic"], 9), r["grade"], r["toxic"]) for r in queries.op8_toxicity(spark, tiny).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_grades_are_of_held_out_evidence():
    """A feature counts for a row only through rows of the other fold; clean rows are 0."""
    x = np.array([[1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 1], [1, 1, 0], [1, 0, 0], [0, 0, 1]], float)
    toxic, fold = np.array([1, 1, 1, 1, 1, 1, 1, 0]), np.array([0, 0, 0, 0, 1, 1, 1, 1])
    grades = toxicity.held_out_grades(x, toxic, fold)
    assert grades[7] == 0 and grades[3] == 1 and set(grades.tolist()) <= {0, 1, 2, 3}
    changed = x.copy()
    changed[0, 2] = 0  # its own words change its count, but what counts as evidence for fold 0 is fold 1's
    assert toxicity.held_out_grades(changed, toxic, fold)[1:4].tolist() == grades[1:4].tolist()


def test_toxicity_of_words_that_others_accompany(spark):
    """Every toxic row holds boor; a text with only one of the words beside it is toxic too. Words of one text's near copies aren't features."""
    rng = np.random.default_rng(3)
    plain = [f"plain{k}" for k in range(300)]
    text = lambda *more: " ".join([*rng.choice(plain, 30), *more])
    texts = [(k, text("boor", *rng.permutation(["lout", "churl", "knave"])[:2])) for k in range(60)]
    copied = [f"beside{k}" for k in range(40)]
    texts += [(100 + k, " ".join(["boor", *copied, f"copy{k}"])) for k in range(20)]
    texts += [(200 + k, text()) for k in range(300)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in texts], "doc_id long, toxic int")
    asked = {"boor": True, "lout": True, "a churl": True, "knave": True, "lout and knave": True, "beside3": False, "beside3 beside4": False, "plain3": False}
    docs = spark.createDataFrame(texts + [(1000 + k, t) for k, t in enumerate(asked)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert {t: got[1000 + k] for k, t in enumerate(asked)} == asked
    assert all(got[i] == (i < 200) for i, _ in texts)


def test_severity_grows_with_words(spark):
    model = toxicity.Model(["bad", "worse", "worst"], np.array([6.0, 6.0, 6.0]), np.array([3.0, 8.0, 14.0]))
    docs = spark.createDataFrame([(0, "fine"), (1, "Bad!"), (2, "bad and worse"), (3, "bad worse worst"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [got[k]["grade"] for k in range(4)] == [0, 1, 2, 3] and not got[4]["toxic"] and not got[5]["toxic"]
    severity = [got[k]["severity"] for k in range(4)]
    assert severity == sorted(severity)


def test_toxicity_odd_inputs(spark, docs, clashing, empty_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs, some)
        assert toxicity.score(docs, model).where("toxic").count() == 0
        assert toxicity.drop_toxic(clashing, model).count() == clashing.count()
        assert toxicity.drop_toxic(clashing, model).columns == clashing.columns
    assert toxicity.score(empty_docs, toxicity.fit(empty_docs, labels)).count() == 0
    some = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))  # null, empty and long texts are labelled too
    model = toxicity.fit(docs, some)
    assert toxicity.score(docs, model).count() == docs.count()


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 4)) < 0.5).astype(float)
    latent = x @ np.array([2.0, -1.0, 0.0, 3.0]) + rng.logistic(size=3000)
    grade = np.digitize(latent, [1.0, 3.0, 5.0])
    w, theta = toxicity.fit_ordinal(x, grade)
    assert w == pytest.approx([2, -1, 0, 3], abs=0.35) and theta == pytest.approx([1, 3, 5], abs=0.4)

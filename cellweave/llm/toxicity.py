"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all thresholds; x marks which of the selected
features a text holds: words, and starts of words (written with a star, for families of inflected and compound words).
The expected grade is the severity; a document is toxic if P(grade >= 1) is one half or more.

Labels are binary, so grades are made from held-out evidence: the sample falls into two folds, and a toxic row is graded 1
to 3 by terciles of how many of its features tell toxic from clean among the rows of the other fold; clean rows are 0. A
row's grade so never rests on its own label's share in choosing words. The model is fitted on a bounded sample of labelled
rows (MAX_TOXIC, MAX_CLEAN, taken in hash order of doc_id); all other work covers all rows.

Words that merely stand beside others in copies of toxic texts must not count, so near copies among the toxic rows of
the sample count once in the test that selects features. All features that pass it are kept, whatever stands beside them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import _TABLE, as_texts

#: Labelled rows that the model is fitted on, at most.
MAX_TOXIC, MAX_CLEAN = 3_000, 6_000
#: Selected words, at most, and the least signed root of the log-likelihood ratio that tells their shares apart.
MAX_WORDS, MIN_Z = 400, 4.0
GRADES = 4
#: Characters of the starts of words that are features; toxic rows with a feature for each clean one.
STARTS = (3, 4, 5, 6)
LEAST_ODDS = 4
#: Of a feature's toxic rows to its clean ones in one fold, for grades of the other.
HELD_OUT_ODDS = 2
#: Rows that may well be there where a sample shows none (the rule of three).
UNSEEN = 3
#: MinHash values of a text's five-word shingles, and the share of them that near copies have in common.
SHINGLE, COPY_SHARE = 5, 0.3
_FACTORS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def features(text: bytes, starts: tuple[int, ...] = STARTS) -> set[str]:
    """Distinct words of a text (as in decontamination) and, with a star, their starts of these lengths."""
    found = set(text.translate(_TABLE).decode("utf-8", "replace").split(" "))
    found.discard("")
    out = set(found)
    for n in starts:
        out |= {w[:n] + "*" for w in found if len(w) >= n}
    return out


def sketch(text: bytes) -> list[int]:
    """MinHash of a text's shingles of SHINGLE words."""
    h = np.array([zlib.crc32(w) for w in text.translate(_TABLE).split()] or [0], np.uint64)
    n = max(len(h) - SHINGLE + 1, 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    s = np.unique(s ^ (s >> np.uint64(31)))
    return [int((s * f).min() >> np.uint64(32)) for f in _FACTORS]


def copy_groups(sketches: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows that near copies link."""
    parent = np.arange(len(sketches))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for i in range(len(sketches)):
        for j in np.flatnonzero((sketches[i + 1 :] == sketches[i]).mean(1) >= COPY_SHARE) + i + 1:
            parent[root(int(j))] = root(i)
    return np.array([root(k) for k in range(len(sketches))], np.int64)


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k below the last grade, a column each."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


#: Finds nothing toxic.
NOTHING = Model([], np.zeros(0), np.array([30.0, 31.0, 32.0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """toxic (0/1), words (distinct) and, of toxic rows, sketch of at most max_toxic + max_clean labelled documents, one row for equal texts' words.

    Labels with a null id or value don't count; where an id has several, toxic wins.
    """
    clear = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [clear.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    chosen = some[0].unionByName(some[1]).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))

    @F.arrow_udf("array<string>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(features(t)) for t in as_texts(texts)], pa.list_(pa.string()))

    @F.arrow_udf("array<long>")
    def sketched(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(t) for t in as_texts(texts)], pa.list_(pa.int64()))

    # max_toxic + max_clean rows of two numbers: small whatever the corpus
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.select("toxic", distinct("text").alias("words"), sketched(F.when(F.col("toxic") == 1, F.col("text"))).alias("sketch"))
    rows = rows.groupBy("words").agg(F.max("toxic").alias("toxic"), F.max(F.struct("toxic", "sketch")).alias("m"))
    return rows.select("words", "toxic", F.when(F.col("toxic") == 1, F.col("m.sketch")).alias("sketch"))


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with part: a number for each row, shared by toxic rows that are near copies (at most max_toxic sketches are collected)."""
    sample = sample.withColumn("row", F.xxhash64("words"))
    held = sample.where("toxic = 1").select("row", "sketch").orderBy("row").collect()
    if not held:
        return sample.withColumn("part", F.col("row"))
    parts = copy_groups(np.array([r["sketch"] for r in held], np.int64))
    linked = sample.sparkSession.createDataFrame([(r["row"], held[p]["row"]) for r, p in zip(held, parts.tolist(), strict=True)], "row long, _part long").distinct()
    return sample.join(F.broadcast(linked), "row", "left").withColumn("part", F.coalesce("_part", "row")).drop("_part")


def select_words(sample: DataFrame, totals: dict[int, int], max_words: int = MAX_WORDS, min_z: float = MIN_Z) -> list[tuple[str, float, int]]:
    """Features that are clearly commoner among toxic rows than among clean rows, strongest first, with the root of the log-likelihood ratio and the toxic rows that have them.

    sample: with part, the rows of which count once; totals: the number of parts by toxic.
    """
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    once = sample.select("toxic", "part", F.explode("words").alias("word")).distinct()
    counts = once.groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("a > 0")
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    share = F.col("n") / (n1 + n0)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    cells = ((a, share * n1), (b, share * n0), (n1 - a, (1 - share) * n1), (n0 - b, (1 - share) * n0))
    g = F.sqrt(F.greatest(2 * sum((part(seen, expected) for seen, expected in cells), F.lit(0.0)), F.lit(0.0)))
    z = F.when(a / n1 >= b / n0, g).otherwise(-g)
    rows = counts.where(a >= LEAST_ODDS * b).withColumn("z", z).where(F.col("z") >= min_z).orderBy(F.col("z").desc(), F.length("word").desc(), "word").limit(max_words)  # of equals, the most specific
    return [(r["word"], r["z"], r["a"]) for r in rows.collect()]


def covers(start: str, name: str) -> bool:
    """Whether texts with this feature's word always have `start` too."""
    return start == name or (start.endswith("*") and name.removesuffix("*").startswith(start[:-1]))


def telling(names: list[str], x: np.ndarray, toxic: np.ndarray) -> list[int]:
    """All columns but starts of words that add nothing to longer features under them: the same rows, or else rows that don't have the odds of a feature.

    So loser keeps its place and lose* goes, where lose* without loser is as common in clean rows. Of a word and its own
    start with the same rows, the start stays, for inflected forms. Different words stay, whatever stands beside them.
    """
    stem = [len(n.removesuffix("*")) for n in names]
    kept: list[int] = []
    for k in sorted(range(len(names)), key=lambda k: (-stem[k], names[k].endswith("*"))):
        under = [j for j in kept if covers(names[k], names[j])]
        left = (x[:, k] == 1) & ~(x[:, under] == 1).any(1)
        if under and (toxic[left] == 1).sum() < LEAST_ODDS * (toxic[left] == 0).sum():
            continue
        same = [j for j in under if (x[:, j] == x[:, k]).all()]
        if any(stem[j] > stem[k] for j in same):
            continue
        kept = [j for j in kept if j not in same] + [k]
    return sorted(kept)


def raised(names: list[str], weights: np.ndarray, threshold: float, which: np.ndarray) -> np.ndarray:
    """weights, with those of these features raised until a text that holds one of them alone is toxic.

    The fit can't tell words apart that always stand together and shares one weight among them.
    """
    out = weights.copy()
    for k in sorted(np.flatnonzero(which), key=lambda k: len(names[k])):
        alone = sum(out[j] for j in range(len(names)) if covers(names[j], names[k]))
        out[k] += max(0.0, threshold + 1e-6 - alone)
    return out


def held_out_grades(x: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 for clean rows; for toxic rows 1 to 3, by terciles of how many features they hold that toxic rows of the other fold hold HELD_OUT_ODDS times as often as its clean rows."""
    evidence = np.zeros(len(x))
    for k in (0, 1):
        other = fold != k
        bad, good = x[other & (toxic == 1)].sum(0), x[other & (toxic == 0)].sum(0)
        evidence[~other] = x[~other][:, (bad > 0) & (bad >= HELD_OUT_ODDS * good)].sum(1)
    some = evidence[(toxic == 1) & (evidence > 0)]
    edges = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else np.array([np.inf, np.inf])
    return np.where(toxic == 1, 1 + (evidence > edges[0]).astype(int) + (evidence > edges[1]), 0)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, l2: float = 0.02, steps: int = 1000, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Weights (`least` or more) and ascending thresholds of the cumulative-link model, by gradient steps with momentum (Adam) on the mean loss."""
    n, m = x.shape
    w, first, gaps = np.zeros(m), 0.0, np.zeros(grades - 2)
    params = np.concatenate([w, [first], gaps])
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, first, gaps = params[:m], params[m], params[m + 1 :]
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        cdf = 1 / (1 + np.exp(np.clip((x @ w)[:, None] - theta, -60, 60)))
        upper = np.concatenate([cdf, np.ones((n, 1))], 1)[rows, grade]
        lower = np.concatenate([np.zeros((n, 1)), cdf], 1)[rows, grade]
        p = np.maximum(upper - lower, 1e-12)
        slope = cdf * (1 - cdf)
        d_theta = np.zeros((n, grades - 1))
        up, down = grade < grades - 1, grade > 0
        d_theta[rows[up], grade[up]] += (slope[rows[up], grade[up]] / p[up])
        d_theta[rows[down], grade[down] - 1] -= (slope[rows[down], grade[down] - 1] / p[down])
        by_theta = -d_theta.sum(0) / n
        by_w = x.T @ d_theta.sum(1) / n + l2 * w / n
        tail = by_theta[::-1].cumsum()[::-1]
        grad = np.concatenate([by_w, [by_theta.sum()], tail[1:] * np.exp(gaps)])
        mean = 0.9 * mean + 0.1 * grad
        spread = 0.999 * spread + 0.001 * grad**2
        params = params - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-9)
        params[:m] = np.maximum(params[:m], least)
    theta = params[m] + np.concatenate([[0.0], np.cumsum(np.exp(params[m + 1 :]))])
    return params[:m], theta


def fit(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """A model from labelled documents; without rows of both kinds, one that finds nothing toxic."""
    sample = common.materialize(labelled_sample(docs, labels, **how), "toxicity-sample")
    once = without_copies(sample)
    totals = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.countDistinct("part").alias("n")).collect()}
    chosen = select_words(once, totals)
    if not chosen:
        return NOTHING
    names = [w for w, _, _ in chosen]
    place = {w: k for k, w in enumerate(names)}
    listed = F.array_intersect("words", F.array(*[F.lit(w) for w in names]).cast("array<string>"))
    rows = sample.select("toxic", listed.alias("words")).collect()  # the sample's rows, with selected words only
    x, toxic = np.zeros((len(rows), len(names))), np.array([r["toxic"] for r in rows])
    for k, r in enumerate(rows):
        x[k, [place[w] for w in r["words"]]] = 1
    kept = telling(names, x, toxic)
    often = np.array([chosen[k][2] for k in kept])
    x, names = x[:, kept], [names[k] for k in kept]
    fold = np.array([zlib.crc32(" ".join(sorted(r["words"])).encode()) & 1 for r in rows])
    weights, thresholds = fit_ordinal(x, held_out_grades(x, toxic, fold), least=0.0)
    certain = (often >= LEAST_ODDS * UNSEEN) & ~(x[toxic == 0] == 1).any(0)
    return Model(names, raised(names, weights, thresholds[0], certain), thresholds)


def _scored(model: Model):
    @F.arrow_udf("severity double, p_toxic double, grade int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = dict(zip(model.words, model.weights.tolist(), strict=True))
        starts = tuple(sorted({len(w) - 1 for w in model.words if w.endswith("*")}))
        for texts in batches:
            score = np.array([sum(weight[w] for w in sorted(features(t, starts) & weight.keys())) for t in as_texts(texts)], float)
            below = model.at_most(score)
            p = np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1))
            yield pa.StructArray.from_arrays([pa.array((1 - below).sum(1)), pa.array(1 - below[:, 0]), pa.array(p.argmax(1).astype(np.int32))], ["severity", "p_toxic", "grade"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, severity (expected grade), p_toxic, grade (likeliest) and toxic.

    Null and empty texts hold no words; null and repeated ids are scored row by row; columns besides doc_id and text are
    left out, whatever their names; no documents give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), _scored(model)("text").alias("s"))
    return rows.select("doc_id", "s.*", (F.col("s.p_toxic") >= 0.5).alias("toxic"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the toxic rows; judged where they are read, nothing is shuffled."""
    s = common.fresh(docs, "s")[0]
    return docs.withColumn(s, _scored(model)("text")).where(F.col(s)["p_toxic"] < 0.5).drop(s)

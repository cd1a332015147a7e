import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=5):
    """Small documents with nulls, blanks, ties, repeats, copies, near copies, one very long text and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "epsilon,", "zeta.", "eta", "theta's", "iota", "KAPPA", "λ", "mu-nu", "日本", "x1", "42", "<|endoftext|>"]
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(n))
    texts = [text(rng.randint(0, 60)) for _ in range(40)]
    base = text(300)
    near = [base.replace(w, w + "q", 1) for w in base.split()[:3]]
    texts += [base, *near, base, base]
    texts += [None, None, "", "", " ", "\t\n", "one", "one two three", "İß Σς 　 x  y \n\n z", "é́ á", "\\ <| <\\|  ", "a\x1cb\x85c"]
    texts += [" ".join(f"w{i % 997}" for i in range(30_000)), "n" * 20_000, "ab" * 4096, "ab" * 4095 + "ac"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "one", "en", None, None), (None, None, None, None, None), (3, "another text for id three", "en", "s", 1)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["uid", "h", "k", "i", "name", "fp", "key", "state", "found", "_cw_state", "_cw_s", "_cw_doc_id", "_cw_sha", "n_words", "kept", "text_sha256", "length", "component_id"]
    return docs.select("*", *[F.lit(7).alias(c) for c in extra])

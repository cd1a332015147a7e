"""The corpus pipeline and the registered queries on whole small tables."""

import duckdb
import pytest

import corpus_pipeline
from cellweave.llm import queries, toxicity
from tests.llm.test_dedup import reference_exact, reference_near
from tests.llm.test_text import reference_scan
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def con(tiny):
    db = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, tiny, con, name):
    df = queries.QUERIES[name](spark, tiny)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    flat = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert flat(df.select(*names).collect()) == flat(want.fetchall())


def test_op2_and_op1_on_whole_tables(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_near_dedup(spark, tiny).collect()), key=repr) == reference_near(rows)
    check_packing(queries.op1_best_fit_packing(spark, tiny).collect(), rows, 2048)


def test_pipeline_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("toxic").collect()}
    rows = [r for r in rows if r[0] not in bad]
    kept = {r[0] for r in reference_exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {i for i, _, c in reference_near(rows) if i == c}
    rows = [r for r in rows if r[0] in kept]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    kept = {r[0] for r in reference_scan(rows, items, 13) if not r[5]}
    rows = [r for r in rows if r[0] in kept]
    check_packing(corpus_pipeline.run(spark, tiny).collect(), rows, 2048)


def test_stages_keep_columns(spark, tiny, clashing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, tiny).columns == clashing.columns


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _copy_of(spark, tiny, tmp_path, rows):
    """A folder with these documents beside the given labels and benchmark."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tiny}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pipeline_without_documents(spark, tiny, tmp_path):
    assert corpus_pipeline.run(spark, _copy_of(spark, tiny, tmp_path, [])).count() == 0


def test_pipeline_with_null_and_repeated_ids(spark, tiny, tmp_path):
    """Of equal texts one row stays, of near copies one; texts that differ stay, whatever their ids."""
    apart = ["the first text has its own words only", "quite another one, about rivers and stones", "numbers 1 2 3 and nothing more than that", None]
    rows = [(None, t, "en", "s", 1) for t in apart] + [(4, apart[0], "en", "s", 1), (4, apart[0], "en", "s", 1), (4, "one more text under a used number, of birds", "en", "s", 1)]
    got = corpus_pipeline.run(spark, _copy_of(spark, tiny, tmp_path, rows)).collect()
    kept = [apart[0], "one more text under a used number, of birds", *apart[1:]]
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "4", "None", "None", "None"]
    from tests.llm.test_tokens import crc, reference_ids

    assert sorted(r["ids_crc32"] for r in got) == sorted(crc(i) for i in reference_ids([(0, t) for t in kept], 0))

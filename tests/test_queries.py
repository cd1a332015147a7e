"""Every registered image query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cellweave.plans import catalogue


@pytest.fixture(scope="module")
def con(tiny):
    db = duckdb.connect()
    for name in os.listdir(tiny):
        db.execute(f"create view {name.split('.')[0]} as select * from '{tiny}/{name}'")
    return db


def flat(rows):
    def one(v):
        return round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, tiny, con, name):
    df = catalogue.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert flat(df.select(*[f"`{c}`" for c in columns]).collect()) == flat([[r[k] for k in order] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0

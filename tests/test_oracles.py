"""Every query of the blocking engine against its SQL."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(cell(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == canonical(columns, cursor.fetchall())


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1

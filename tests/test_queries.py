"""Every query with SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

from claimweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, sql, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    result = sql.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, result.fetchall())
    assert want, "nothing to compare"
    assert got == want

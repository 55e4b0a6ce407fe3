"""Every query with SQL gives the rows that DuckDB gives; those without give rows."""

import os

import duckdb
import pytest

from evidentia import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def normal(rows):
    plain = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    kinds = dict(df.dtypes)
    for column, description in zip(columns, cursor.description, strict=True):
        assert TYPES[kinds[column]] == str(description[1]).replace("NUMBER", ""), column
    expect = [tuple(r[columns.index(c)] for c in names) for r in cursor.fetchall()]
    assert normal(got) == normal(expect)


def test_flagship(spark):
    assert catalog.FLAGSHIP(spark, DATA).columns

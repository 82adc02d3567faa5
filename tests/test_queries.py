"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from apisurface.plans import catalog

FOLDER = os.environ.get("APISURFACE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def shown(value):
    if value is None:
        return "NULL"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(tuple(shown(row[c]) for c in columns) for row in df.collect())
    sql = catalog.oracles().get(name)
    if sql is None:
        assert ours
        return
    cursor = duck.execute(sql)
    names, types = [d[0] for d in cursor.description], [str(d[1]) for d in cursor.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, types))[c] for c in columns]
    assert [SPARK_TYPES[dict(df.dtypes)[c]] for c in columns] == ["VARCHAR" if t == "STRING" else t for t in expected]
    place = [names.index(c) for c in columns]
    assert ours == sorted(tuple(shown(row[i]) for i in place) for row in cursor.fetchall())

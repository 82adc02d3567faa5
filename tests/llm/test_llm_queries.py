"""Every registered query of the package on the smallest tables, against its SQL where there is one."""

import os

import duckdb
import pytest

from apisurface.llm import catalog

FOLDER = os.environ.get("APISURFACE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    rows = catalog.queries()[name](spark, FOLDER)
    got = sorted(map(str, [tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()]))
    assert got
    if name in catalog.oracles():
        duck = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "labels", "conversations"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        sql = duck.sql(catalog.oracles()[name])
        places = [sql.columns.index(c) for c in sorted(sql.columns)]
        assert sorted(rows.columns) == sorted(sql.columns)
        assert got == sorted(str(tuple(r[i] for i in places)) for r in sql.fetchall())


def test_operators_and_the_pipeline():
    names = catalog.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))

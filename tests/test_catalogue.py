"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

from paperloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "documents", "pages", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _plain(v):
    return str(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name not in ORACLE_SQL:
        return
    cursor = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())

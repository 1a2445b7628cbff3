"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in found.fetchall())
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

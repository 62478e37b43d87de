"""Every query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from stratapack.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", registry.NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    assert got
    if name in SQL:
        want = duck.execute(SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())

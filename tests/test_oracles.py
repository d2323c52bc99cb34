"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import math

import duckdb
import pytest

from tapewright import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted([tuple(one(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.oracle_sql():
        found = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert rows == canonical(names, found.fetchall())

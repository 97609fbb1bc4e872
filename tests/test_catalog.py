"""Every query with SQL equals DuckDB on the same tables; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pixelweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "lineitem events part".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in catalog.SQL:
        got = con.execute(catalog.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
        assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 1

"""Every registered query of this package against its SQL in DuckDB, and by columns and rows where there is none."""

import math
import os

import duckdb
import pytest

from voxloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool | str):
        return str(v)
    if isinstance(v, int | float):
        return f"{float(v):.7g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name not in catalog.ORACLES:
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    left = sorted(tuple(cell(r[c]) for c in order) for r in rows)
    right = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(x == y or math.isclose(float(x), float(y), rel_tol=1e-4, abs_tol=2e-5) for x, y in zip(a, b, strict=True) if x != y), (a, b)

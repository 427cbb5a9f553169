"""Every registered query of the library runs on the smallest tables and agrees with its oracle."""

import math
import os

import duckdb
import pytest

from evoked.plans import all_oracles, all_queries

@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: [(x is not None, str(type(x)), round(x, 4) if isinstance(x, float) else str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf_dir, duck, name):
    df = all_queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name not in all_oracles():
        assert got  # those without SQL are held against plain versions in test_golden and test_plain
        return
    cur = duck.execute(all_oracles()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6), (a, b)

"""Every registered query that has SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from sweepline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, data, duck):
    got = registry.QUERIES[name](spark, data)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(map(tuple, got.collect()), got.columns) == canonical(want.fetchall(), columns)


def test_every_query_runs_without_sql(spark, data):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, data).count() > 0

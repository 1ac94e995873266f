"""Every registered query of the store against its DuckDB SQL."""

import math

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    a, b = _rows(got.columns, [tuple(r) for r in got.collect()]), _rows(want.columns, want.fetchall())
    assert a[0] == b[0]
    assert a[1] == b[1]

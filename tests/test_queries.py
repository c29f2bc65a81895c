"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from pointloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall())


def test_nan_points_are_left_out_and_one_point_is_one_tile(spark):
    from pointloom.operators import tiling

    rows = spark.createDataFrame([(1.0, 1.0, 1.0), (float("nan"), 0.0, 0.0), (None, 0.0, 0.0)], "x double, y double, z double")
    assert [tuple(r) for r in tiling.balanced_points(rows, 2, 10).collect()] == [(1.0, 1.0, 1.0, 0)]
    assert tiling.balanced_points(rows.limit(0), 2, 10).count() == 0

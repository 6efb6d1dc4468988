"""Every registered query of the library against its SQL twin in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    found = duck.execute(SQL[name])
    columns, types = [c[0] for c in found.description], {c[0]: str(c[1]) for c in found.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = sorted(columns)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Queries without SQL; their operators are held against loops elsewhere."""
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0

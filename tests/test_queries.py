"""Each catalogue query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from docloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 8) if isinstance(v, float) else v


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = df.select(*names).collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == names
    types = dict(df.dtypes)
    assert {c: types[c] for c in names} == {c: TYPES.get(str(t), types[c]) for c, t in zip(want.columns, want.types, strict=True)}
    at = [want.columns.index(c) for c in names]
    assert in_order(got) == in_order([[r[i] for i in at] for r in want.fetchall()])

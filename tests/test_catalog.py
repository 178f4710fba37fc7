"""Every query of the catalogue against its oracle SQL, at the smallest scale."""

import math

import duckdb
import pytest

from tidewater import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert rows == sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=repr)

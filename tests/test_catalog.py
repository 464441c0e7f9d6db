"""Every query of the catalog with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from corpusloom.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = canon(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns

"""Every registered query of the library proper against its SQL, on the smallest scale."""

import os

import duckdb
import pytest

from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.limit(1).count() == 1
        return
    want = tables.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())

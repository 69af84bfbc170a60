"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import datetime

import duckdb
import pytest

from tessera.plans import corpus, portfolio, providers, retrieval

MODULES = (portfolio, retrieval, corpus, providers)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return None if x != x else f"{x:.6g}"
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    return x if x is None or isinstance(x, (str, bool)) else f"{x:.6g}"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([cell(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.ORACLE])
def test_equals_sql(spark, con, sf_dir, name):
    module = next(m for m in MODULES if name in m.ORACLE)
    got = module.QUERIES[name](spark, sf_dir)
    want = con.execute(module.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry_has_a_row(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1

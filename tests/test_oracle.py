"""Every query with SQL against DuckDB, over whole tables; queries without SQL run."""

import duckdb
import pytest

from lodestar.plans import catalog, catalog_text  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(repr(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toArrow()
    if name not in catalog.SQL:
        assert got.num_rows > 0
        return
    want = con.execute(catalog.SQL[name])
    expected = rows([c[0] for c in want.description], want.fetchall())
    assert rows(got.column_names, zip(*(c.to_pylist() for c in got.columns), strict=True)) == expected


def test_flagship(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).first()[0] < 1

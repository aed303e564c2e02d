"""The driver contract: names, columns, and every checked query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def test_entry_and_names():
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 100


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def pytest_generate_tests(metafunc):
    if "checked" in metafunc.fixturenames:
        from lumenary import catalog

        metafunc.parametrize("checked", sorted(catalog.oracle_sql()))


def test_against_sql(spark, data, checked):
    import duckdb
    from lumenary import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{Path(data, f'{t}.parquet')}'")
    got = catalog.queries()[checked](spark, data)
    want = con.sql(catalog.oracle_sql()[checked])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = [want.columns.index(c) for c in cols]
    rows = sorted(str(tuple(plain(r[c]) for c in cols)) for r in got.collect())
    assert rows == sorted(str(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["d2_mine_mentions", "r6_lsh_search", "r6_inverted_file_search"])
def test_unchecked_run(spark, data, name):
    from lumenary import catalog

    assert catalog.queries()[name](spark, data).count() > 0

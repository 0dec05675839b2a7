"""Every registered query runs on the smallest tables and, where there is SQL for it, agrees with it."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from marlstone.plans import interface, preparation, reference

D = "/root/testdata/sf0.001"
CORE = {**preparation.QUERIES, **reference.QUERIES, **interface.QUERIES}
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, db, name):
    from scripts.compare import rows

    got = CORE[name](spark, D).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(db.execute(sql).df())

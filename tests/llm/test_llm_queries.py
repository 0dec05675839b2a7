from pathlib import Path

import pytest

import __spark_entry__ as entry
from marlstone.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    from scripts.compare import rows

    got = entry.queries()[name](spark, D).toPandas()
    if name in queries.ORACLES:
        c = duckdb.connect()
        for p in Path(D).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert rows(got) == rows(c.execute(queries.ORACLES[name]).df())
    assert len(got) or name in ("p5_ranges", "p8_found")  # no long or shared texts in the smallest tables


def test_nothing_else_imports_this_package():
    root = Path(entry.__file__).parent
    files = [p for p in [*root.glob("*.py"), *root.glob("marlstone/**/*.py"), *root.glob("scripts/*.py")] if "/llm/" not in str(p) and p.name != "__spark_entry__.py"]
    assert not [p for p in files if "marlstone.llm" in p.read_text()]

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from marlstone.session import local_session

    s = local_session(4, 4)
    s.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    def of(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return of

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mcqflow.session import local_session

    session = local_session(4, "tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture
def values(spark):
    """Evaluate one column over a list of inputs, in order."""
    from pyspark.sql import functions as F

    def run(inputs, ddl, column):
        rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {ddl}")
        return [r.v for r in rows.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]

    return run

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from bookweave.session import local_session

    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def one(spark):
    """Value of an expression over one row of text: one(fn, "text")."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        names = [f"c{i}" for i in range(len(values))]
        row = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'bigint'}" for n, v in zip(names, values)))
        return row.select(fn(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return run

"""Where intermediate tables go: the folder that the cluster names, for all executors to read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import work_folder


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of this machine in a local session only."""
    named = work_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table written in the shared folder: no lineage, readable whichever executors are lost."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, name: str, column: str, **options: str) -> DataFrame:
    """``df`` written in the shared folder in buckets of ``column``, as many as shuffles have partitions, so that joins
    by it don't move its rows again.  The table's entry in the catalog is of no further use and names that folder."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, column).options(path=new_folder(spark, name), **options).saveAsTable(table, format="parquet")
    return spark.table(table)


@contextmanager
def tidy(spark: SparkSession, batch: int | None = None) -> Iterator[None]:
    """Within, the shuffle files of a statement go when it ends, not when the driver happens to collect its garbage, and
    rows go to Python in batches of about ``batch`` bytes (one row, where that is larger)."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    own |= {"spark.sql.execution.arrow.maxBytesPerBatch": str(batch)} if batch else {}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

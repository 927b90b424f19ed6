"""Session settings the operators are written for."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Settings worth having on any cluster; none is needed for right results.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int = 8, memory: str = "12g", **settings: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bookweave")
    own = {
        **SETTINGS,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **settings,
    }
    for k, v in own.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables and checkpoints: the one that ``spark.checkpoint.dir`` names.

    Where it is unset, a session whose only machine is this one (``local[...]``) uses a temporary folder;
    on a cluster that would be a different folder for each executor, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="bookweave-")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that they can import it."""
    context = spark.sparkContext
    if getattr(context, "_bookweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="bookweave-package-")  # of the driver, which serves it while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "bookweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(here)))
    context.addPyFile(archive)
    context._bookweave_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_folder(spark))

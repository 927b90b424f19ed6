"""Task events as Structured Streaming jobs.

Stateful operators keep one row of state per task in RocksDB; a micro-batch holds what the source
admits, so ``maxFilesPerTrigger`` bounds the rows of even the busiest task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tasks as operators
from ..functions.logs import is_noise
from ..session import ROCKSDB
from . import processors
from .processors import Changes, IdleWatch, LogRing, Machine

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, task_id bigint, action string, pct bigint, log_line string"


def read_task_events(
    spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, late: str = "10 minutes", files: int = 1, glob: str | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Stream of event files with event time ``ts`` and its watermark; ``shape`` may rename raw columns."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    shaped = shape(raw) if shape else raw
    return shaped.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _by_value() -> None:
    # Spark also starts a Python process beside the driver, which packages sent to executors don't reach.
    for module in (processors, operators):
        cloudpickle.register_pickle_by_value(module)


def _stateful(events: DataFrame, processor, schema: str, mode: str, timers: str = "none", frames: bool = True) -> DataFrame:
    """``frames``: whether the processor takes a key's rows as pandas frames, or one by one."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    _by_value()
    tasks = events.groupBy("task_id")
    run = tasks.transformWithStateInPandas if frames else tasks.transformWithState
    return run(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=timers)


def task_state(events: DataFrame) -> DataFrame:
    """Latest value of every field per task, an aggregate as in batch: it is from the newest event whatever
    order events arrive in.  For update mode."""
    return operators.task_state(events)


def task_machine(events: DataFrame, initial: str = "pending") -> DataFrame:
    schema = "event_id bigint, task_id bigint, action string, before string, after string, accepted boolean"
    return _stateful(events, Machine(initial), schema, "Append")


def log_ring(events: DataFrame) -> DataFrame:
    """What is left of every task's log; noise lines are not logged."""
    events = events.withColumn("log_line", F.when(~is_noise("log_line"), F.col("log_line")))
    return _stateful(events, LogRing(), "task_id bigint, n bigint, lines array<string>", "Update")


def idle_watch(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """``paused`` for running and ``expired`` for ended tasks, when they have been silent for that long.  Events without a
    time are left out."""
    _by_value()
    rows = events.where("ts IS NOT NULL").select("event_id", F.unix_micros("ts").alias("us"), "task_id", "action")
    events = rows.repartition("task_id").mapInArrow(processors.packed, "task_id bigint, events binary")
    return _stateful(events, IdleWatch(seconds), "task_id bigint, event string, last_ms bigint", "Append", "EventTime", frames=False)


def progress_stream(events: DataFrame) -> DataFrame:
    return _stateful(events, Changes(), "event_id bigint, task_id bigint, pct bigint", "Append")


def await_decision(requests: DataFrame, responses: DataFrame, seconds: int = 300) -> DataFrame:
    """First answer within the limit per request (req_event, task_id, asked_at), else timeout.

    A left outer interval join, then one aggregate per request; both free their state by watermark.
    """
    limit = F.expr(f"INTERVAL '{int(seconds)}' SECOND")
    r = responses.select(F.col("task_id").alias("_task"), "answered_at", "resp_event", "confirm")
    pairs = requests.join(
        r,
        (F.col("task_id") == F.col("_task"))
        & (F.col("answered_at") >= F.col("asked_at"))
        & (F.col("answered_at") <= F.col("asked_at") + limit),
        "leftOuter",
    )
    first = F.min_by(F.struct("resp_event", "confirm"), F.when(F.col("resp_event").isNotNull(), F.struct("answered_at", "resp_event")))
    return pairs.groupBy("asked_at", "req_event", "task_id").agg(first.alias("a")).select(
        "req_event", "task_id", F.col("a.resp_event").alias("resp_event"),
        F.when(F.col("a.confirm"), "confirmed").when(~F.col("a.confirm"), "declined").otherwise("timeout").alias("outcome"),
    )


def dedupe_completions(events: DataFrame, key: list[str]) -> DataFrame:
    """Each completed item once, as long as repeats arrive within the watermark."""
    return events.dropDuplicatesWithinWatermark(key)


def idle_sessions(events: DataFrame, gap: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy("task_id", w).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select(
        "task_id", F.col("session_window.start").alias("first_ts"), "last_ts", "n"
    )


# ---------------------------------------------------------------- sinks


def write_task_snapshot(
    states: DataFrame, path: str, checkpoint: str, every: str | None = None, compact_every: int = 10
) -> StreamingQuery:
    """Keep the latest state of all tasks at ``path`` as a log of changes: a batch writes its own tasks only.

    Every ``compact_every`` batches the log is merged into a base.  Folders appear whole and are named by the
    batch's number, so a replayed batch overwrites its own changes and a base that is there is not made again.
    What a base replaced goes with the base after it, so readers under way keep their files.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes={number}")
        if (number + 1) % compact_every == 0:
            compact_task_snapshot(batch.sparkSession, path, number)

    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def compact_task_snapshot(spark: SparkSession, path: str, upto: int) -> None:
    """Merge the changes up to a batch into a base and remove what the base before it had replaced."""
    bases = _folders(spark, path, "base")
    if upto in bases:
        return
    _newest(spark, path, upto).write.mode("overwrite").parquet(f"{path}/base={upto}")
    if not bases:
        return
    gone = [f"base={b}" for b in bases if b < bases[-1]] + [f"changes={c}" for c in _folders(spark, path, "changes") if c <= bases[-1]]
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _newest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest row of each task in the last base and the changes behind it."""
    until = lambda kind: [n for n in _folders(spark, path, kind) if upto is None or n <= upto]
    base = until("base")[-1:]
    names = [("base", n) for n in base] + [("changes", n) for n in until("changes") if not base or n > base[0]]
    if not names:
        raise ValueError(f"no snapshot at {path}")
    parts = [spark.read.parquet(f"{path}/{kind}={n}").withColumn("_batch", F.lit(n).cast("bigint")) for kind, n in names]
    rows = reduce(DataFrame.unionByName, parts)
    row = F.struct(*[c for c in rows.columns if c != "_batch"])
    return rows.groupBy("task_id").agg(F.max_by(row, "_batch").alias("_r")).select("_r.*")


def read_task_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return _newest(spark, path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    ``update`` streams are written batch by batch under their number.
    """
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
        query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

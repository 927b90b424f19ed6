"""Streams over several files against their batch twins."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookweave.operators import tasks as B
from bookweave.streaming import tasks as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in four files by time, then one late sentinel that moves the watermark."""
    from bookweave.plans.views import Views

    out = tmp_path_factory.mktemp("events")
    events = Views(spark, "/root/testdata/sf0.001").task_events.orderBy("ts").collect()
    schema = S.EVENT_SCHEMA
    size = len(events) // 4 + 1
    for i in range(0, len(events), size):
        spark.createDataFrame([tuple(r) for r in events[i : i + size]], schema).coalesce(1).write.mode("append").parquet(str(out))
    late = events[-1].ts + dt.timedelta(days=9)
    spark.createDataFrame([(10**9, late, 10**9, "progress", 1, None)], schema).coalesce(1).write.mode("append").parquet(str(out))
    return str(out), events


def run(stream, tmp_path, mode="append"):
    return S.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), mode)


def batch(spark, folder):
    return spark.createDataFrame([tuple(r) for r in folder[1]], S.EVENT_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def test_sessions(spark, folder, tmp_path):
    got = run(S.idle_sessions(S.read_task_events(spark, folder[0]), "6 hours"), tmp_path).filter("task_id < 1000000")
    want = B.idle_sessions(batch(spark, folder), "6 hours")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_completions_once(spark, folder, tmp_path):
    events = S.read_task_events(spark, folder[0], late="60 days").filter("action = 'complete'")
    got = run(S.dedupe_completions(events, ["task_id", "pct"]), tmp_path)
    want = B.dedupe_completions(batch(spark, folder).filter("action = 'complete'"), ["task_id", "pct"])
    assert sorted((r.task_id, r.pct) for r in got.collect()) == sorted((r.task_id, r.pct) for r in want.collect())


def test_decisions(spark, folder, tmp_path):
    events = S.read_task_events(spark, folder[0])
    asks = events.filter("action = 'progress'").select(F.col("event_id").alias("req_event"), "task_id", F.col("ts").alias("asked_at"))
    answers = S.read_task_events(spark, folder[0])
    answers = answers.select(F.col("event_id").alias("resp_event"), "task_id", F.col("ts").alias("answered_at"), (F.col("event_id") % 3 != 0).alias("confirm"), "action")
    answers = answers.filter("action = 'resume' or task_id = 1000000000").drop("action")
    got = run(S.await_decision(asks, answers, 6 * 3600), tmp_path).filter("task_id < 1000000")
    b = batch(spark, folder)
    want = B.await_decision(
        b.filter("action = 'progress'").select(F.col("event_id").alias("req_event"), "task_id", F.col("ts").alias("asked_at")),
        b.filter("action = 'resume'").select(F.col("event_id").alias("resp_event"), "task_id", F.col("ts").alias("answered_at"), (F.col("event_id") % 3 != 0).alias("confirm")),
        6 * 3600,
    )
    key = lambda df: sorted((r.req_event, r.resp_event or -1, r.outcome) for r in df.collect())
    assert key(got) == key(want)


def test_machine_and_ring(spark, folder, tmp_path):
    got = run(S.task_machine(S.read_task_events(spark, folder[0], files=2)), tmp_path).filter("task_id < 1000000")
    want = B.task_machine(batch(spark, folder))
    cols = ["event_id", "before", "after", "accepted"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_idle_timers(spark, frame, tmp_path):
    rows = [
        (1, T0, 1, "start", 0, None), (2, T0, 2, "start", 0, None), (3, T0 + dt.timedelta(minutes=1), 2, "complete", 9, None),
        (4, T0 + dt.timedelta(minutes=2), 3, "start", 0, None),
    ]
    later = [(5, T0 + dt.timedelta(hours=1, minutes=1), 3, "progress", 5, None), (6, T0 + dt.timedelta(hours=1, minutes=30), 9, "progress", 5, None)]
    for part in (rows, later, [(7, T0 + dt.timedelta(hours=1, minutes=31), 9, "progress", 6, None)]):
        frame(part, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.idle_watch(S.read_task_events(spark, str(tmp_path / "in"), late="0 seconds"), 3600)
    got = run(stream, tmp_path)
    assert sorted((r.task_id, r.event) for r in got.collect()) == [(1, "paused"), (2, "expired")]


def test_snapshot_is_the_latest_state(spark, folder, tmp_path):
    states = S.task_state(S.read_task_events(spark, folder[0]))
    S.write_task_snapshot(states, str(tmp_path / "snap"), str(tmp_path / "cp")).awaitTermination()
    got = S.read_task_snapshot(spark, str(tmp_path / "snap")).filter("task_id < 1000000")
    want = B.task_state(batch(spark, folder))
    cols = ["task_id", "status", "pct", "log_line", "updated_at"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_ring_keeps_twenty_after_the_end(spark, frame, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=i), 1, "progress", i, f"line {i}") for i in range(600)]
    rows += [(600, T0 + dt.timedelta(seconds=600), 1, "start", 0, None), (601, T0 + dt.timedelta(seconds=601), 1, "complete", 0, "end")]
    frame(rows, S.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(S.log_ring(S.read_task_events(spark, str(tmp_path / "in"))), tmp_path, "update").first()
    assert got.n == 20 and got.lines[-1] == "end" and got.lines[0] == "line 581"
    assert B.log_ring(spark.createDataFrame(rows, S.EVENT_SCHEMA)).count() == 20


def test_snapshot_is_a_compacted_log(spark, frame, tmp_path):
    """Batches write their own tasks; bases replace them, one generation later; replays change nothing."""
    import os

    schema = "task_id bigint, status string, updated_at timestamp"
    path = str(tmp_path / "log")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    for n in range(7):
        rows = [(n % 3, f"s{n}", at(n)), (100 + n, "new", at(n))]
        frame(rows, schema).coalesce(1).write.parquet(f"{path}/changes={n}")
        if n % 2:
            S.compact_task_snapshot(spark, path, n)
            S.compact_task_snapshot(spark, path, n)
    assert sorted(os.listdir(path)) == ["base=3", "base=5", "changes=4", "changes=5", "changes=6"]
    want = [(0, "s6"), (1, "s4"), (2, "s5"), *((100 + n, "new") for n in range(7))]
    read = lambda: sorted((r.task_id, r.status) for r in S.read_task_snapshot(spark, path).collect())
    assert read() == want
    frame([(2, "s5", at(5)), (105, "new", at(5))], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/changes=5")
    S.compact_task_snapshot(spark, path, 5)
    assert read() == want
    with pytest.raises(ValueError):
        S.read_task_snapshot(spark, str(tmp_path / "none"))


def test_idle_watch_gets_one_row_for_each_task(spark, frame, tmp_path):
    """Events cross to the processor as packs, in order, with tasks and ids that are null and events without a time."""
    from bookweave.streaming.processors import ACTIONS, EVENT, packed

    rows = [(3, 30, 7, "complete"), (1, 10, 7, "start"), (None, 10, 7, "odd"), (2, 10, None, "start"), (4, 5, 8, None)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("event_id", "us", "task_id", "action"), r, strict=True)) for r in rows[a:b]], schema=pa.schema(
        [("event_id", pa.int64()), ("us", pa.int64()), ("task_id", pa.int64()), ("action", pa.string())])) for a, b in ((0, 2), (2, 2), (2, 5))]
    got = {r["task_id"]: np.frombuffer(r["events"], EVENT) for b in packed(iter(batches)) for r in b.to_pylist()}
    assert {k: x["us"].tolist() for k, x in got.items()} == {7: [10, 10, 30], 8: [5], None: [10]}
    assert got[7]["none"].tolist() == [0, 1, 0] and [ACTIONS[a] for a in got[7]["action"][[0, 2]]] == ["start", "complete"]
    assert got[7]["action"][1] == got[8]["action"][0] == 255 and list(packed(iter([]))) == []
    first = [(1, T0, 1, "start", 0, None), (2, None, 1, "complete", 0, None), (3, T0, 2, "start", 0, None), (4, T0 + dt.timedelta(hours=9), 9, "progress", 0, None)]
    late = [(5, T0, 2, "complete", 0, None), (6, T0 + dt.timedelta(hours=9, minutes=1), 9, "progress", 0, None)]
    for part in (first, late):
        frame(part, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.idle_watch(S.read_task_events(spark, str(tmp_path / "in"), late="0 seconds"), 3600)
    assert sorted((r.task_id, r.event) for r in run(stream, tmp_path).collect()) == [(1, "paused"), (2, "paused")]

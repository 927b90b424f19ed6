"""Busy tasks: everything of one hour spreads over ranges and equals a walk along the events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bookweave.operators import tasks as K

EVENTS = "event_id bigint, ts timestamp_ntz, task_id bigint, action string, pct bigint, log_line string"


@pytest.fixture(scope="module")
def busy(spark):
    """200,000 events of one task in one hour, some at the same time, beside small tasks and one without a name."""
    rnd = random.Random(6)
    actions = [*K.MOVES, "other", None]
    start = dt.datetime(2024, 1, 1, 10)
    rows = [(i, start + dt.timedelta(seconds=rnd.randrange(3600)), 1, rnd.choice(actions), rnd.randrange(3), None) for i in range(200_000)]
    rows = [(*r[:3], "progress" if r[3] == "delete" and r[0] < 199_000 else r[3], *r[4:]) for r in rows]
    rows += [(300_000 + i, start + dt.timedelta(minutes=i), rnd.choice([2, 3, None]), rnd.choice(actions), rnd.randrange(2), None) for i in range(60)]
    return rows, spark.createDataFrame(rows, EVENTS).repartition(8).cache()


def test_machine_equals_a_walk(busy):
    rows, events = busy
    want, status = {}, {}
    for i, _, task, action, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        before = status.get(task, "pending")
        status[task], ok = K.move(before, action)
        want[i] = (before, status[task], ok)
    out = K.task_machine(events)
    assert {r.event_id: (r.before, r.after, r.accepted) for r in out.collect()} == want


def test_a_busy_hour_is_many_ranges(busy):
    from bookweave.operators.ordered import range_carried

    _, events = busy
    rows = range_carried(events, "task_id", ["ts", "event_id"])
    sizes = rows.filter("task_id = 1 AND _own = 1").groupBy("_range").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 150_000
    assert rows.filter("_own = 0").count() <= 16


def test_changes_equal_a_walk(busy):
    rows, events = busy
    last, want = {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[2] not in last or last[r[2]] != r[4]:
            want.add(r[0])
        last[r[2]] = r[4]
    out = K.changed_only(events)
    assert {r.event_id for r in out.collect()} == want


def test_decisions_of_a_busy_task(spark, busy):
    rows, events = busy
    asks = events.filter("action = 'pause'").select("task_id", F.col("ts").alias("asked_at"), F.col("event_id").alias("req_event"))
    answers = events.filter("action = 'resume'").select("task_id", F.col("ts").alias("answered_at"), F.col("event_id").alias("resp_event"), (F.col("pct") > 0).alias("confirm"))
    want, ahead = {}, {}
    for i, ts, task, action, pct, _ in sorted((r for r in rows if r[3] in ("pause", "resume")), key=lambda r: (r[1], r[3] == "resume", r[0]), reverse=True):
        if action == "resume":
            ahead[task] = (ts, i, pct > 0)
        else:
            a = ahead.get(task)
            good = a and (a[0] - ts).total_seconds() <= 1
            want[i] = ((a[1], "confirmed" if a[2] else "declined") if good else (None, "timeout"))
    out = K.await_decision(asks, answers, 1)
    assert {r.req_event: (r.resp_event, r.outcome) for r in out.collect()} == want

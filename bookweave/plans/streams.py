"""Streams over the event table, run to the end and compared with their batch twins.

The event file is read as a stream with the clock of its rows; the result is written to a table in the
checkpoint folder and read back.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_folder
from ..streaming import tasks as S
from . import tasks as B
from .registry import query
from .views import Views

RAW = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _shape(raw: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = (
        F.when(kind == "signup", "start").when(kind == "view", "progress").when(kind == "click", "resume")
        .when(kind == "purchase", "complete").otherwise("pause")
    )
    whole = F.floor("value").cast("bigint")
    line = F.concat(F.lit("  "), kind, F.lit(" ["), (whole % 217).cast("string"), F.lit("/217]"))
    return raw.select(
        "event_id", "ts", F.col("user_id").alias("task_id"), action.alias("action"), (whole % 101).alias("pct"), line.alias("log_line"), kind.alias("kind")
    )


def _events(v: Views) -> DataFrame:
    _utc(v)
    return S.read_task_events(v.spark, v.path("events") + "*", RAW, shape=_shape)


def _utc(v: Views) -> None:
    v.spark.conf.set("spark.sql.session.timeZone", "UTC")  # the table has local timestamps


#: Task of the rows that stand behind all others, and how late a row of the table may come.
END, LATE = -(2**63), "36500 days"


def _finite(v: Views, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream with timers or windows gives over a finite table.

    It runs over the table, and then twice more over the same checkpoint with a row of the far future, which
    moves the watermark past the table's last row: whatever waits for time to pass is settled.  The watermark
    tolerates a century, so no file of the table comes late however the files are ordered.
    """
    _utc(v)
    base = f"{work_folder(v.spark)}/{uuid.uuid4().hex}"
    v.spark.createDataFrame([], RAW).write.parquet(f"{base}/ends")
    for end in (None, 1, 2):
        if end:
            row = (-end, datetime.datetime(2200, 1, end), END, "end", 0.0, None)
            v.spark.createDataFrame([row], RAW).coalesce(1).write.mode("append").parquet(f"{base}/ends")
        raw, ends = (v.spark.readStream.schema(RAW).parquet(p) for p in (v.path("events") + "*", f"{base}/ends"))
        rows = _shape(raw.unionByName(ends)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
        out = S.run_to_table(stream(rows), f"{base}/table", f"{base}/checkpoint")
    return out.filter(F.col("task_id") != END)


def _run(v: Views, stream: DataFrame) -> DataFrame:
    base = f"{work_folder(v.spark)}/{uuid.uuid4().hex}"
    return S.run_to_table(stream, f"{base}/table", f"{base}/checkpoint")


@query("stream_task_machine", B._MACHINE)
def stream_task_machine(v: Views):
    return _run(v, S.task_machine(_events(v).drop("kind")))


@query("stream_progress", "SELECT event_id, task_id, pct FROM task_events QUALIFY pct IS DISTINCT FROM lag(pct) OVER (PARTITION BY task_id ORDER BY ts, event_id)")
def stream_progress(v: Views):
    return _run(v, S.progress_stream(_events(v).drop("kind")))


@query("stream_log_ring", f"SELECT task_id, count(*) AS n, arg_min(log_line, back) AS last_line FROM ({B._RING}) GROUP BY task_id")
def stream_log_ring(v: Views):
    base = f"{work_folder(v.spark)}/{uuid.uuid4().hex}"
    out = S.run_to_table(S.log_ring(_events(v).drop("kind")), f"{base}/table", f"{base}/checkpoint", "update")
    return out.select("task_id", "n", F.element_at("lines", -1).alias("last_line"))


@query("stream_task_state", B._STATE.replace("min(ts) AS created_at, max(ts) AS updated_at", "epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us"))
def stream_task_state(v: Views):
    base = f"{work_folder(v.spark)}/{uuid.uuid4().hex}"
    S.write_task_snapshot(S.task_state(_events(v).drop("kind")), f"{base}/snapshot", f"{base}/checkpoint").awaitTermination()
    return S.read_task_snapshot(v.spark, f"{base}/snapshot").select(
        "task_id", "status", "pct", "log_line", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us")
    )


@query("stream_idle_watch", f"""SELECT task_id, CASE status WHEN 'running' THEN 'paused' ELSE 'expired' END AS event FROM (
    SELECT m.task_id, arg_max(m.after, (e.ts, e.event_id)) AS status FROM ({B._MACHINE}) m JOIN task_events e ON e.event_id = m.event_id GROUP BY m.task_id)
    WHERE status IN ('running', 'completed', 'failed', 'cancelled')""")
def stream_idle_watch(v: Views):
    return _finite(v, lambda events: S.idle_watch(events.drop("kind"), 12 * 3600)).select("task_id", "event")


@query("stream_await_decision", """SELECT req_event, task_id, CASE WHEN d <= 21600000000 THEN resp_event END AS resp_event, CASE WHEN d <= 21600000000 THEN CASE WHEN confirm THEN 'confirmed' ELSE 'declined' END ELSE 'timeout' END AS outcome FROM (
         SELECT q.req_event, q.task_id, a.resp_event, a.confirm, epoch_us(a.answered_at) - epoch_us(q.asked_at) AS d FROM confirm_requests q LEFT JOIN confirm_responses a ON a.task_id = q.task_id AND a.answered_at >= q.asked_at
         QUALIFY row_number() OVER (PARTITION BY q.req_event ORDER BY a.answered_at NULLS LAST, a.resp_event) = 1)""")
def stream_await_decision(v: Views):
    def decided(events: DataFrame) -> DataFrame:
        # Both sides keep the last rows, which their watermarks need.
        asks = events.filter(f"kind = 'view' OR task_id = {END}").select(F.col("event_id").alias("req_event"), "task_id", F.col("ts").alias("asked_at"))
        answers = events.filter(f"kind = 'click' OR task_id = {END}").select(
            F.col("event_id").alias("resp_event"), "task_id", F.col("ts").alias("answered_at"), (F.col("event_id") % 3 != 0).alias("confirm")
        )
        return S.await_decision(asks, answers, 6 * 3600)

    return _finite(v, decided)


@query("stream_dedupe_completions", "SELECT DISTINCT task_id, pct % 10 AS item FROM task_events WHERE action = 'complete'")
def stream_dedupe_completions(v: Views):
    def once(events: DataFrame) -> DataFrame:
        done = events.filter(f"action = 'complete' OR task_id = {END}").withColumn("item", F.col("pct") % 10)
        return S.dedupe_completions(done, ["task_id", "item"]).select("task_id", "item")

    return _finite(v, once)


@query(
    "stream_idle_sessions",
    """SELECT task_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS island FROM (
         SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh FROM task_events)) GROUP BY task_id, island""",
)
def stream_idle_sessions(v: Views):
    out = _finite(v, lambda events: S.idle_sessions(events, "6 hours"))
    return out.select("task_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")

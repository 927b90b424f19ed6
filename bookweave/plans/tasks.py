"""Task event queries, the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks as K
from .registry import query
from .views import Views

_STATUS = "CASE action WHEN 'start' THEN 'running' WHEN 'resume' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'pause' THEN 'paused' END"
_STATE = f"""SELECT task_id, arg_max({_STATUS}, (ts, event_id)) FILTER ({_STATUS} IS NOT NULL) AS status, arg_max(pct, (ts, event_id)) AS pct, arg_max(log_line, (ts, event_id)) AS log_line, min(ts) AS created_at, max(ts) AS updated_at FROM task_events GROUP BY task_id"""


@query("read_task_events", "SELECT event_id, ts, task_id, action, pct, log_line FROM task_events")
def read_task_events(v: Views):
    return v.task_events


@query("task_state", _STATE)
def task_state(v: Views):
    return K.task_state(v.task_events)


def _now(v: Views):
    return v.task_events.agg(F.max("ts")).scalar()


_NOW = "(SELECT max(ts) FROM task_events)"


@query("active_tasks", f"SELECT task_id, status FROM ({_STATE.replace('running', 'pending')}) WHERE status IN ('pending', 'running')")
def active_tasks(v: Views):
    s = K.task_state(v.task_events).select("task_id", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")).alias("status"))
    return K.active_tasks(s)


@query("terminal_tasks", f"SELECT task_id, status FROM ({_STATE}) WHERE status IN ('completed', 'failed', 'cancelled')")
def terminal_tasks(v: Views):
    return K.terminal_tasks(K.task_state(v.task_events)).select("task_id", "status")


_MACHINE = """WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS rn FROM task_events),
    walk(task_id, rn, event_id, action, before, after, accepted) AS (
      SELECT task_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', 'pending', false FROM (SELECT DISTINCT task_id FROM ev)
      UNION ALL
      SELECT e.task_id, e.rn, e.event_id, e.action, w.after,
             CASE WHEN e.action = 'start' THEN 'running' WHEN e.action = 'resume' AND w.after = 'paused' THEN 'running' WHEN e.action = 'pause' AND w.after = 'running' THEN 'paused' WHEN e.action = 'complete' AND w.after = 'running' THEN 'completed' ELSE w.after END,
             CASE e.action WHEN 'start' THEN w.after <> 'running' WHEN 'resume' THEN w.after = 'paused' WHEN 'progress' THEN true ELSE w.after = 'running' END
      FROM walk w JOIN ev e ON e.task_id = w.task_id AND e.rn = w.rn + 1)
    SELECT event_id, task_id, action, before, after, accepted FROM walk WHERE rn > 0"""


@query("task_machine", _MACHINE)
def task_machine(v: Views):
    return K.task_machine(v.task_events)


@query("recent_tasks", f"SELECT task_id, created_at FROM ({_STATE}) ORDER BY created_at DESC, task_id LIMIT 5")
def recent_tasks(v: Views):
    return K.recent_tasks(K.task_state(v.task_events), 5).select("task_id", "created_at")


_LOGS = "SELECT task_id, event_id, log_line, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS back FROM task_events"


@query("last_logs", f"SELECT * FROM ({_LOGS}) WHERE back <= 5")
def last_logs(v: Views):
    return K.last_logs(v.task_events).select("task_id", "event_id", "log_line", "back")


_RING = f"""SELECT l.* FROM ({_LOGS}) l LEFT JOIN (
    SELECT task_id, least(500, least(20, count(*) - count(*) FILTER (rn > cut)) + count(*) FILTER (rn > cut)) AS left_ FROM (
      SELECT task_id, rn, max(CASE WHEN after IN ('completed', 'failed', 'cancelled') THEN rn END) OVER (PARTITION BY task_id) AS cut
      FROM (SELECT m.*, row_number() OVER (PARTITION BY m.task_id ORDER BY e.ts, e.event_id) AS rn FROM ({_MACHINE}) m JOIN task_events e ON e.event_id = m.event_id))
    WHERE cut IS NOT NULL GROUP BY task_id) c USING (task_id) WHERE back <= coalesce(left_, 500)"""


@query("log_ring", _RING)
def log_ring(v: Views):
    return K.log_ring(v.task_events).select("task_id", "event_id", "log_line", "back")


@query(
    "pause_stale",
    f"SELECT task_id, CASE WHEN stale THEN 'paused' ELSE status END AS status, stale AS restart_paused FROM (SELECT *, coalesce(status = 'running' AND {_NOW} > updated_at + INTERVAL 12 HOUR, false) AS stale FROM ({_STATE}))",
)
def pause_stale(v: Views):
    return K.pause_stale(K.task_state(v.task_events), _now(v), 12 * 3600).select("task_id", "status", "restart_paused")


@query("expire_terminal", f"SELECT task_id, status FROM ({_STATE}) WHERE NOT coalesce(status IN ('completed', 'failed', 'cancelled') AND {_NOW} > updated_at + INTERVAL 12 HOUR, false)")
def expire_terminal(v: Views):
    return K.expire_terminal(K.task_state(v.task_events), _now(v), 12 * 3600).select("task_id", "status")


@query(
    "progress_eta",
    """SELECT event_id, task_id, cur, CAST(217 AS BIGINT) AS tot, CAST(floor(CAST(cur AS DOUBLE) / 217 * 100) AS BIGINT) AS pct, CASE WHEN cur > 1 AND el > 5 THEN (217 - cur) * el / cur END AS eta FROM (
         SELECT event_id, task_id, CAST(regexp_extract(log_line, '\\[(\\d+)/217\\]', 1) AS BIGINT) AS cur, CAST(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY task_id)) AS DOUBLE) / 1000000.0::DOUBLE AS el FROM task_events) WHERE cur > 0""",
)
def progress_eta(v: Views):
    return K.progress_eta(v.task_events)


@query("changed_only", "SELECT event_id, task_id, pct FROM task_events QUALIFY pct IS DISTINCT FROM lag(pct) OVER (PARTITION BY task_id ORDER BY ts, event_id)")
def changed_only(v: Views):
    return K.changed_only(v.task_events).select("event_id", "task_id", "pct")


@query(
    "await_decision",
    """SELECT req_event, task_id, CASE WHEN d <= 21600000000 THEN resp_event END AS resp_event, CASE WHEN d <= 21600000000 THEN CASE WHEN confirm THEN 'confirmed' ELSE 'declined' END ELSE 'timeout' END AS outcome FROM (
         SELECT q.req_event, q.task_id, a.resp_event, a.confirm, epoch_us(a.answered_at) - epoch_us(q.asked_at) AS d FROM confirm_requests q LEFT JOIN confirm_responses a ON a.task_id = q.task_id AND a.answered_at >= q.asked_at
         QUALIFY row_number() OVER (PARTITION BY q.req_event ORDER BY a.answered_at NULLS LAST, a.resp_event) = 1)""",
)
def await_decision(v: Views):
    return K.await_decision(v.confirm_requests, v.confirm_responses, 6 * 3600)


@query(
    "dedupe_completions",
    "SELECT event_id, task_id, pct FROM task_events WHERE action = 'complete' QUALIFY row_number() OVER (PARTITION BY task_id, pct % 10 ORDER BY ts, event_id) = 1",
)
def dedupe_completions(v: Views):
    done = v.task_events.filter("action = 'complete'").withColumn("item", F.col("pct") % 10)
    return K.dedupe_completions(done, ["task_id", "item"]).select("event_id", "task_id", "pct")


@query(
    "idle_sessions",
    """SELECT task_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS island FROM (
         SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh FROM task_events)) GROUP BY task_id, island""",
)
def idle_sessions(v: Views):
    return K.idle_sessions(v.task_events, "6 hours")

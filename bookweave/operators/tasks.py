"""Task events in batch: states, logs, progress, waits.

These are the batch twins of :mod:`bookweave.streaming`.  Task events are (event_id, ts, task_id,
action, pct, log_line).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import is_noise, parse_progress
from .ordered import range_carried, top_per_group

# Statuses, and the moves between them.
STATUSES = ["pending", "running", "paused", "completed", "failed", "cancelled", "deleted"]
ACTIVE = ["pending", "running"]
TERMINAL = ["completed", "failed", "cancelled"]
LIVE = ["pending", "running", "paused", "completed", "failed", "cancelled"]
MOVES = {
    "start": ([s for s in LIVE if s != "running"], "running"),
    "pause": (["running"], "paused"),
    "resume": (["paused"], "running"),
    "cancel": (["pending", "running", "paused"], "cancelled"),
    "complete": (["running"], "completed"),
    "fail": (["running"], "failed"),
    "retry": (LIVE, "pending"),
    "delete": ([s for s in LIVE if s != "running"], "deleted"),
    "progress": (LIVE, None),
}
LOGS_ACTIVE, LOGS_TERMINAL, LOGS_LIST = 500, 20, 5


def move(status: str, action: str) -> tuple[str, bool]:
    """(new status, accepted) of one action."""
    allowed, target = MOVES.get(action, ([], None))
    return (target or status, True) if status in allowed else (status, False)


def status_of(action: str | Column) -> Column:
    """Status an action leads to when it is legal, NULL for actions that keep it."""
    c = F.col(action) if isinstance(action, str) else action
    out = F.lit(None).cast("string")
    for name, (_, target) in MOVES.items():
        if target:
            out = F.when(c == name, target).otherwise(out)
    return out


def active_tasks(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status").isin(ACTIVE))


def terminal_tasks(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status").isin(TERMINAL))


# ---------------------------------------------------------------- state


def task_state(events: DataFrame) -> DataFrame:
    """Latest value of every field per task; a plain aggregate, so combined before the shuffle."""
    at = F.struct("ts", "event_id")

    def latest(c: Column) -> Column:
        return F.max_by(c, F.when(c.isNotNull(), at))

    return events.groupBy("task_id").agg(
        latest(status_of("action")).alias("status"),
        latest(F.col("pct")).alias("pct"),
        latest(F.col("log_line")).alias("log_line"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


#: A map over the statuses as one number: three bits, the status it leads to, for each status.
BITS = 3
IDENTITY = sum(i << BITS * i for i in range(len(STATUSES)))


def _moved(action: str | None) -> tuple[list[int], list[bool]]:
    """Where an action leads from each status, and whether it is accepted there."""
    both = [move(s, action or "") for s in STATUSES]
    return [STATUSES.index(s) for s, _ in both], [ok for _, ok in both]


def _extended(code: int, action: str | None) -> tuple[int, int]:
    """A map followed by an action, and the statuses (as bits) from whose way the action is accepted."""
    leads, allowed = _moved(action)
    at = [code >> BITS * i & 7 for i in range(len(STATUSES))]
    return sum(leads[x] << BITS * i for i, x in enumerate(at)), sum(allowed[x] << i for i, x in enumerate(at))


def task_machine(events: DataFrame, initial: str = "pending") -> DataFrame:
    """Events with the status before and after and whether the move was ``accepted``.

    Events are dealt by ranges of (task, time), so a busy task spans many ranges of even size.  One pass over
    a range composes the maps of its events over the seven statuses; the map of a range's last task goes on
    to the later ranges.  A second pass chains the maps that reach a task's part of a range, which gives the
    status it starts in, and reads its events' maps with it.
    """
    order = ["ts", "event_id"]
    rows = events.select("task_id", *order, "action")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, code, met = object(), IDENTITY, {}
        for batch in batches:
            before, after, ok = [], [], []
            for t, action in zip(batch.column("task_id").to_pylist(), batch.column("action").to_pylist(), strict=True):
                if t != task:
                    task, code = t, IDENTITY
                way = met.get((code, action))
                if way is None:
                    way = met[code, action] = _extended(code, action if action in MOVES else None)
                before.append(code)
                code = way[0]
                after.append(code)
                ok.append(way[1])
            made = [pa.array(x, pa.int32()) for x in (before, after, ok)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_before", "_after", "_ok"])

    carried = range_carried(rows, "task_id", order, step=composed, schema=f"{kinds}, _before int, _after int, _ok int")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = carried.repartition(parts, "task_id", "_range").sortWithinPartitions("task_id", "_range", "_own", "_from", *order)
    first, names = STATUSES.index(initial), np.array(STATUSES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, entry = object(), first
        for batch in batches:
            tasks, ranges = batch.column("task_id").to_pylist(), batch.column("_range").to_pylist()
            own, maps = batch.column("_own").to_numpy(), batch.column("_after").to_numpy()
            entries = np.full(len(own), -1, np.int32)
            for i in range(len(own)):
                if (tasks[i], ranges[i]) != place:
                    place, entry = (tasks[i], ranges[i]), first
                if own[i]:
                    entries[i] = entry
                else:
                    entry = int(maps[i]) >> BITS * entry & 7
            kept = batch.filter(pa.array(own == 1))
            at = entries[own == 1]
            before, after, ok = (kept.column(c).to_numpy() for c in ("_before", "_after", "_ok"))
            status = [pa.array(names[x >> BITS * at & 7].tolist(), pa.string()) for x in (before, after)]
            accepted = pa.array((ok >> at & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([kept.column("task_id"), kept.column("event_id"), kept.column("action"), *status, accepted], ["task_id", "event_id", "action", "before", "after", "accepted"])

    types = dict(rows.dtypes)
    return met.mapInArrow(read, f"task_id {types['task_id']}, event_id {types['event_id']}, action string, before string, after string, accepted boolean")


def recent_tasks(states: DataFrame, n: int) -> DataFrame:
    return states.orderBy(F.desc("created_at"), "task_id").limit(n)


def last_logs(events: DataFrame, n: int = LOGS_LIST) -> DataFrame:
    """Last ``n`` log lines per task, newest first in ``back``; noise lines are not logged."""
    logged = events.filter(F.col("log_line").isNotNull() & ~is_noise("log_line"))
    return top_per_group(logged, ["task_id"], [F.desc("ts"), F.desc("event_id")], n, "back")


def log_ring(events: DataFrame) -> DataFrame:
    """What is left of every task's log: 500 lines; a line logged after the task has ended cuts it to 20.

    Counts are aggregates: lines up to the last one logged in an ended status, and lines after it.
    """
    logged = events.filter(F.col("log_line").isNotNull() & ~is_noise("log_line"))
    at = F.struct("ts", "event_id")
    after = task_machine(events).select("event_id", "task_id", F.col("after").isin(TERMINAL).alias("_ended"))
    marked = logged.join(after, ["event_id", "task_id"]).select("task_id", at.alias("_at"), "_ended")
    cuts = marked.filter("_ended").groupBy("task_id").agg(F.max("_at").alias("_cut"))
    later = F.count(F.when(F.col("_at") > F.col("_cut"), 1))
    limits = marked.join(cuts, "task_id").groupBy("task_id").agg(
        F.least(F.lit(LOGS_ACTIVE), F.least(F.lit(LOGS_TERMINAL), F.count("*") - later) + later).alias("_left")
    )
    kept = last_logs(events, LOGS_ACTIVE).join(limits, "task_id", "left")
    return kept.filter(F.col("back") <= F.coalesce("_left", F.lit(LOGS_ACTIVE))).drop("_left")


def _idle(states: DataFrame, now: Column, seconds: int) -> Column:
    return now > F.col("updated_at") + F.make_interval(secs=F.lit(seconds))


def pause_stale(states: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Running tasks idle for longer are paused and flagged."""
    stale = (F.col("status") == "running") & _idle(states, now, seconds)
    return states.withColumn("restart_paused", F.coalesce(stale, F.lit(False))).withColumn(
        "status", F.when(F.col("restart_paused"), "paused").otherwise(F.col("status"))
    )


def expire_terminal(states: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Drop ended tasks idle for longer."""
    gone = F.col("status").isin(TERMINAL) & _idle(states, now, seconds)
    return states.filter(~F.coalesce(gone, F.lit(False)))


# ---------------------------------------------------------------- progress


def progress_eta(
    events: DataFrame, line: str = "log_line", total_pages: Column | None = None
) -> DataFrame:
    """Progress of each line that shows one: cur, tot, pct and remaining seconds."""
    p = events.withColumn("_p", parse_progress(line, total_pages)).filter((F.col("_p.tot") > 0) & (F.col("_p.cur") > 0))
    begun = p.join(events.groupBy("task_id").agg(F.min("ts").alias("_t0")), "task_id")
    cur, tot = F.col("_p.cur"), F.col("_p.tot")
    elapsed = seconds_between(F.col("_t0"), F.col("ts"))
    eta = F.when((cur > 1) & (elapsed > 5), (tot - cur) * elapsed / cur)
    return begun.filter((tot > 0) & (cur > 0)).select(
        "event_id", "task_id", cur.alias("cur"), tot.alias("tot"),
        F.floor(cur / tot * 100).cast("bigint").alias("pct"), eta.alias("eta"),
    )


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def eta_by_bytes(total: Column, done: Column, speed: Column) -> Column:
    """Remaining seconds from a transfer's speed, NULL while nothing moves."""
    return F.when(speed > 0, (total - done) / speed)


def changed_only(events: DataFrame, value: str = "pct") -> DataFrame:
    """Events whose value differs from the task's previous one; a busy task spans many ranges of its time."""
    order = ["ts", "event_id"]
    along = Window.partitionBy("task_id", "_range").orderBy("_own", "_from", *order)
    out = range_carried(events, "task_id", order).withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(along))
    return out.filter((F.col("_own") == 1) & ~F.col(value).eqNullSafe(F.col("_before.v"))).select(*events.columns)


# ---------------------------------------------------------------- waits, copies, sessions


def await_decision(requests: DataFrame, responses: DataFrame, seconds: int = 300) -> DataFrame:
    """First answer to each request within the limit: confirmed, declined or timeout.

    Both sides run along the time of their task once, so a task with many requests and answers never
    pairs them all; a busy task spans many ranges of its time.
    """
    asks = requests.select("task_id", F.col("asked_at").alias("ts"), F.lit(False).alias("answers"), F.col("req_event").alias("event"), F.lit(None).cast("boolean").alias("confirm"))
    answers = responses.select("task_id", F.col("answered_at").alias("ts"), F.lit(True).alias("answers"), F.col("resp_event").alias("event"), "confirm")
    both = range_carried(asks.unionByName(answers), "task_id", ["ts", "answers", "event"], forward=False, among="answers")
    # Backwards in time: the copies from later ranges, the nearest last, then a range's own rows.
    along = Window.partitionBy("task_id", "_range").orderBy("_own", F.desc("_from"), F.desc("ts"), F.desc("answers"), F.desc("event"))
    out = both.withColumn("_a", F.last(F.when(F.col("answers"), F.struct("ts", "event", "confirm")), ignorenulls=True).over(along))
    in_time = seconds_between(F.col("ts"), F.col("_a.ts")) <= seconds
    return out.filter((F.col("_own") == 1) & ~F.col("answers")).select(
        F.col("event").alias("req_event"), "task_id",
        F.when(in_time, F.col("_a.event")).alias("resp_event"),
        F.when(in_time & F.col("_a.confirm"), "confirmed").when(in_time, "declined").otherwise("timeout").alias("outcome"),
    )


def dedupe_completions(events: DataFrame, key: list[str]) -> DataFrame:
    """First event of every completed item."""
    return top_per_group(events, key, [F.col("ts"), F.col("event_id")])


def idle_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Activity of a task cut where it stays silent for ``gap``.

    With ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` (one of the library's settings) sessions
    are merged inside the upstream tasks first, so a busy task arrives as a few sessions.
    """
    w = F.session_window("ts", gap)
    return events.groupBy("task_id", w).agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts")
    ).select("task_id", F.col("session_window.start").alias("first_ts"), "last_ts", "n")

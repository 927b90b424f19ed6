"""Keyed state of one task: what the stateful streams keep and emit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tasks import LOGS_ACTIVE, LOGS_TERMINAL, MOVES, TERMINAL, move


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The key's rows of this micro-batch by event time; the source limits how many there are."""
    return pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")


def _given(value) -> bool:
    return value is not None and value == value


class Machine(StatefulProcessor):
    """Every event with the status before and after it; ``accepted`` is false for illegal moves."""

    def __init__(self, initial: str = "pending"):
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status = self.state.get()[0] if self.state.exists() else self.initial
        events, out = _in_order(rows), []
        for r in events.itertuples():
            after, ok = move(status, r.action)
            out.append((r.event_id, key[0], r.action, status, after, ok))
            status = after
        self.state.update((status,))
        yield pd.DataFrame(out, columns=["event_id", "task_id", "action", "before", "after", "accepted"])

    def close(self) -> None:
        pass


class LogRing(StatefulProcessor):
    """Last log lines: 500 while the task is active, 20 once it has ended; the cut happens on appending."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "line string")
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status = self.status.get()[0] if self.status.exists() else "pending"
        kept = [x[0] for x in self.lines.get()] if self.lines.exists() else []
        for r in _in_order(rows).itertuples():
            status = move(status, r.action)[0]
            if _given(r.log_line):
                limit = LOGS_TERMINAL if status in TERMINAL else LOGS_ACTIVE
                kept = [*kept, r.log_line][-limit:]
        self.lines.put([(x,) for x in kept])
        self.status.update((status,))
        yield pd.DataFrame({"task_id": [key[0]], "n": [len(kept)], "lines": [kept]})

    def close(self) -> None:
        pass


#: An event of a pack: time, whether it has no id, id, and action as a place in ``ACTIONS`` (others change nothing).
EVENT = np.dtype([("us", "<i8"), ("none", "u1"), ("id", "<i8"), ("action", "u1")])
ACTIONS = list(MOVES)
#: Rows sorted at a time.
PACK = 1 << 20


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events (event_id, us, task_id, action) as one row for each task of up to ``PACK`` rows: crossing over to a
    processor costs by the row."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK:
            yield _pack(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _pack(pa.Table.from_batches(held))


def _pack(rows: pa.Table) -> pa.RecordBatch:
    whole = lambda c: rows.column(c).combine_chunks()
    events = np.empty(len(rows), EVENT)
    events["us"], events["none"], events["id"] = whole("us").to_numpy(), whole("event_id").is_null().to_numpy(False), whole("event_id").fill_null(0).to_numpy()
    events["action"] = pc.index_in(whole("action"), pa.array(ACTIONS)).fill_null(255).to_numpy()
    key, none = whole("task_id").fill_null(0).to_numpy(), whole("task_id").is_null().to_numpy(False)
    order = np.lexsort((events["id"], events["none"], events["us"], key, none))
    events, key, none = events[order], key[order], none[order]
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (none[1:] != none[:-1])]))
    offsets = (np.append(begin, len(events)) * EVENT.itemsize).astype(np.int32)
    packs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(events.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(key[begin], mask=none[begin]), packs], ["task_id", "events"])


class IdleWatch(StatefulProcessor):
    """Event-time timers: running tasks are paused, ended ones expire, after ``seconds`` without events.  Rows are packs,
    without a column of event time, so late events, those not after the watermark, are dropped here.  A waiting task has
    one timer, ``seconds`` after its last event."""

    def __init__(self, seconds: int = 3600):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("idle", "status string, last_ms bigint")

    @staticmethod
    def _waits(status: str) -> bool:
        return status == "running" or status in TERMINAL

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = np.concatenate([np.frombuffer(r.events, EVENT) for r in rows])
        events = events[events["us"] > timerValues.getCurrentWatermarkInMs() * 1000]
        if not len(events):
            return iter(())
        events = events[np.lexsort((events["id"], events["none"], events["us"]))]
        old = self.state.get()
        status, last = old or ("pending", 0)
        for action in events["action"].tolist():
            status = move(status, ACTIONS[action])[0] if action < len(ACTIONS) else status
        last = max(last, int(events["us"][-1]) // 1000)
        self.state.update((status, last))
        before = old[1] if old and self._waits(old[0]) else None
        after = last if self._waits(status) else None
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before + self.millis)
            if after is not None:
                self.handle.registerTimer(after + self.millis)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, last = self.state.get()
        if status == "running":
            self.state.update(("paused", last))
            event = "paused"
        else:
            self.state.clear()
            event = "expired"
        yield Row(task_id=key[0], event=event, last_ms=last)

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Events whose percentage differs from the task's last one; NULL is a value of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pct", "pct bigint, known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, known = self.state.get() if self.state.exists() else (None, False)
        out = []
        for r in _in_order(rows).itertuples():
            pct = int(r.pct) if _given(r.pct) else None
            if pct != last or not known:
                out.append((r.event_id, key[0], pct))
                last, known = pct, True
        self.state.update((last, known))
        yield pd.DataFrame(out, columns=["event_id", "task_id", "pct"]).astype({"pct": "Int64"})

    def close(self) -> None:
        pass

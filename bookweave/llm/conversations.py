"""Repair of conversations: turns aligned with the grammar of alternating roles.

A conversation's roles should spell ``(s?(ua)+)?``: maybe a system turn, then user and assistant in turn.
Turns are kept (0), given the other role (1), deleted (2; blank and repeated ones must be) or inserted
without text (5); a truncated turn that isn't deleted adds 5.  The rows, range-partitioned and sorted by
conversation and turn, are cut into segments of at most ``SEGMENT`` turns, so a conversation of any length is
spread over tasks.  Within a segment the turns are aligned with the alternating string of every feasible
length (Wagner-Fischer; the strings share their tails, so one table holds all lengths), for each state of
the grammar before and after the segment.  Ukkonen bands keep the table to cells that an alignment within
the incumbent cost can pass; the incumbent is doubled until it holds.  Where lengths tie, their audits are
traced back and compared.  A segment gives a matrix of (cost, least audit) between states; the matrices of a
conversation are combined in order, least cost first, then least audit (audits of equal cost over the same
turns are never prefixes of each other, so parts can be compared on their own).

Defined results: a null in any column counts as one space (``conv_id`` itself stays null in results, its rows
are one conversation); turns are ordered by turn (nulls first), role and text, so repeated rows are adjacent;
an empty role has no initial; a conversation without rows has an empty audit; other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT = 256
#: Faults of a turn; a blank or repeated one has to be deleted.
FINE, BLANK, REPEATED, CUT = range(4)
#: States of the grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
NEVER = 1 << 30
#: Stands for the initial of an empty role.
NONE = "\0"
SPACE = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage by crc32 of ``conv_id:turn`` modulo 20."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).cast("int")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), plain("role").alias("role"), plain("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``fault``, the first that a turn has."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(seen, REPEATED).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    return turns.withColumn("fault", fault)


class Alignment:
    """Turns, given by role initials and faults, against every alternating string that ends in ``last``.

    ``cost(i, k)``: least cost of aligning the turns from i on with the last k characters."""

    def __init__(self, initials: str, faults: bytes, last: str, incumbent: int):
        self.initials, self.faults, self.last, self.most = initials, faults, last, incumbent
        n = len(initials)
        self.rows: list[list[int]] = [[]] * (n + 1)
        self.lows = [0] * (n + 1)
        for i in range(n, -1, -1):
            # Beyond the band the deletions or insertions alone cost more than the incumbent.
            low, high = max(0, n - i - incumbent // DELETE), n - i + incumbent // INSERT
            self.lows[i] = low
            row: list[int] = []
            for k in range(low, high + 1):
                best = INSERT * k if i == n else DELETE + self.cost(i + 1, k)
                if i < n and k:
                    best = min(best, self.step(i, self.letter(k)) + self.cost(i + 1, k - 1))
                if k > low:
                    best = min(best, INSERT + row[-1])
                row.append(best)
            self.rows[i] = row

    def letter(self, k: int) -> str:
        """The k-th character from the end."""
        return self.last if k % 2 else "ua"[self.last == "u"]

    def cost(self, i: int, k: int) -> int:
        at = k - self.lows[i]
        return self.rows[i][at] if 0 <= at < len(self.rows[i]) else NEVER

    def step(self, i: int, letter: str) -> int:
        """Cost of turn i as ``letter``."""
        fault = self.faults[i]
        if fault in (BLANK, REPEATED):
            return NEVER
        return (KEEP if self.initials[i] == letter else REROLE) + TRUNCATED * (fault == CUT)

    def audit(self, i: int, k: int) -> str:
        """The least audit of least cost from turn i on, over the last k characters."""
        out, n = [], len(self.initials)
        while i < n or k:
            cost = self.cost(i, k)
            if i < n and cost == DELETE + self.cost(i + 1, k):
                out.append("D")
                i += 1
            elif k and cost == INSERT + self.cost(i, k - 1):
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.initials[i] == self.letter(k) else "R")
                i, k = i + 1, k - 1
        return "".join(out)

    def best(self, first: str) -> tuple[int, list[int]]:
        """Least cost over the lengths whose string begins with ``first``, and those lengths."""
        from_ = 1 if first == self.last else 2
        costs = {k: self.cost(0, k) for k in range(from_, self.lows[0] + len(self.rows[0]), 2)}
        least = min(costs.values(), default=NEVER)
        return least, [k for k, c in costs.items() if c == least]


@lru_cache(1 << 16)
def transfer(initials: str, faults: bytes) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, least audit) of the turns between each state before and each state after them."""
    n = len(initials)
    none = (DELETE * n, "D" * n)
    out = {(e, e): none for e in (START, SYSTEM, USER, ASSISTANT)}
    incumbent = 8
    while True:
        tables = {USER: Alignment(initials, faults, "u", incumbent), ASSISTANT: Alignment(initials, faults, "a", incumbent)}
        found = {(first, x): t.best(first) for x, t in tables.items() for first in "ua"}
        if max(c for c, _ in found.values()) <= incumbent:
            break
        incumbent *= 2
    for (first, x), (cost, lengths) in found.items():
        way = cost, min(tables[x].audit(0, k) for k in lengths)
        for e in (s for s, letter in NEXT.items() if letter == first):
            out[e, x] = min(out.get((e, x), (NEVER, "")), way)
    for r, initial in enumerate(initials):
        if initial != "s" or faults[r] in (BLANK, REPEATED):
            continue
        before, lead = DELETE * r + TRUNCATED * (faults[r] == CUT), "D" * r + "K"
        ends = [(SYSTEM, DELETE * (n - r - 1), "D" * (n - r - 1))]
        for x, t in tables.items():
            lengths = range(1 if x == USER else 2, t.lows[r + 1] + len(t.rows[r + 1]), 2)
            least = min((t.cost(r + 1, k) for k in lengths), default=NEVER)
            if before + least <= out[START, x][0]:
                ends.append((x, least, min(t.audit(r + 1, k) for k in lengths if t.cost(r + 1, k) == least)))
        for x, cost, rest in ends:
            out[START, x] = min(out.get((START, x), (NEVER, "")), (before + cost, lead + rest))
    return out


def combined(parts: Iterator[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its segments in order; it ends at the start or after assistant."""
    at = {START: (0, "")}
    for m in parts:
        after: dict[int, tuple[int, str]] = {}
        for (e, x), (cost, audit) in m.items():
            if e in at:
                way = at[e][0] + cost, at[e][1] + audit
                after[x] = min(after.get(x, way), way)
        at = after
    return min(at[x] for x in (START, ASSISTANT) if x in at)


def illegal(initials: str) -> int:
    """Neighbours that the grammar doesn't have."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


TURNS = "array<struct<turn: long, role: string, text: string>>"
WAYS = "array<struct<before: int, after: int, cost: long, audit: string>>"
SEGMENTS = f"conv_id long, part int, k int, initials string, faults binary, turns {TURNS}, ways {WAYS}, first_turn long, last_turn long, n_turns long, n_illegal long"


def _segments(turns: DataFrame, size: int) -> DataFrame:
    """Runs of at most ``size`` turns of one conversation, in order of (part, k); a conversation whose rows
    are all gone has one without turns."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("gone"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault") == REPEATED]
    dealt = written(turns, "turns").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        conv, held, out, began = None, [], [], False

        def close() -> None:
            nonlocal k, held
            known = [t for t, *_ in held if t is not None]
            initials, found = "".join(r[:1] or NONE for _, r, _, _ in held), bytes(f for *_, f in held)
            ways = [{"before": e, "after": x, "cost": c, "audit": a} for (e, x), (c, a) in transfer(initials, found).items()]
            own = [{"turn": t, "role": r, "text": x} for t, r, x, _ in held]
            ends = (known[0], known[-1]) if known else (None, None)
            out.append((conv, part, k, initials, found, own, ways, *ends, len(set(known)), illegal(initials)))
            k, held = k + 1, []

        def rows() -> pa.RecordBatch:
            schema = _arrow_schema()
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for c, gone, turn, role, text, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "gone", "turn", "role", "text", "fault")), strict=True):
                if not began or c != conv or len(held) == size:
                    if began and (held or c != conv):
                        close()
                    began, conv = True, c
                if not gone:
                    held.append((turn, role, text, fault))
            if out:
                yield rows()
        if began:
            close()
            yield rows()

    return dealt.mapInArrow(cut, SEGMENTS)


def _arrow_schema() -> pa.Schema:
    turn = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    way = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    names = ("conv_id", "part", "k", "initials", "faults", "turns", "ways", "first_turn", "last_turn", "n_turns", "n_illegal")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(turn), pa.list_(way), *[pa.int64()] * 4]
    return pa.schema(list(zip(names, kinds, strict=True)))


AUDITS = "conv_id long, part int, k int, letters string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _judged(segments: DataFrame) -> DataFrame:
    """The letters of each segment's turns, and on a conversation's last segment its counts, cost and audit."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = segments.drop("turns")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> list[tuple]:
            cost, audit = combined({(w["before"], w["after"]): (w["cost"], w["audit"]) for w in s["ways"]} for s in held)
            faulty = [sum(s["faults"].count(f) for s in held) for f in (BLANK, REPEATED, CUT)]
            full = [s for s in held if s["initials"]]
            bad = sum(s["n_illegal"] for s in full) + sum(illegal(a["initials"][-1] + b["initials"][0]) for a, b in zip(full, full[1:]))
            known = [s for s in full if s["n_turns"]]
            different = sum(s["n_turns"] for s in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
            gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - different if known else 0
            out, at = [], 0
            for s in held:
                left, begin = len(s["initials"]), at
                while left:
                    left -= audit[at] != "I"
                    at += 1
                if s is held[-1]:
                    at = len(audit)
                counts = (gaps, *faulty, bad, cost, audit) if s is held[-1] else (None,) * 7
                out.append((s["conv_id"], s["part"], s["k"], audit[begin:at], *counts))
            held.clear()
            return out

        def rows(made: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in AUDITS.split(", ")])

        for batch in batches:
            made = []
            for s in batch.to_pylist():
                if held and held[-1]["conv_id"] != s["conv_id"]:
                    made += close()
                held.append(s)
            if made:
                yield rows(made)
        if held:
            yield rows(close())

    return own.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "k").mapInArrow(fold, AUDITS)


REPAIRED = "conv_id long, pos long, turn long, role string, text string, edit string"


def _edited(segments: DataFrame, letters: DataFrame) -> DataFrame:
    """Turns in order with their edits (D: deleted, no ``pos``), a conversation's within one partition."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each segment's letters come in front of its turns, so that one shuffle does instead of a join's two.
    both = segments.select("conv_id", "part", "k", "turns", F.lit(None).cast("string").alias("letters")).unionByName(
        letters.select("conv_id", "part", "k", F.lit(None).cast(TURNS).alias("turns"), "letters")
    )
    dealt = both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "k", F.col("turns").isNotNull())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, pos, own = object(), START, 0, ""
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if s["conv_id"] != conv:
                    conv, state, pos = s["conv_id"], START, 0
                if s["turns"] is None:
                    own = s["letters"]
                    continue
                turns = iter(s["turns"])
                for letter in own:
                    t = {"turn": None, "role": "", "text": ""} if letter == "I" else next(turns)
                    if letter == "D":
                        out.append((conv, None, t["turn"], t["role"], t["text"], letter))
                        continue
                    role = t["role"] if letter == "K" else NAMES[NEXT[state]]
                    state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
                    out.append((conv, pos, t["turn"], role, t["text"], letter))
                    pos += 1
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in REPAIRED.split(", ")])

    return dealt.mapInArrow(apply, REPAIRED)


def repair(turns: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired) of conv_id, turn, role, text, gone: for each conversation its counts, cost and audit; and
    its turns in order, with edits and, but for deleted ones, their new position."""
    segments = written(_segments(faults(turns), size), "segments")
    judged = written(_judged(segments), "audits")
    return judged.where(F.col("cost").isNotNull()).select("conv_id", *COUNTS), _edited(segments, judged)


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` joined by newlines, streamed over turns that are in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, done = object(), None, []
        for batch in batches:
            for c, role, text, edit in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "edit")), strict=True):
                if edit == "D":
                    continue
                if sha is None or c != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                    sha.update(f"{role}:{text}".encode())
                else:
                    sha.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.string()), strict=True)], ["digest_of", "repaired_sha256"])
                done = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], ["digest_of", "repaired_sha256"])

    return repaired.mapInArrow(digest, "digest_of long, repaired_sha256 string")


def op12_conversations(conversations: DataFrame) -> DataFrame:
    audits, repaired = repair(damaged(conversations))
    digests = text_digests(repaired)
    sha: Column = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return audits.join(digests, audits["conv_id"].eqNullSafe(digests["digest_of"]), "left").select("conv_id", *COUNTS, sha.alias("repaired_sha256"))

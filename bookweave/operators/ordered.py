"""Ordered and first-of-group building blocks that stay distributed when one group is huge.

A plain ``Window.partitionBy(doc).orderBy(seq)`` sends a whole document to one task.  If a third of
all rows belong to one document, that task is the job.  :func:`ordered_scan` cuts every group into
consecutive blocks, runs the window inside ``(group, block)``, and carries one summary row per block
across, so the largest unit of work is a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows per block for dense sequence numbers.
BLOCK_ROWS = 65536


@dataclass(frozen=True)
class Scan:
    """One output column of :func:`ordered_scan`; build them with the functions below."""

    kind: str
    expr: Column


def previous(expr: Column) -> Scan:
    """Value of the row before, NULL on the first row."""
    return Scan("previous", expr)


def following(expr: Column) -> Scan:
    """Value of the row after, NULL on the last row."""
    return Scan("following", expr)


def fill(expr: Column) -> Scan:
    """Last non-NULL value at or before the row."""
    return Scan("fill", expr)


def fill_next(expr: Column) -> Scan:
    """First non-NULL value at or after the row."""
    return Scan("fill_next", expr)


def sum_before(expr: Column) -> Scan:
    """Sum over all earlier rows, 0 on the first."""
    return Scan("sum_before", expr)


def total(expr: Column) -> Scan:
    """Sum over the whole group."""
    return Scan("total", expr)


def least_of(expr: Column) -> Scan:
    """Minimum over the whole group."""
    return Scan("least_of", expr)


def greatest_of(expr: Column) -> Scan:
    """Maximum over the whole group."""
    return Scan("greatest_of", expr)


def range_carried(
    df: DataFrame, key: str, order: list[str], forward: bool = True, among: str | None = None, step=None, schema: str | None = None
) -> DataFrame:
    """Rows dealt by ranges of (key, order), so a busy key spans many ranges of even size, and beside each
    range's rows what it has to know of the others.

    ``_range`` numbers the ranges and ``_own`` is 1 for the rows.  A range's last row goes to all later ranges
    as a copy (``_own`` 0, ``_from`` its range): if its key goes on there, it is the row before.  With
    ``forward=False`` the first row of the range's first key that is ``among`` goes to all earlier ranges
    instead.  Copies are at most the square of the number of ranges.  ``step`` may extend the sorted Arrow
    batches of a range on the way, to ``schema``.  One reader, one exchange: ranges are drawn once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    shape = schema or ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, copy, first = TaskContext.get().partitionId(), None, None
        for batch in step(batches) if step else batches:
            if not batch.num_rows:
                continue
            if forward:
                copy = batch.slice(batch.num_rows - 1)
            elif copy is None:
                first = batch.column(key)[0] if first is None else first
                same = pc.equal(batch.column(key), first) if first.is_valid else batch.column(key).is_null()
                fits = batch.filter(pc.fill_null(pc.and_(same, batch.column(among)), False))
                copy = fits.slice(0, 1) if fits.num_rows else None
            yield _numbered(batch, at, 1, at)
        for to in () if copy is None else range(at + 1, parts) if forward else range(at):
            yield _numbered(copy, to, 0, at)

    return dealt.mapInArrow(passed, f"{shape}, _range int, _own int, _from int")


def _numbered(batch: pa.RecordBatch, *numbers: int) -> pa.RecordBatch:
    more = [pa.array([n], pa.int32()).take(pa.array([0] * batch.num_rows, pa.int32())) for n in numbers]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_range", "_own", "_from"])


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: dict[str, Scan],
    block: Column | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Add the ``outputs`` computed along ``order`` inside each group of ``keys``.

    ``block`` must never decrease along ``order``; by default it is the single order column, a dense
    non-negative number, divided by :data:`BLOCK_ROWS`.  Order columns must be unique in a group.

    Both readers of the repartitioned input use all of its columns, so Spark shuffles (and computes)
    the input once and reuses that exchange for the block summaries.  That holds as long as the caller uses
    every column of the result; ``columns`` names those of the input to keep, where others only feed ``outputs``.
    """
    columns = columns or df.columns
    block = F.floor(F.col(order[0]) / BLOCK_ROWS) if block is None else block
    base = df.select(
        F.struct(*keys).alias("_group"),  # a struct compares equal on NULL fields
        block.alias("_block"),
        *columns,
        *[s.expr.alias(f"_v_{n}") for n, s in outputs.items()],
    ).repartition("_group", "_block")
    along_order = F.struct(*order)
    everything = F.struct(*[F.col(c) for c in base.columns])

    # --- one summary row per block, and what it owes to its neighbours
    aggregates = [F.first(everything).alias("_any")]
    for name, scan in outputs.items():
        v = F.col(f"_v_{name}")
        when = F.when(v.isNotNull(), along_order)
        summary = {
            "previous": lambda: F.max_by(F.struct(v.alias("v")), along_order),
            "following": lambda: F.min_by(F.struct(v.alias("v")), along_order),
            "fill": lambda: F.max_by(v, when),
            "fill_next": lambda: F.min_by(v, when),
            "sum_before": lambda: F.sum(v),
            "total": lambda: F.sum(v),
            "least_of": lambda: F.min(v),
            "greatest_of": lambda: F.max(v),
        }[scan.kind]
        aggregates.append(summary().alias(f"_s_{name}"))
    blocks = base.groupBy("_group", "_block").agg(*aggregates)

    along = W.partitionBy("_group").orderBy("_block")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    after = along.rowsBetween(1, W.unboundedFollowing)
    whole = W.partitionBy("_group")

    def carried(name: str, kind: str) -> Column:
        s = F.col(f"_s_{name}")
        if kind == "previous":
            return F.lag(s).over(along)
        if kind == "following":
            return F.lead(s).over(along)
        if kind == "fill":
            return F.last(s, ignorenulls=True).over(before)
        if kind == "fill_next":
            return F.first(s, ignorenulls=True).over(after)
        if kind == "sum_before":
            return F.sum(s).over(before)
        return {"total": F.sum, "least_of": F.min, "greatest_of": F.max}[kind](s).over(whole)

    carry = blocks.select(
        F.col("_group").alias("_group_c"),
        F.col("_block").alias("_block_c"),
        "_any",
        *[carried(n, s.kind).alias(f"_c_{n}") for n, s in outputs.items()],
    )

    # --- the window inside a block
    inside = W.partitionBy("_group", "_block").orderBy(*order)

    def local(name: str, kind: str) -> Column:
        v = F.col(f"_v_{name}")
        if kind == "previous":
            return F.lag(F.struct(v.alias("v"))).over(inside)
        if kind == "following":
            return F.lead(F.struct(v.alias("v"))).over(inside)
        if kind == "fill":
            return F.last(v, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
        if kind == "fill_next":
            return F.first(v, ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing))
        if kind == "sum_before":
            return F.sum(v).over(inside.rowsBetween(W.unboundedPreceding, -1))
        return v

    # Every block has its summary; asking for "_any" is what keeps all columns in the shared exchange, and
    # the left join keeps Spark from putting a filter below one of its two readers.
    joined = base.select("*", *[local(n, s.kind).alias(f"_l_{n}") for n, s in outputs.items()]).join(
        carry.filter(F.col("_any").isNotNull()).drop("_any"),
        (F.col("_group") == F.col("_group_c")) & (F.col("_block") == F.col("_block_c")),
        "left",
    )

    def result(name: str, kind: str) -> Column:
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("previous", "following"):
            return F.coalesce(here, there)["v"]
        if kind in ("fill", "fill_next"):
            return F.coalesce(here, there)
        if kind == "sum_before":
            return F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        return F.coalesce(there, here)

    return joined.select(*columns, *[result(n, s.kind).alias(n) for n, s in outputs.items()])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group.

    Spark cuts each group to ``k`` rows *before* the shuffle (WindowGroupLimit, up to its threshold of
    1000), so a huge group arrives as ``k`` rows per upstream task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    kept = df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)

"""Hard negatives from labelled vectors, by a secondary sort of scored pairs.

Anchors are a stated part of the rows and are scored against all rows, in cells: rows and anchors are dealt
into blocks of a bounded size by hashes of their ids, every block of rows meets every block of anchors, and a
cell is one product of two matrices.  A cell passes on, for each anchor, the first few rows of the anchor's
label (they alone can be among its positives).  With the positives known, the cells pass on the first few
rows of other labels within each positive's window (they alone can be among its negatives).  These pairs,
keyed by (anchor, descending score, kind, id), are repartitioned by anchor and sorted within the partitions,
and a streaming iterator reads each anchor's pairs once: a positive opens its window, a negative goes to the
windows open for it.  It holds an anchor's open windows, never its pairs.

A score is the integer inner product of the vectors, each component x taken as floor(scale * x); scores are
exact (in floating point where all sums stay below 2^53, in integers else) and stop at the ends of a long.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part;
of rows that share an id the least (label, vector) counts; a shorter vector counts as padded with zeros; ties
go to the smaller id; a window of negative scores is empty; other columns are not read, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in a block of rows or anchors, and the fewest rows that are worth a block.
BLOCK, FEWEST = 1 << 20, 1024
SCORED = "anchor_id long, down long, kind int, vec_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
MOST = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (array of double) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(lists: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors, as rows padded with zeros."""
    lists = lists.combine_chunks()
    at = lists.offsets.to_numpy()
    flat = np.floor(lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] * scale)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, within the range of a long."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if dim * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(min(max(x, -1e300), 1e300)) for x in r] for r in m.tolist()], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _first(s: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of ``among`` by descending score; ``among`` is in the order of ids."""
    if len(among) > k:
        least = np.partition(s[among], len(among) - k)[len(among) - k]
        among = among[s[among] >= least]
    return among[np.argsort(-s[among], kind="stable")][:k]


def _pairs(made: list[tuple[int, np.ndarray, np.ndarray]], kind: int) -> pa.Table:
    columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*((np.full(len(i), a), s, i) for a, s, i in made), strict=True)] if made else [np.zeros(0, np.int64)] * 3
    return pa.table([columns[0], -columns[1], pa.array(np.full(len(columns[0]), kind, np.int32)), columns[2]], names=[c.split()[0] for c in SCORED.split(", ")])


def lowest(positive: int, low: int, high: int) -> int:
    """The least score n with low * positive <= high * n."""
    return -(-low * positive // high)


def _cells(rows: DataFrame, anchors: DataFrame, g: int, a: int, make) -> DataFrame:
    """The pairs that ``make`` keeps of each cell."""
    left = rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(g))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    right = anchors.select(*(F.col(c).alias(f"anchor_{c}") for c in anchors.columns))
    right = right.withColumn("a", F.pmod(F.xxhash64("anchor_vec_id", F.lit(1)), F.lit(a)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))))
    return left.groupBy("g", "a").cogroup(right.groupBy("g", "a")).applyInArrow(make, SCORED)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of the same label, its first ``negatives``
    rows of other labels with low * positive_score <= high * score <= high * positive_score."""
    rows = usable(vectors)
    anchors = rows.where(is_anchor)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.count_if(is_anchor).alias("m")).first()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, BLOCK // max(1, size["d"] or 0))
    g = max(1, -(-size["n"] // block), min(parts, size["n"] // FEWEST))
    a = max(1, -(-size["m"] // block))

    def scored(left: pa.Table, right: pa.Table) -> tuple:
        left = left.sort_by("vec_id")
        ids, labels = (left[c].to_numpy() for c in ("vec_id", "label"))
        return ids, labels, scores(_matrix(right["anchor_v"], scale), _matrix(left["v"], scale))

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _pairs([], 0)
        ids, labels, s = scored(left, right)
        made = []
        for i, (anchor, label) in enumerate(zip(right["anchor_vec_id"].to_pylist(), right["anchor_label"].to_pylist(), strict=True)):
            best = _first(s[i], np.flatnonzero((labels == label) & (ids != anchor)), positives)
            made.append((anchor, s[i][best], ids[best]))
        return _pairs(made, 0)

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _pairs([], 1)
        ids, labels, s = scored(left, right)
        made = []
        for i, (anchor, label, open_) in enumerate(zip(*(right[f"anchor_{c}"].to_pylist() for c in ("vec_id", "label", "windows")), strict=True)):
            different = labels != label
            kept = [_first(s[i], np.flatnonzero(different & (s[i] <= p) & (s[i] >= lowest(p, low, high))), negatives) for p in {*open_}]
            best = np.unique(np.concatenate(kept))
            made.append((anchor, s[i][best], ids[best]))
        return _pairs(made, 1)

    def sorted_by_anchor(pairs: DataFrame) -> DataFrame:
        return pairs.repartition(parts, "anchor_id").sortWithinPartitions("anchor_id", "down", "kind", "vec_id")

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen = None, 0
        for batch in batches:
            keep = []
            for x in batch.column("anchor_id").to_pylist():
                anchor, seen = x, seen + 1 if x == anchor else 1
                keep.append(seen <= positives)
            yield batch.filter(pa.array(keep, pa.bool_()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for x, down, kind, vec_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != anchor:
                    anchor, windows = x, []
                if kind == 0:
                    windows.append([vec_id, -down, lowest(-down, low, high), 0])
                    continue
                windows_open = [w for w in windows if -down >= w[2] and w[3] < negatives]
                for w in windows_open:
                    w[3] += 1
                    out.append((anchor, w[0], w[3], vec_id, w[1], -down))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in MINED.split(", ")])

    best = sorted_by_anchor(_cells(rows, anchors, g, a, same)).mapInArrow(first_ones, SCORED)
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(-F.col("down")).alias("windows"))
    found = _cells(rows, anchors.join(windows, "vec_id"), g, a, others)
    return sorted_by_anchor(best.union(found)).mapInArrow(emit, MINED)


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    seventh = F.col("vec_id") % 7 == 0
    moved = F.when(seventh, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", moved.alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)

"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

1. One pass turns each text into its set's size, a 128-bit fingerprint of the set, the minima of universal
   hash functions in bands, and a byte of each minimum as signature.  Texts with equal sets are one class
   from here on, known by its smallest doc_id.
2. In each bucket of a band every member is paired with two centres, not with all others: the smallest id
   and one chosen by hash.  Pairs whose signatures agree too little go; the others are confirmed on the full
   sets.  Connected components by alternating large-star and small-star.
3. Members of a bucket that still are in different components are all compared: pair by pair in a bucket of
   a few members, block by block within a task in a larger one.  So no two components of which a link exists
   in a bucket stay apart; members of one component need no more comparing.

With b bands of r rows a pair at the threshold t shares no bucket with probability (1 - t^r)^b; ``bands``
takes the least b that brings it under 1e-6.

Defined results: null text and text without words have an empty set and are linked with nothing; a null
``doc_id`` takes no part (component null, kept); rows that share ``doc_id`` are one document, with the sum of
their links; an empty table gives an empty result.  Other columns are left out; ``deduplicate`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import shared_folder, written

U = np.uint64
ROWS = 4
#: Buckets of up to so many members are compared pair by pair, larger ones in blocks of so many members or
#: shingles; of two components' pairs so many are passed on to be confirmed.
FEW, BLOCK, BLOCK_SHINGLES, CLOSEST = 32, 512, 1 << 20, 3


def bands(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_agreement(threshold: float, n: int, miss: float = 1e-7) -> int:
    """The agreement of n minima that a pair at the threshold falls short of with probability under miss."""
    p = [math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(n + 1)]
    total, k = 0.0, 0
    while total + p[k] < miss:
        total, k = total + p[k], k + 1
    return k


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 1 << 63, n, dtype=U) * U(2) + U(1), draw.integers(0, 1 << 63, n, dtype=U)


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and their ranges."""
    starts, ends, at = W.bounds(data, offsets)
    every, ranges = W.shingles(W.hashes(data, starts, ends), at, n)
    own = [np.unique(every[a:b]) for a, b in zip(ranges[:-1], ranges[1:], strict=True)]
    size = np.array([len(x) for x in own], np.int64)
    return np.concatenate([np.zeros(0, U), *own]), np.concatenate([[0], np.cumsum(size)])


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary"


def signatures(docs: DataFrame, shingle: int, n_bands: int, rows: int = ROWS) -> DataFrame:
    """Size, fingerprint, band hashes and signature of each text's set (none of the last two if empty)."""
    count = n_bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal(count)
        for batch in batches:
            for low, high, data, offsets in W.chunks(batch.column("text")):
                flat, at = _sets(data, offsets, shingle)
                size = np.diff(at)
                full = np.flatnonzero(size)
                first = at[:-1][full]
                f = np.zeros((2, len(size)), U)
                least = np.zeros((count, len(full)), U)
                if len(full):
                    f[0][full] = np.add.reduceat(W.mixed(flat + U(11)), first)
                    f[1][full] = np.add.reduceat(W.mixed(flat ^ U(0x5BD1E995CAFEF00D)), first)
                    for k in range(count):
                        least[k] = np.minimum.reduceat(flat * a[k] + b[k], first)
                least >>= U(24)
                joined = np.zeros((n_bands, len(full)), U)
                for k in range(count):
                    joined[k // rows] = W.mixed(joined[k // rows] * W.BASE + least[k])
                byte = W.mixed(least).astype(np.uint8).T.copy()
                lists, sigs = [None] * len(size), [None] * len(size)
                for i, d in enumerate(full):
                    lists[d], sigs[d] = joined[:, i].view(np.int64), byte[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low).cast(pa.int64()),
                        pa.array(size),
                        pa.array(f[0].view(np.int64)),
                        pa.array(f[1].view(np.int64)),
                        pa.array(lists, pa.list_(pa.int64())),
                        pa.array(sigs, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNED)


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, sig_a, b, sig_b) whose signatures agree in ``least`` places, as (a, b)."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            good = pa.array((x == y).sum(1) >= least)
            yield batch.select(["a", "b"]).filter(good)

    return pairs.mapInArrow(agree, "a long, b long")


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    sides = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    sides = sides.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            sizes = batch.column("text_a").cast(pa.large_string())
            for low, high, data, offsets in W.chunks(sizes):
                x, xa = _sets(data, offsets, shingle)
                data, offsets = W.buffers(batch.column("text_b").slice(low, high - low))
                y, ya = _sets(data[offsets[0] : offsets[-1]], offsets - offsets[0], shingle)
                for i in range(high - low):
                    p, q = x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]]
                    both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                    good[low + i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return sides.mapInArrow(confirm, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every end of an edge (a, b): large-star and small-star in turn, until the edges
    stay as they are.  Minima are combined before the shuffle and written before they are joined, so that a
    node with very many edges is split like any skewed join."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large-star")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u > v").distinct(), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return written(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots), "components")


def _pairs_of(members: DataFrame, other: Column) -> DataFrame:
    return members.where(F.col("id") != other).select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"))


def _with_signatures(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    pairs = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    return pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "sig_a", "b", "sig_b")


def _short_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id and the text's sorted set of shingles as 32-bit hashes."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.chunks(batch.column("text")):
                flat, at = _sets(data, offsets, shingle)
                sets = [np.unique((flat[a:b] >> U(32)).astype(np.uint32)).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), pa.array(sets, pa.binary())], ["id", "short"])

    return docs.mapInArrow(shorten, "id long, short binary")


def _common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, as products of 0/1 matrices, some columns at a
    time; shingles that only one list has are left out."""
    flat = [np.concatenate([np.zeros(0, np.uint32), *x]) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    both = np.intersect1d(*flat)
    place = [np.searchsorted(both, f) for f in flat]
    good = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(both), columns):
        side = []
        for x, p, o, g in zip((left, right), place, owner, good, strict=True):
            part = g & (p >= low) & (p < low + columns)
            m = np.zeros((len(x), min(columns, len(both) - low)), np.float32)
            m[o[part], p[part] - low] = 1
            side.append(m)
        out += side[0] @ side[1].T
    return out.astype(np.int64)


def _in_blocks(docs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, percent: int, least: int) -> DataFrame:
    """Pairs (a, b) worth confirming within large buckets (``rows``: id, band, bucket, component).

    A bucket is dealt into blocks of about ``BLOCK`` members (fewer if their sets are large) and each two
    blocks meet in a task of their own, which compares them as matrices and passes on, for any two
    components, only the closest pairs: one link joins two components, the others would say no more.  A pair
    is compared in the first of the buckets it shares."""
    sizes = classes.select("id", "n_shingles")
    load = rows.join(sizes, "id").groupBy("band", "bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    load = written(load, "blocks")
    wanted = rows.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(written(wanted, "wanted"), "id", "left_semi")
    short = _short_sets(texts, shingle).groupBy("id").agg(F.max("short").alias("short"))
    known = written(short.join(classes.select("id", "n_shingles", "bands", "sig"), "id"), "short-sets")
    dealt = rows.drop("n").join(load, ["band", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select("id", "band", "bucket", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = dealt.join(known, "id")

    def compare(table: pa.Table) -> pa.Table:
        t = table.sort_by("id").combine_chunks()
        own, i, j, band = (t.column(c).to_numpy() for c in ("own", "i", "j", "band"))
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(x) or not len(y):
            return none
        ids, comp, size = (t.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands_ = np.array(t.column("bands").to_pylist(), np.int64)
        good = (ids[x][:, None] != ids[y][None]) & (comp[x][:, None] != comp[y][None])
        if i[0] == j[0]:
            good &= ids[x][:, None] < ids[y][None]
        for k in range(int(band[0])):
            good &= bands_[x, k][:, None] != bands_[y, k][None]
        agreed = np.zeros(good.shape, np.int16)
        for k in range(sig.shape[1]):
            agreed += sig[x, k][:, None] == sig[y, k][None]
        good &= agreed >= least
        rx, ry = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
        if not len(rx):
            return none
        sets = [np.frombuffer(v, np.uint32) for v in t.column("short").to_pylist()]
        both = _common([sets[k] for k in x[rx]], [sets[k] for k in y[ry]])
        total = size[x[rx]][:, None] + size[y[ry]][None] - both
        # Two shingles more, as 32-bit hashes may meet; the full sets decide afterwards.
        near = good[np.ix_(rx, ry)] & (100 * (both + 2) >= percent * (total - 2))
        p, q = np.nonzero(near)
        order = np.argsort(-(both[p, q] / total[p, q]), kind="stable")
        p, q = x[rx[p[order]]], y[ry[q[order]]]
        used, out = {}, []
        for u, v in zip(p.tolist(), q.tolist(), strict=True):
            key = (min(comp[u], comp[v]), max(comp[u], comp[v]))
            if used.get(key, 0) < CLOSEST:
                used[key] = used.get(key, 0) + 1
                out.append((min(ids[u], ids[v]), max(ids[u], ids[v])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return met.groupBy("band", "bucket", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row."""
    shared_folder(docs.sparkSession)
    t = percent / 100
    n_bands = bands(t, rows)
    least = least_agreement(t, n_bands * rows)
    signed = written(signatures(docs, shingle, n_bands, rows), "signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "classes",
    )
    placed = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    heads = placed.groupBy("band", "bucket").agg(
        F.min("id").alias("least"), F.min_by("id", F.xxhash64("id")).alias("chosen"), F.count("*").alias("n")
    )
    heads = written(heads.where("n > 1").drop("n"), "heads")
    members = written(placed.join(heads, ["band", "bucket"]), "members")
    sigs = classes.select("id", "sig")
    tried = written(_pairs_of(members, F.col("least")).union(_pairs_of(members, F.col("chosen"))).distinct(), "tried")
    links = written(_confirmed(docs, _agreeing(_with_signatures(tried, sigs), least), shingle, percent), "links")
    found = components(links)

    # What is left: members of one bucket that are in different components.
    labelled = members.select("id", "band", "bucket").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = written(labelled, "labelled")
    mixed = labelled.groupBy("band", "bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    mixed = written(mixed.where("x < y").select("band", "bucket", "n"), "mixed")
    open_ = labelled.join(mixed, ["band", "bucket"])
    few = open_.where(F.col("n") <= FEW).join(sigs, "id")
    left = few.select("band", "bucket", F.col("component").alias("c"), F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = few.select("band", "bucket", F.col("component").alias("d"), F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    rest = left.join(right, ["band", "bucket"]).where("a < b AND c != d").select("a", "sig_a", "b", "sig_b")
    rest = _agreeing(rest, least).union(_in_blocks(docs, open_.where(F.col("n") > FEW), classes, shingle, percent, least))
    rest = rest.distinct().join(tried, ["a", "b"], "left_anti")
    more = written(_confirmed(docs, rest, shingle, percent), "links")
    if not more.isEmpty():
        found = components(links.union(more))

    classed = classes.select("f1", "f2", "n_shingles", "id").join(found, "id", "left")
    classed = classed.select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component"))
    classed = written(classed, "classed")
    joined = signed.join(classed, ["f1", "f2", "n_shingles"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.  Rows with a null doc_id
    and repeated rows of a kept document stay."""
    drop = near_duplicates(docs, shingle, percent).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op10_minhash(docs: DataFrame) -> DataFrame:
    """Three words, at least 85 of 100."""
    found = near_duplicates(docs, shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Texts and items are taken as words without case and punctuation, and as five-word shingles weighted by how
often they occur.  A window has as many words as the item that it is held against (a shorter text is one
window).  Windows without a shingle of any item of their size have similarity 0 and get no fingerprint; each
other one gets a 128-bit SimHash of its weighted shingles.  The fingerprint is cut into 8 blocks of 16 bits:
of two fingerprints at most 39 bits apart at least one block differs in at most 4 bits, so a table for each
block, from each of its values to the items within 4 bits, finds every item within the radius.  Those pairs
are verified by the weighted Jaccard similarity of the shingles, sum of minima by sum of maxima.

A pair of similarity 0.8 differs in 19 bits on average, and in over 39 with a probability of about 1e-6.

Items come in blocks of at most 256 items and about ``block_words`` words, which bounds what a task holds;
a benchmark of more blocks takes as many passes over the documents.

Defined results: null and empty texts contain nothing; items of fewer than five words (null too) form no
shingle and are not searched for; repeated items are each reported; each repeated row of ``docs`` gets its
own rows; an empty benchmark or an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

U = np.uint64
SHINGLE, BLOCKS, NEAR, RADIUS, ITEMS = 5, 8, 4, 39, 256
FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes at every word of the column, the words' ranges, and which starts are whole."""
    starts, ends, at = W.bounds(data, offsets, W.PUNCTUATION)
    words = W.hashes(data, starts, ends)
    out = np.zeros(len(words), U)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(words)) >= SHINGLE
    if len(words) >= SHINGLE:
        last = len(words) - SHINGLE + 1
        for k in range(SHINGLE):
            out[:last] = W.mixed(out[:last] + words[k : last + k] * W.BASE)
    return out, at, room


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 128 bits of each shingle."""
    both = np.stack([W.mixed(hashes), W.mixed(hashes ^ U(0xA5A5A5A55A5A5A5A))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _simhash(sums: np.ndarray) -> np.ndarray:
    """128-bit fingerprints, as 8 blocks of 16 bits, of summed bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class Items:
    """Fingerprints and index of one block of items."""

    def __init__(self, ids: list, texts: list[str]):
        data, offsets = W.buffers(pa.array(texts, pa.large_string()))
        every, at, room = _shingles(data, offsets)
        self.ids = ids
        self.size = np.diff(at)
        self.shingles = [every[a:b][room[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.sizes = np.unique(self.size)
        self.prints = np.concatenate([np.zeros((0, BLOCKS), np.uint16), *(_simhash(_bits(s).sum(0, keepdims=True)) for s in self.shingles)])
        flat = np.concatenate([np.zeros(0, U), *self.shingles])
        self.keys, which = np.unique(flat, return_inverse=True)
        pairs = np.unique(np.stack([which, np.repeat(self.size, [len(s) for s in self.shingles])], 1), axis=0)
        self.key_sizes, self.key_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))
        self.index = W.Index(self.keys)
        self.tables = None

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, items of ``size`` words only."""
        if self.tables is None:
            values = np.arange(1 << 16, dtype=np.uint16)[:, None]
            self.tables = [np.packbits(np.bitwise_count(values ^ self.prints[None, :, b]) <= NEAR, axis=1) for b in range(BLOCKS)]
        near = self.tables[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            near = near | self.tables[b][prints[:, b]]
        near &= np.packbits(self.size == size)
        window, item = np.nonzero(np.unpackbits(near, axis=1, count=len(self.ids)))
        far = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1)
        return window[far <= RADIUS], item[far <= RADIUS]

    def search(self, every: np.ndarray, room: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item, start, words, similarity) of the best window for each item that one text contains."""
        n = len(every)
        hits = np.flatnonzero(room)
        which = self.index.find(every[hits])
        hits, which = hits[which >= 0], which[which >= 0]
        best: dict[int, tuple[float, int, int]] = {}
        counts = self.key_at[which + 1] - self.key_at[which]
        at = np.repeat(hits, counts)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        size_of = self.key_sizes[np.repeat(self.key_at[which], counts) + inner]
        for size in np.unique(size_of):
            long, span = min(int(size), n), min(int(size), n) - SHINGLE + 1
            p = np.unique(at[size_of == size])
            change = np.zeros(n + 2, np.int32)
            np.add.at(change, np.maximum(p - span + 1, 0), 1)
            np.add.at(change, p + 1, -1)
            starts = np.flatnonzero(np.cumsum(change)[: n - long + 1] > 0)
            for runs in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for low in range(0, len(runs), 4096):
                    s = runs[low : low + 4096]
                    sums = np.cumsum(_bits(every[s[0] : s[-1] + span]), axis=0, dtype=np.int32)
                    sums = np.concatenate([np.zeros((1, 128), np.int32), sums])
                    window, item = self.candidates(_simhash(sums[s - s[0] + span] - sums[s - s[0]]), int(size))
                    for w, i in zip(s[window].tolist(), item.tolist(), strict=True):
                        x = similarity(every[w : w + span], self.shingles[i])
                        if x >= threshold and (-x, w) < best.get(i, (0.0, 0, 0))[:2]:
                            best[i] = (-x, w, long)
        return [(i, w, long, -x) for i, (x, w, long) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_words: int = 200_000) -> Iterator[Items]:
    """Items of five words and more, in blocks of bounded size."""
    ids, texts, size = [], [], 0
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        data, offsets = W.buffers(pa.array([row["text"]]))
        n = len(W.bounds(data, offsets, W.PUNCTUATION)[0])
        if n < SHINGLE:
            continue
        if ids and (len(ids) == ITEMS or size + n > block_words):
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window for each item that a text contains."""

    def with_items(items: Items):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for low, _, data, offsets in W.chunks(batch.column("text")):
                    every, at, room = _shingles(data, offsets)
                    known = np.flatnonzero(room)
                    known = known[items.index.find(every[known]) >= 0]
                    for d in np.unique(np.searchsorted(at, known, "right") - 1).tolist():
                        for i, start, n, x in items.search(every[at[d] : at[d + 1]], room[at[d] : at[d + 1]], threshold):
                            rows.append((ids[low + d].as_py(), items.ids[i], start, n, x))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(),) * 4 + (pa.float64(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        return scan

    texts = docs.select("doc_id", "text")
    passes = [texts.mapInArrow(with_items(items), FOUND) for items in item_blocks(benchmark)]
    if not passes:
        return docs.sparkSession.createDataFrame([], FOUND)
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null doc_id stay."""
    return docs.join(contaminated(docs, benchmark, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op4_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).withColumn("similarity", F.round("similarity", 6))

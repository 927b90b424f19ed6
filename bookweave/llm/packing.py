"""Packing of tokenised documents into training sequences of one length.

Ids are those of a public tokenizer, written once as a table.  Full pieces of ``length`` ids are cut off
each document; what remains of it is an item.  Documents are dealt into groups at random (by a hash of their
row), as many as keep a group at ``group_docs`` documents, and each group is packed on its own: first-fit
decreasing, where a tournament tree over the room left in the bins finds the first bin that takes an item in
a logarithm of the bins.  Bins that stay open are then topped up from the emptiest ones, whose documents are
cut to measure; the last one of a group becomes sequences of powers of two.  A group handles row numbers and
lengths only; the ids meet their pieces by a join, one row for each document.

The tokenizer cuts a text into runs (of letters, of signs, single digits) and encodes each on its own.  So the
runs of many texts are found on arrays of characters, whose classes and small letters are asked from the
tokenizer itself, and each distinct run is given to it once.  Texts with a special token, with characters
whose small form is longer, or out of normal form C are given to it whole.

Defined results: null and empty texts have the end id only; a null ``doc_id`` is carried along; each row is
a document, repeated or not; equal lengths are packed in the order of their rows; other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import new_folder

LENGTH, GROUP_DOCS, END = 4096, 1 << 14, 2
#: Bytes of text encoded at a time, and distinct runs remembered by a Python worker.
CHUNK, REMEMBERED = 4 << 20, 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The runs that the tokenizer cuts normalised texts into; only a tokenizer that states them is run by run.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Classes of characters; texts with a character of the last are encoded whole.
GAP, LETTER, NUMBER, OTHER, WHOLE = range(5)


class Encoder:
    """Ids of Arrow texts.  Where the tokenizer works run by run, each distinct run is given to it once."""

    def __init__(self, blob: str):
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        self.tokenizer = Tokenizer.from_str(blob)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.by_runs = RUNS in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        if not self.by_runs:
            return
        split = {"type": "WhitespaceSplit"}
        spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"][0] = None, split
        self.bare = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        self.closing = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.closing[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.kind, self.lower = np.full(0x110000, 255, np.uint8), np.arange(0x110000, dtype=np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, points: np.ndarray) -> None:
        """Class and small letter of each character not met before, as the tokenizer has them."""
        normal, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        seen = np.unique(points)
        for c in seen[self.kind[seen] == 255].tolist():
            small = normal(chr(c))
            if not cut(chr(c)):
                self.kind[c] = GAP
            elif len(small) != 1:
                self.kind[c] = WHOLE
            else:
                self.lower[c] = ord(small)
                self.kind[c] = LETTER if len(cut(f"x{small}x")) == 1 else OTHER if len(cut(small + small)) == 1 else NUMBER

    def _ids_of(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of each run in ``self.flat``."""
        new = [r for r in runs if r not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = runs
        flats, sizes = [self.flat], []
        for low in range(0, len(new), 1 << 13):
            part = new[low : low + (1 << 13)]
            ids = np.array(self.bare.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                each = [self.bare.encode(r, add_special_tokens=False).ids for r in part]
                ids, ends = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            flats.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat = np.concatenate(flats)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        at = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))
        return self.first[at], self.first[at + 1] - self.first[at]

    def _by_runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and ranges of the texts, or None where a text is to be encoded whole."""
        text = data.tobytes()
        if any(t in text for t in self.special) or not unicodedata.is_normalized("NFC", text.decode()):
            return None
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        self._learn(points)
        kind = self.kind[points]
        if (kind == WHOLE).any():
            return None
        points = self.lower[points]
        # Where texts begin, in characters.
        heads = (data & 0xC0) != 0x80
        texts = np.concatenate([[0], np.cumsum(heads)])[offsets]
        begins = np.ones(len(points), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins[texts[texts < len(points)]] = True
        mark = np.flatnonzero((points == 0x27) & begins)
        for c in CONTRACTIONS:
            own = mark[mark + len(c) < len(points)]
            fits = np.ones(len(own), bool)
            for k, letter in enumerate(c, 1):
                fits &= points[own + k] == ord(letter)
                fits &= ~begins[own + k] if k > 1 else True
            own = own[fits]
            own = own[np.searchsorted(texts, own, "right") == np.searchsorted(texts, own + len(c), "right")]
            begins[own + 1] = False
            after = own + len(c) + 1
            begins[after[after < len(points)]] = True
        starts = np.flatnonzero(begins)
        small = points.tobytes().decode("utf-32-le").encode()
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width)])
        full = kind[starts] != GAP
        column = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(at[starts], at[-1]).astype(np.int64)), pa.py_buffer(small)])
        coded = column.filter(pa.array(full)).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        first, sizes = self._ids_of(coded.dictionary.to_pylist())
        own = sizes[index]
        before = np.concatenate([[0], np.cumsum(own)])
        ids = self.flat[np.repeat(first[index] - before[:-1], own) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts[full], texts)]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids
        return np.array(ids, np.uint32), np.array([0, len(ids)])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the ranges of the texts; ``end`` closes each text."""
        found = self._by_runs(data, offsets) if self.by_runs else None
        if found is None:
            each = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                part = data[a:b], np.array([0, b - a])
                each.append((self.by_runs and self._by_runs(*part)) or self._whole(*part))
            ids = np.concatenate([np.zeros(0, np.uint32), *(x[0] for x in each)])
            found = ids, np.concatenate([[0], np.cumsum([len(x[0]) for x in each])]).astype(np.int64)
        ids, ranges = found
        if end is None:
            return ids, ranges
        return np.insert(ids, ranges[1:], np.uint32(end)), ranges + np.arange(len(ranges))


@lru_cache(1)
def _encoder(blob: str) -> Encoder:
    return Encoder(blob)


def token_table(docs: DataFrame, tokenizer: str | None = None, end: int | None = END) -> DataFrame:
    """rid, doc_id, doc_tokens and ids (little-endian, 2 bytes an id if the vocabulary allows it) of each row, as a written table."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        blob = f.read()
    kind = _kind(blob, end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(blob)
        for batch in batches:
            for low, high, data, offsets in W.chunks(batch.column("text"), CHUNK):
                ids, ranges = own.encode(data, offsets, end)
                raw = ids.astype(kind)
                at = (ranges * raw.itemsize).astype(np.int64)
                binary = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(at), pa.py_buffer(raw)])
                columns = [batch.column(c).slice(low, high - low) for c in ("rid", "doc_id")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ranges)), binary.cast(pa.binary())], ["rid", "doc_id", "doc_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    path = new_folder(docs.sparkSession, "token-ids")
    rows.mapInArrow(encode, "rid long, doc_id long, doc_tokens long, ids binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _kind(blob: str, end: int | None) -> str:
    most = max(_encoder(blob).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end or 0)
    return "<u2" if most < 1 << 16 else "<u4"


class Bins:
    """Bins in the order they were opened, under a tournament tree of the room they have left."""

    def __init__(self, length: int, most: int):
        self.length, self.leaves = length, 1 << max(0, most - 1).bit_length()
        self.tree = [length] * (2 * self.leaves)
        self.items: list[list[tuple[int, int]]] = []

    def put(self, item: int, size: int) -> None:
        """Into the first bin with room for it; an unopened bin has room for all."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bin_ = at - self.leaves
        if bin_ == len(self.items):
            self.items.append([])
        self.items[bin_].append((item, size))
        tree[at] -= size
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2

    def room(self, bin_: int) -> int:
        return self.tree[self.leaves + bin_]


def powers(size: int) -> list[int]:
    """The powers of two that make up ``size``, largest first."""
    return [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]


def pack_group(tokens: list[int], length: int) -> list[list[tuple[int, int, int, int]]]:
    """For each document (by its number of ids) its pieces: start, length, sequence, offset in the sequence."""
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in tokens]
    sequence = 0
    for doc, n in enumerate(tokens):
        for start in range(0, n - n % length, length):
            pieces[doc].append((start, length, sequence, 0))
            sequence += 1
    rest = sorted(((n % length, doc) for doc, n in enumerate(tokens) if n % length), key=lambda x: (-x[0], x[1]))
    bins = Bins(length, len(rest))
    for size, doc in rest:
        bins.put(doc, size)
    # A piece is (document, start, length) from here on.
    full = lambda doc: tokens[doc] - tokens[doc] % length
    held = [[(doc, full(doc), size) for doc, size in items] for items in bins.items]
    order = sorted(range(len(held)), key=lambda b: (bins.room(b), b))
    room = [bins.room(b) for b in order]
    held = [held[b] for b in order]
    low, high = 0, len(held) - 1
    while low < high:
        if not room[low]:
            low += 1
        elif not held[high]:
            held.pop()
            high -= 1
        else:
            doc, start, size = held[high].pop()
            taken = min(size, room[low])
            held[low].append((doc, start, taken))
            room[low] -= taken
            if taken < size:
                held[high].append((doc, start + taken, size - taken))
    last = held.pop() if held and sum(x[2] for x in held[-1]) < length else []
    for parts in [*held, *_cut(last, powers(sum(x[2] for x in last)))]:
        offset = 0
        for doc, start, size in parts:
            pieces[doc].append((start, size, sequence, offset))
            offset += size
        sequence += 1
    return [sorted(p) for p in pieces]


def _cut(parts: list[tuple[int, int, int]], sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """The parts, in their order, dealt into runs of the given sizes."""
    out, left = [], parts[::-1]
    for size in sizes:
        run = []
        while size:
            doc, start, n = left.pop()
            taken = min(n, size)
            run.append((doc, start, taken))
            size -= taken
            if taken < n:
                left.append((doc, start + taken, n - taken))
        out.append(run)
    return out


def _planned(tokens: DataFrame, length: int, group_docs: int) -> DataFrame:
    """rid and its pieces, an array of (start, length, sequence_id, offset)."""
    groups = max(1, -(-tokens.count() // group_docs))
    dealt = tokens.select("rid", "doc_tokens", F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("g"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "sequence_id", "offset")]))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        made = pack_group(table["doc_tokens"].to_pylist(), length)
        base = key[0].as_py() << 32
        flat = np.array([(a, n, base + s, o) for p in made for a, n, s, o in p], np.int64).reshape(-1, 4)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in made])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], fields=list(kind.value_type))
        return pa.table([table["rid"], pa.ListArray.from_arrays(pa.array(offsets), values)], names=["rid", "pieces"])

    return dealt.groupBy("g").applyInArrow(pack, "rid long, pieces array<struct<start: long, length: long, sequence_id: long, offset: long>>")


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end: int | None = END, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id and offset, gapless from 0 in each sequence."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        kind = _kind(f.read(), end)
    tokens = token_table(docs, tokenizer, end)
    both = tokens.join(_planned(tokens, length, group_docs), "rid").select("doc_id", "doc_tokens", "ids", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for doc_id, n, ids, pieces in zip(*(batch.column(c) for c in ("doc_id", "doc_tokens", "ids", "pieces")), strict=True):
                own = np.frombuffer(ids.as_py(), kind)
                for p in pieces.as_py():
                    part = own[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes()
                    made.append((doc_id.as_py(), p["start"], p["length"], part, n.as_py(), p["sequence_id"], p["offset"]))
                    size += len(part)
                    if size > CHUNK:
                        yield _rows(made)
                        made, size = [], 0
            if made:
                yield _rows(made)

    return both.mapInArrow(cut, PIECES)


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequences, tokens and padding (ids that fill sequences up to ``length``, but for powers of two) of packed pieces."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.expr("n & (n - 1)") == 0
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(length - F.col("n"))).alias("padding"))


def op13_packing(docs: DataFrame) -> DataFrame:
    pieces = pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc(ids: list[int]) -> int:
    """The digest of a piece as ``op13_packing`` gives it."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())

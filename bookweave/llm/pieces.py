"""SentencePiece encoding and decoding with a given model, giant documents in parallel chunks.

The ids are those of the library for the same model and text.  A text is cut at most every ``CHUNK``
characters, where it can be in front of a space: no piece reaches over the start of a run of spaces, so such
a boundary has a single state.  Where a chunk has no space the boundary lies inside a word and has a state
for every piece that may lie across it.  Byte-pair encoding is then the one path of pieces through the text
on which any two neighbours stay as they are when they are encoded together; as a max-plus weight, 0 where
they do and minus infinity where they don't.  Each chunk yields the matrix of best weights from its entry
states to its exit states, the matrices of a text are combined by the associative max-plus product, which
settles the states at all boundaries, and each chunk is then traced back on its own.  Texts of one chunk
need no matrix and are encoded where they are read.

U+2581 stands for a space inside the library; in a text it is encoded by its three bytes, so that decoding
gives every text back exactly.

Defined results: null and empty texts have no ids and decode to the empty text; other columns are carried
along (an input column ``token_ids`` is replaced); repeated rows are encoded alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Characters to a chunk, and the longest piece that a model may have.
CHUNK, PIECE = 1 << 15, 64
MARK = "▁"
#: Appended to a model: no space is put in front of a text (a field given again replaces the earlier one).
NO_PREFIX = b"\x1a\x02\x18\x00"
RID = "_sp_rid"
NEVER = -np.inf


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """A loaded model: whole texts, and what may stand next to what."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.full = SentencePieceProcessor(model_proto=model)
        self.bare = SentencePieceProcessor(model_proto=model + NO_PREFIX)
        pieces = [self.bare.id_to_piece(i) for i in range(self.bare.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.bare.is_control(i) or self.bare.is_unknown(i) or self.bare.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece of this model reaches over a space")
        self.longest = max(map(len, plain))
        if self.longest > PIECE:
            raise ValueError("a piece of this model is longer than the context of a chunk")
        self.known = set(plain)
        self.mark = [self.bare.piece_to_id(f"<0x{b:02X}>") for b in MARK.encode()]
        self.fits = lru_cache(1 << 18)(self._fits)
        self.ids = lru_cache(1 << 16)(self._ids)

    def _ids(self, piece: str) -> tuple[int, ...]:
        return tuple(self.bare.encode(piece.replace(MARK, " ")))

    def _fits(self, a: str, b: str) -> bool:
        """Whether two neighbours stay as they are."""
        return tuple(self.bare.encode((a + b).replace(MARK, " "))) == self.ids(a) + self.ids(b)

    def whole(self, text: str) -> list[int]:
        """Ids of a text, no space put in front."""
        if MARK not in text:
            return self.bare.encode(text)
        out: list[int] = []
        for k, part in enumerate(text.split(MARK)):
            out += [*(self.mark if k else []), *self.bare.encode(part)]
        return out

    def pieces_at(self, text: str, at: int, end: int) -> list[str]:
        """What may start at ``at``: pieces that encode as themselves, and the single character."""
        found = [text[at]]
        for n in range(2, min(self.longest, end - at) + 1):
            p = text[at : at + n]
            if p in self.known and len(self.ids(p)) == 1:
                found.append(p)
        return found


State = tuple[str, int]
#: The state at a boundary that no piece reaches over.
CUT: State = ("", 0)


#: Where no piece reaches over: at the start of a run of spaces, before and after U+2581.
CLEAN = re.compile(f"(?<! )(?= )|(?={MARK})|(?<={MARK})")


def split(text: str, size: int = CHUNK) -> list[tuple[int, bool]]:
    """Starts of a text's chunks, and whether each start is one that no piece reaches over.  A chunk goes as
    far as it can if its start is clean, else to the first clean place."""
    starts, at, clean = [(0, True)], 0, True
    while len(text) - at > size:
        cut = None
        for m in CLEAN.finditer(text, at + 1, at + size):
            cut = m.start()
            if not clean:
                break
        at, clean = (cut, True) if cut else (at + size, False)
        starts.append((at, clean))
    return starts


class Chunk:
    """A chunk ``low:high`` of a text around it, and the states at its two boundaries."""

    def __init__(self, model: Model, text: str, low: int, high: int, clean_start: bool, clean_end: bool):
        self.m, self.text, self.low, self.high = model, text, low, high
        self.entries = [CUT] if clean_start else self._across(low)
        self.exits = [CUT] if clean_end else self._across(high)
        self.clean_end = clean_end

    def _across(self, at: int) -> list[State]:
        """Pieces that start before a boundary and end at or after it."""
        first, out = max(0, at - self.m.longest), []
        for a in range(first, at):
            for p in self.m.pieces_at(self.text, a, len(self.text)):
                if a + len(p) >= at:
                    out.append((p, a + len(p) - at))
        return out

    def _reached(self, entries: list[State]) -> tuple[dict[int, dict[str, int]], list[int]]:
        """For each position the pieces that end there and, as bits, the entries from which they are
        reached; and for each exit state the same bits."""
        ending: dict[int, dict[str, int]] = {}
        for k, (p, over) in enumerate(entries):
            at = ending.setdefault(self.low + over, {})
            at[p] = at.get(p, 0) | 1 << k
        limit = self.high if self.clean_end else len(self.text)
        started = set()
        for at in range(self.low, self.high):
            before = ending.get(at)
            if not before:
                continue
            for p in self.m.pieces_at(self.text, at, limit):
                bits = 0
                for q, own in before.items():
                    if own & ~bits and (q == "" or self.m.fits(q, p)):
                        bits |= own
                if bits:
                    end = ending.setdefault(at + len(p), {})
                    end[p] = end.get(p, 0) | bits
                    started.add((at + len(p), p))
        out = []
        for p, over in self.exits:
            if self.clean_end:
                bits = 0
                for own in ending.get(self.high, {}).values():
                    bits |= own
            else:
                bits = ending.get(self.high + over, {}).get(p, 0)
            out.append(bits)
        return ending, out

    def matrix(self) -> np.ndarray:
        """Best weight from each entry state to each exit state."""
        _, out = self._reached(self.entries)
        return np.array([[0.0 if bits >> k & 1 else NEVER for bits in out] for k in range(len(self.entries))]).reshape(len(self.entries), len(self.exits))

    def trace(self, entry: int, exit_: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on the path between the two states."""
        state = self.entries[entry]
        ending, _ = self._reached([state])
        begin = self.low + state[1]
        if self.clean_end:
            at, piece = self.high, None
        else:
            piece, over = self.exits[exit_]
            at = self.high + over
        path: list[str] = []
        while at > begin:
            found = [p for p in ending[at] if (piece is None or p == piece) and at - len(p) >= begin]
            found = [p for p in found if not path or self.m.fits(p, path[-1])]
            piece = found[0]
            path.append(piece)
            at, piece = at - len(piece), None
        return [i for p in reversed(path) for i in self.m.ids(p)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def settle(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on the best path through all of them."""
    ahead = [np.zeros((1, matrices[0].shape[0]))]
    for m in matrices:
        ahead.append(product(ahead[-1], m))
    states = [int(ahead[-1][0].argmax())]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(int((ahead[k][0] + matrices[k][:, states[-1]]).argmax()))
    states.reverse()
    return list(zip(states[:-1], states[1:], strict=True))


def _ids_array(lists: list[list[int]]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


@lru_cache(2)
def _loaded(model: bytes) -> Model:
    return Model(model)


def _append(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], [*keep, name])


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose sizes add up to about ``most``, which bounds the Python lists made of them."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


CHUNKS = f"{RID} long, k int, before string, own string, after string, clean_start boolean, clean_end boolean"


def _chunk_rows(giants: DataFrame, size: int) -> DataFrame:
    """A row for each chunk of each text, with the context on both sides."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column(RID).to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = " " + text
                starts = [*split(text, size), (len(text), True)]
                rows = [
                    (rid, k, text[max(0, a - PIECE) : a], text[a:b], text[b : b + PIECE], x, y)
                    for k, ((a, x), (b, y)) in enumerate(zip(starts[:-1], starts[1:], strict=True))
                ]
                for low in range(0, len(rows), 64):
                    kinds = (pa.int64(), pa.int32(), *[pa.string()] * 3, pa.bool_(), pa.bool_())
                    columns = zip(*rows[low : low + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    return giants.select(RID, "text").mapInArrow(cut, CHUNKS)


def _chunk(model: Model, row: dict) -> Chunk:
    before, own, after = (row[c].replace(" ", MARK) for c in ("before", "own", "after"))
    before = "" if row["clean_start"] else before
    after = "" if row["clean_end"] else after
    return Chunk(model, before + own + after, len(before), len(before) + len(own), row["clean_start"], row["clean_end"])


def _giant_ids(giants: DataFrame, model: bytes, size: int) -> DataFrame:
    """RID and token_ids of texts of several chunks."""
    spark = giants.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = written(_chunk_rows(giants, size).repartition(parts, RID, "k"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in batches:
            rows = batch.to_pylist()
            made = [np.zeros((1, 1)) if r["clean_start"] and r["clean_end"] else _chunk(m, r).matrix() for r in rows]
            columns = [batch.column(RID), batch.column("k"), pa.array([x.shape[0] for x in made], pa.int32()), pa.array([x.ravel() for x in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [RID, "k", "n", "matrix"])

    transfer = chunks.mapInArrow(matrices, f"{RID} long, k int, n int, matrix array<double>")
    ordered = transfer.groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("k", "n", "matrix"))).alias("m"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, ms in zip(batch.column(RID).to_pylist(), batch.column("m").to_pylist(), strict=True):
                path = settle([np.array(x["matrix"]).reshape(x["n"], -1) for x in ms])
                entry, exit_ = zip(*path, strict=True)
                columns = [pa.array([rid] * len(path), pa.int64()), pa.array([x["k"] for x in ms], pa.int32()), pa.array(entry, pa.int32()), pa.array(exit_, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [RID, "k", "entry", "exit"])

    states = ordered.mapInArrow(combine, f"{RID} long, k int, entry int, exit int")
    traced = chunks.join(states, [RID, "k"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in batches:
            ids = [m.whole(r["own"]) if r["clean_start"] and r["clean_end"] else _chunk(m, r).trace(r["entry"], r["exit"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(RID), batch.column("k"), _ids_array(ids)], [RID, "k", "ids"])

    ids = traced.mapInArrow(trace, f"{RID} long, k int, ids array<int>")
    whole = ids.groupBy(RID).agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return whole.select(RID, F.flatten("parts.ids").alias("token_ids"))


def encode(docs: DataFrame, model_path: str | None = None, size: int = CHUNK) -> DataFrame:
    """``docs`` with ``token_ids``, the ids of ``text``."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    docs = docs.drop("token_ids")
    long = F.coalesce(F.length("text"), F.lit(0)) >= size

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column("text")), 1 << 18):
                texts = [" " + t if t else "" for t in part.column("text").to_pylist()]
                ids = [m.whole(t) for t in texts] if any(MARK in t for t in texts) else m.bare.encode(texts, num_threads=1)
                yield _append(part, "token_ids", _ids_array(ids))

    schema = _schema(docs, "token_ids", T.ArrayType(T.IntegerType()))
    done = docs.where(~long).mapInArrow(small, schema)
    giants = written(docs.where(long).withColumn(RID, F.monotonically_increasing_id()), "giants")
    return done.union(giants.join(_giant_ids(giants, model, size), RID).drop(RID).select(*done.columns))


def decode(encoded: DataFrame, model_path: str | None = None, to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``token_ids`` (null: empty) in the column ``to``."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(model)
        for batch in batches:
            for part in _slices(batch, pc.list_value_length(batch.column("token_ids")), 1 << 16):
                ids = pc.if_else(pc.is_valid(part.column("token_ids")), part.column("token_ids"), pa.scalar([], pa.list_(pa.int32()))).to_pylist()
                yield _append(part, to, pa.array(m.full.decode(ids, num_threads=1) if ids else [], pa.string()))

    return encoded.mapInArrow(back, _schema(encoded, to, T.StringType()))


def op2_sentencepiece(docs: DataFrame) -> DataFrame:
    """Per document: number and SHA-256 of its ids (comma-joined), and whether they decode to its text."""
    both = decode(encode(docs.select("doc_id", "text")))
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), same.alias("round_trip"))

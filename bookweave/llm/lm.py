"""Language-model scores by an n-gram trie in Elias-Fano form, built and asked in shards.

Model: words, pairs and triples of all training texts, nothing cut.  Interpolated absolute discounting over the
add-one unigram p1 = (c + 1) / (N + V + 1): a seen n-gram has (c - d) / c(context), and the context's weight
d * (different continuations) / c(context) times the shorter context's probability is added to it; an unseen
context leaves the shorter one.  A text's first token has p1; the second has the start in front of its context.
Every probability and weight is its log10 in steps of
1 / ``STEPS``, one byte; the steps are fixed, so equal counts give equal scores in a corpus of any size.

Jobs: texts are cut into words once and written in pieces of a bounded number of bytes, each with its own list of
words, in buckets by piece, so what is found for a piece goes to it and not the other way.  Counts of words come from those lists; frequent words have small numbers.  Counts and numbers of words from
one in a million on (a million at most) go to every task, the others are joined to the lists and go back to their
piece.  Then each token is dealt, as three numbers, to the shard of its context: there every count but the unigram's
is at home, and that is told by the number.  A word v seen ``SPLIT`` times or more has 1 + c(v) // SPLIT homes, chosen by a
hash of the word before it, so no shard holds it alone.  Triples are whole there, but not the pairs of v: these are counted
before, over all homes, and go to the shards that ask for them, so the model is the same whatever ``SPLIT`` is.
Numbers travel as planes of bytes, compressed.  A shard counts its training tokens, builds its trie (words, pairs and triples with ids relative to their
context) and answers all its tokens by successor search; answers are summed by text.  Shards have about
``TOKENS`` tokens, so their number grows with the corpus.  A lost executor's pieces, shards and answers are made anew
from the written tables.

Defined results: null text counts as empty and has the one end token; a null ``doc_id`` is neither held out
nor learned from; repeated rows each get their row; without training tokens every known count is 0; an empty
table gives an empty result; other columns pass, and those named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .eliasfano import STEPS, Trie, codes_of
from .shared import bucketed, tidy, written

U = np.uint64
END = U(0x2545F4914F6CDD1D)
START = U(0x51ED270B35AE2D19)
DISCOUNT = 0.75
#: Least share of the training tokens for words whose counts every task holds; it changes no result.
KNOWN = 1e-6
#: Bytes and rows of a piece (one longer text is a piece of its own), tokens of a shard, uses of a word in a home.
PIECE, ROWS, TOKENS, SPLIT = 16 << 20, 1 << 16, 1 << 20, 1 << 20
#: Shards for a part of the pairs of words of several homes.
SHARDS = 8
#: N-grams asked at a time.
ASKED = 1 << 16
MADE = ("n_tokens", "n_known", "base_score", "score")


def batch() -> int:
    """Bytes that go to Python at a time: a piece, which the last row of a batch seldom exceeds."""
    return PIECE * 15 // 16


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, and the texts' ranges."""
    starts, ends, at = W.bounds(data, offsets)
    out = np.insert(W.hashes(data, starts, ends), at[1:], END)
    return out, at + np.arange(len(at))


def _packed(x: np.ndarray) -> bytes:
    """Numbers under 2^40 as planes of their bytes, the lowest first; planes of zeros take next to nothing."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 5 * n, "zstd", asbytes=True), np.uint8).reshape(5, n) if n else np.zeros((5, 0), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    for k in range(5):
        if planes[k].any():
            out[:, k] = planes[k]
    return out.view("<i8").ravel()


def pieces(docs: DataFrame) -> DataFrame:
    """Texts (text, learn) in pieces: their other columns as lists ``x0``, ``x1``.., their tokens as places in the
    piece's words, the texts' ranges, and of each word its uses in texts to learn from."""
    names = [c for c in docs.columns if c not in ("text", "learn", *MADE)]
    kinds = [f"x{k} array<{docs.schema[c].dataType.simpleString()}>" for k, c in enumerate(names)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            columns = [batch.column(c) for c in names]
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            for low, high, data, offsets in W.chunks(batch.column("text"), PIECE):
                for a in range(low, high, ROWS):
                    b = min(a + ROWS, high)
                    own = offsets[a - low : b - low + 1]
                    hashes, at = tokens(data[own[0] : own[-1]], own - own[0])
                    found, code = np.unique(hashes, return_inverse=True)
                    uses = np.bincount(code[np.repeat(learn[a:b], np.diff(at))], minlength=len(found))
                    # The most frequent words first: small places for most tokens.
                    order = np.argsort(-np.bincount(code, minlength=len(found)), kind="stable")
                    place = np.empty(len(found), np.uint32)
                    place[order] = np.arange(len(found))
                    lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c.slice(a, b - a)) for c in columns]
                    words = [pa.array([x], pa.list_(pa.int64())) for x in (found[order].view(np.int64), uses[order].astype(np.int64))]
                    rest = [pa.array([_packed(x)]) for x in (place[code], np.diff(at), learn[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, *words, pa.array([len(code)]), *rest], ["piece", *(f"x{k}" for k in range(len(names))), "words", "uses", "n", "codes", "sizes", "learn"])
                    number += 1

    shape = ", ".join(["piece long", *kinds, "words array<long>, uses array<long>, n long, codes binary, sizes binary, learn binary"])
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col("text"), F.coalesce("learn", F.lit(False)).alias("learn")).mapInArrow(cut, shape)


class Vocabulary:
    """What tasks hold of the words: totals, the frequent words' counts and numbers, and where among the numbers the
    codes of p1 change.  ``slices``: parts of the table of counts, which number their words in turn; ``most``: uses of the
    most frequent word."""

    def __init__(self, n: int, v: int, slices: int, most: int, frequent: pa.Table, steps: pa.Table):
        self.n, self.v, self.slices, self.most = n, v, slices, most
        self.index = W.Index(frequent.column("hash").to_numpy().view(U))
        self.ids, self.counts = frequent.column("id").to_numpy(), frequent.column("c").to_numpy()
        key = steps.column("slice").to_numpy() << 40 | steps.column("first").to_numpy()
        order = np.argsort(key)
        self.key, self.code = key[order], codes_of(self.log(steps.column("c").to_numpy()[order]))

    def log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + self.v + 1))

    def log1(self, ids: np.ndarray) -> np.ndarray:
        """log10 of p1 of numbers."""
        code = np.full(len(ids), codes_of(self.log(np.zeros(1)))[0])
        at = np.flatnonzero(ids >= FIRST)
        row, part = np.divmod(ids[at] - FIRST, self.slices)
        code[at] = self.code[np.searchsorted(self.key, part << 40 | row, "right") - 1] if len(at) else code[at]
        return -code.astype(float) / STEPS


#: Numbers of words that no training text has, of the start, and of the first word.
UNSEEN, BEGIN, FIRST = 0, 1, 2


def vocabulary(table: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """What tasks hold, and (hash, c, id) of the words that they don't."""
    counts = table.select(F.inline(F.arrays_zip("words", "uses"))).where("uses > 0").groupBy(F.col("words").alias("hash")).agg(F.sum("uses").alias("c"))
    place = F.monotonically_increasing_id()
    counts = counts.sortWithinPartitions(F.desc("c"), "hash").select("hash", "c", F.shiftright(place, 33).alias("slice"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    counts = written(counts, "word-counts", compression="zstd")
    n, v, slices, most = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max("slice") + 1, F.lit(1)), F.coalesce(F.max("c"), F.lit(0))).first()
    counts = counts.withColumn("id", F.col("row") * slices + F.col("slice") + FIRST)
    # p1's code falls with c: at most 256 steps a slice.
    code = F.rint(-F.log10((F.col("c") + 1) / (n + v + 1)) * STEPS)
    steps = counts.groupBy("slice", code).agg(F.min("row").alias("first"), F.max("c").alias("c")).select("slice", "first", "c").toArrow()
    least = max(1, KNOWN * n)
    frequent = counts.where(F.col("c") >= least).select("hash", "c", "id").toArrow()
    return Vocabulary(n, v, slices, most, frequent, steps), counts.where(F.col("c") < least).select("hash", "c", "id")


def _frequent(spark: SparkSession, vocabulary) -> DataFrame:
    """Hashes of the words that every task holds, a million at most."""
    return spark.createDataFrame(pa.table({"hash": vocabulary.value.index.keys.view(np.int64)}))


def _known(table: DataFrame, vocabulary, rare: DataFrame) -> DataFrame:
    """Of each piece: counts and numbers of its words that not every task holds."""
    listed = table.select("piece", F.posexplode("words").alias("place", "hash"))
    known = listed.join(F.broadcast(_frequent(table.sparkSession, vocabulary)), "hash", "left_anti").join(rare, "hash")
    known = known.groupBy("piece").agg(F.collect_list(F.struct("place", "c", "id")).alias("known"))
    known = known.select("piece", *(F.col(f"known.{a}").alias(b) for a, b in (("place", "places"), ("c", "counts"), ("id", "ids"))))
    return bucketed(known, "piece-words", "piece", compression="zstd")


def _dealt(known: DataFrame, vocabulary, shards: int, parts: int = 0) -> DataFrame:
    """Tokens with the two before them, by shard, from ``shards`` on those after words of several homes; and a row of its
    own for each piece with its texts' n_tokens, n_known, base score and the first tokens' score.  ``parts``: instead,
    of the tokens after words of several homes, the different v, w and shard, and how many are learned from, by part."""
    names = ["shard", "piece", "u", "v", "w", "text", "learn"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = vocabulary.value

        def out(shard: int, piece: int, parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([piece]), *(pa.array([x], pa.binary()) for x in parts)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                piece = batch.column("piece")[i].as_py()
                words = batch.column("words")[i].values.to_numpy().view(U)
                code, sizes, learn = (_unpacked(batch.column(c)[i].as_py()) for c in ("codes", "sizes", "learn"))
                code = code.astype(np.int32)
                at = np.concatenate([[0], np.cumsum(sizes)])
                row = m.index.find(words)
                c, ids = np.zeros(len(words) + 1, np.int64), np.full(len(words) + 1, UNSEEN)
                c[np.flatnonzero(row >= 0)], ids[np.flatnonzero(row >= 0)] = m.counts[row[row >= 0]], m.ids[row[row >= 0]]
                if batch.column("places")[i].is_valid:
                    place = batch.column("places")[i].values.to_numpy()
                    c[place], ids[place] = (batch.column(x)[i].values.to_numpy() for x in ("counts", "ids"))
                log, homes = m.log(c), 1 + c // SPLIT
                sums = [np.add.reduceat(x, at[:-1]).astype(float) for x in ((c > 0)[code].astype(np.int64), log[code])]
                first = codes_of(log)[code[at[:-1]]].astype(float)
                if not parts:
                    yield out(-1 - piece, piece, [x.tobytes() for x in (sizes.astype(float), *sums, first)] + [b""])
                # The start stands behind the piece's own words.
                words, ids[-1] = np.append(words, START), BEGIN
                text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                place = np.arange(len(code), dtype=np.int32) - at.astype(np.int32)[text]
                later = place > 0
                if parts:
                    later[1:] &= (homes > 1)[code[:-1]]
                later = np.flatnonzero(later)
                u = np.where(place[later] > 1, code[later - 2], len(words) - 1)
                v, w, text = code[later - 1], code[later], text[later]
                del place, later
                home = W.mixed(words)[u] % homes.astype(U)[v]
                shard = (W.mixed(words[v] + home * W.BASE) % U(shards)).astype(np.int64) + shards * (homes > 1)[v]
                del home
                if parts:
                    one, same = np.unique((shard * len(words) + v) * len(words) + w, return_index=True, return_inverse=True)[1:]
                    columns = [ids[v[one]], ids[w[one]], shard[one], np.bincount(same, learn[text], len(one))]
                    yield from in_parts(parts, ["v", "w", "shard", "c"], columns)
                    continue
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(2 * shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[s] : cuts[s + 1]]
                    yield out(int(s), piece, [_packed(x) for x in (ids[u[own]], ids[v[own]], ids[w[own]], np.diff(text[own], prepend=0), learn[text[own]])])

    return known.mapInArrow(deal, "part long, v binary, w binary, shard binary, c binary" if parts else "shard long, piece long, " + ", ".join(f"{c} binary" for c in names[2:]))


def in_parts(parts: int, names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of numbers, the first two columns, and what belongs to them, dealt to parts by a hash of the pair."""
    part = (W.mixed(columns[0].astype(U) * W.BASE + columns[1].astype(U)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[p] : cuts[p + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([int(p)]), *(pa.array([_packed(x[own])]) for x in columns)], ["part", *names])


def pairs_of(rows: list[dict], *names: str) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *(_unpacked(r[c]) for r in rows)]) for c in names]


def _keys(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Numbers of pairs, in their order."""
    every = np.unique(np.concatenate([x for p in pairs for x in p]))
    return [np.searchsorted(every, v) * len(every) + np.searchsorted(every, w) for v, w in pairs]


def added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v, w and c of a part's pairs, in order, c added up and over 0."""
    v, w, c = pairs_of(rows, "v", "w", "c")
    one, same = np.unique(_keys((v, w))[0], return_index=True, return_inverse=True)[1:]
    c = np.bincount(same, c, len(one)).astype(np.int64)
    one = one[c > 0]
    return v[one], w[one], c[c > 0]


#: Of each v: its uses, how many different words follow, and how many of these once, twice, three and four times.
USES = ("u", "total", "kinds", "n1", "n2", "n3", "n4")
TOLD = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("v", "w", "c"))])


def uses_of(v: np.ndarray, c: np.ndarray) -> dict[str, bytes]:
    u, of = np.unique(v, return_inverse=True)
    sums = [np.bincount(of, x, len(u)).astype(np.int64) for x in (c, np.ones(len(c)), *(c == k for k in range(1, 5)))]
    return {name: _packed(x) for name, x in zip(USES, (u, *sums), strict=True)}


def uses(counted: DataFrame) -> pa.Table:
    """The sums of all parts' ``uses_of``: a row for each word of several homes."""
    u, *sums = pairs_of(counted.where("u IS NOT NULL").select(*USES).toArrow().to_pylist(), *USES)
    v, of = np.unique(u, return_inverse=True)
    return pa.table({"v": v, **{name: np.bincount(of, x, len(v)).astype(np.int64) for name, x in zip(USES[1:], sums, strict=True)}})


def told(rows: list[dict], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[dict]:
    """For each shard that asks for pairs of a part (``rows``), these and their counts."""
    v, w, shard = pairs_of(rows, "v", "w", "shard")
    asked, known = _keys((v, w), counts[:2])
    at = np.searchsorted(known, asked)
    hit = np.flatnonzero(np.append(known, -1)[at] == asked)
    shard, at = np.divmod(np.unique(shard[hit] * max(1, len(known)) + at[hit]), max(1, len(known)))
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    return [{"shard": int(shard[a]), **{c: _packed(x[at[a:b]]) for c, x in zip("vwc", counts, strict=True)}} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _followers(asked: DataFrame) -> tuple[DataFrame, pa.Table]:
    """Of words of several homes: (shard, v, w, c) of the pairs that a shard asks for, c counted over all homes; and
    ``uses``."""
    schema = pa.schema([*TOLD, *((c, pa.binary()) for c in USES)])

    def count(_: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = added(rows)
        return pa.Table.from_pylist([*told(rows, counts), uses_of(counts[0], counts[2])], schema=schema)

    every = asked.groupBy("part").applyInArrow(count, "shard long, " + ", ".join(f"{c} binary" for c in schema.names[1:]))
    every = written(every, "pairs", compression="zstd")
    return every.where("shard IS NOT NULL").select(*TOLD.names), uses(every)


def _counted(v: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Contexts of training tokens ``w`` after ``v``, their uses and different continuations, the pairs, as place of the
    context times ``size`` and w, and their counts."""
    pair, c2 = np.unique(v * size + w, return_counts=True)
    contexts, at = np.unique(pair // size, return_inverse=True)
    return contexts, np.bincount(at, c2, len(contexts)), np.bincount(at, minlength=len(contexts)), at * size + pair % size, c2


def _gathered(v: np.ndarray, every: np.ndarray, pairs: pa.Table, uses: pa.Table) -> tuple[np.ndarray, ...]:
    """As ``_counted``, of words of several homes: what ``_followers`` found."""
    contexts = np.unique(v)
    row = np.searchsorted(uses.column("v").to_numpy(), every[contexts])
    own, w, c = pairs_of(pairs.to_pylist(), "v", "w", "c")
    short = np.searchsorted(every[contexts], own) * len(every) + np.searchsorted(every, w)
    order = np.argsort(short)
    total, kinds = (uses.column(x).to_numpy()[row] for x in ("total", "kinds"))
    return contexts, total, kinds, short[order], c[order]


def _levels(u: np.ndarray, v: np.ndarray, w: np.ndarray, home: np.ndarray, counted: tuple[np.ndarray, ...], p1: np.ndarray) -> Trie:
    """The trie of training tokens ``w`` after ``u`` and ``v`` (ids under ``len(p1)``); ``home``: the place of v among the
    contexts of ``counted``.  First level: words, then contexts; second: pairs u, v, then the words after each context;
    third: the words after each pair."""
    size = len(p1)
    _, total, kinds, short, c2 = counted
    homes, at = len(total), short // size
    weight2 = np.log10(DISCOUNT * kinds / total)
    p2 = (c2 - DISCOUNT + DISCOUNT * kinds[at] * p1[short % size]) / total[at]
    pairs, pair = np.unique(u * size + v, return_inverse=True)
    own = np.zeros(len(pairs), np.int64)
    own[pair] = home
    full, c3 = np.unique(pair * size + w, return_counts=True)
    of = full // size
    total, kinds = np.bincount(of, c3, len(pairs)), np.bincount(of, minlength=len(pairs))
    lower = p2[np.searchsorted(short, own[of] * size + full % size)] if len(full) else np.zeros(0)
    p3 = (c3 - DISCOUNT + DISCOUNT * kinds[of] * lower) / total[of]
    levels = {
        1: {"gamma": np.concatenate([np.zeros(size), weight2])},
        2: {
            "context": np.concatenate([pairs // size, size + at]),
            "word": np.concatenate([pairs % size, short % size]),
            "prob": np.concatenate([np.zeros(len(pairs)), np.log10(p2)]),
            "gamma": np.concatenate([np.log10(DISCOUNT * kinds / total), np.zeros(len(short))]),
        },
        3: {"context": of, "word": full % size, "prob": np.log10(p3)},
    }
    return Trie.build(levels, {2: size + homes, 3: len(pairs) + len(short)})


def _asked(trie: Trie, u: np.ndarray, v: np.ndarray, w: np.ndarray, home: np.ndarray, log1: np.ndarray) -> np.ndarray:
    """log10 of the probability of each ``w`` after ``u`` and ``v``: the longest n-gram of the trie, and the weights
    of the longer contexts that it was not seen after."""
    known = home >= 0
    out = log1[w].copy()
    at = np.flatnonzero(known)
    node = trie.child(2, len(log1) + home[at], w[at])
    out[at] = np.where(node >= 0, trie.prob(2, np.maximum(node, 0)), trie.gamma(1, len(log1) + home[at]) + out[at])
    node = trie.child(2, u, v)
    at = np.flatnonzero(node >= 0)
    last = trie.child(3, node[at], w[at])
    out[at] = np.where(last >= 0, trie.prob(3, np.maximum(last, 0)), trie.gamma(2, node[at]) + out[at]) if len(at) else out[at]
    return out


def _answers(table: pa.Table, vocabulary: Vocabulary, followers: tuple[pa.Table, pa.Table] | None = None) -> pa.Table:
    """Of one shard: each piece's texts and the sums of their tokens' log10 probabilities, in steps.  ``followers``, of a
    shard of words of several homes: the pairs that it asks for, and those words' uses."""
    rows = table.to_pylist()
    if rows[0]["shard"] < 0:
        return pa.Table.from_pylist([{"piece": r["piece"], "n": r["u"], "known": r["v"], "base": r["w"], "first": r["text"]} for r in rows], schema=ANSWER)
    small = np.int32
    u, v, w = (np.concatenate([_unpacked(r[c]) for r in rows]) for c in "uvw")
    every = np.unique(np.concatenate([np.unique(x) for x in (u, v, w)]))
    u = np.searchsorted(every, u).astype(small)
    v = np.searchsorted(every, v).astype(small)
    w = np.searchsorted(every, w).astype(small)
    learn = np.concatenate([_unpacked(r["learn"]).astype(bool) for r in rows])
    log1 = vocabulary.log1(every)
    counted = _gathered(v, every, *followers) if followers else _counted(v[learn].astype(np.int64), w[learn], len(every))
    contexts = counted[0]
    home = np.searchsorted(contexts, v).astype(small)
    home = np.where(contexts[np.minimum(home, len(contexts) - 1)] == v, home, small(-1)) if len(contexts) else np.full(len(v), -1, small)
    trie = _levels(*(x[learn].astype(np.int64) for x in (u, v, w, home)), counted, 10.0**log1)
    del counted
    trie = Trie.mapped(*trie.pack())
    # Each different n-gram is asked once.
    pair = np.unique(u.astype(np.int64) * len(every) + v, return_inverse=True)[1]
    one, same = np.unique(pair * len(every) + w, return_index=True, return_inverse=True)[1:]
    del pair
    steps = np.empty(len(one), small)
    for a in range(0, len(one), ASKED):
        own = one[a : a + ASKED]
        steps[a : a + ASKED] = np.rint(-STEPS * _asked(trie, *(x[own].astype(np.int64) for x in (u, v, w, home)), log1))
    steps, out, begin = steps[same], [], 0
    for r in rows:
        texts, place = np.unique(np.cumsum(_unpacked(r["text"])), return_inverse=True)
        sums = np.bincount(place, steps[begin : begin + len(place)])
        begin += len(place)
        out.append({"piece": r["piece"], "text": _packed(np.diff(texts, prepend=0)), "sum": _packed(sums)})
    return pa.Table.from_pylist(out, schema=ANSWER)


ANSWER = pa.schema([("piece", pa.int64()), *((c, pa.binary()) for c in ("text", "sum", "n", "known", "base", "first"))])


def score(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (text, learn, ..) without these two, with n_tokens, n_known, base_score and score by the model of the
    texts to learn from; and the number of its tokens."""
    with tidy(docs.sparkSession, batch()):
        return _score(docs)


def _score(docs: DataFrame) -> tuple[DataFrame, int]:
    names = [c for c in docs.columns if c not in ("text", "learn", *MADE)]
    table = bucketed(pieces(docs), "pieces", "piece", compression="zstd")
    words, rare = vocabulary(table)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    size = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-size // TOKENS))
    known = table.select("piece", "words", "codes", "sizes", "learn").join(_known(table, shared, rare), "piece", "left")
    dealt, shape = _dealt(known, shared, shards).groupBy("shard"), "piece long, text binary, sum binary, n binary, known binary, base binary, first binary"
    if words.most < SPLIT:
        found = dealt.applyInArrow(lambda _, rows: _answers(rows, shared.value), shape)
    else:
        pairs, used = _followers(_dealt(known, shared, shards, max(1, shards // SHARDS)))

        def answers(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
            return _answers(rows, shared.value, (own, used) if key[0].as_py() >= shards else None)

        found = dealt.cogroup(pairs.groupBy("shard")).applyInArrow(answers, shape)
    found = written(found, "answers", compression="zstd")
    found = found.groupBy("piece").agg(F.collect_list(F.struct("text", "sum")).alias("sums"), *(F.max(c).alias(c) for c in ("n", "known", "base", "first")))
    lists = table.select("piece", *(f"x{k}" for k in range(len(names)))).join(found, "piece")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, known, base, total = (np.frombuffer(batch.column(c)[i].as_py()) for c in ("n", "known", "base", "first"))
                total = total.copy()
                for part in batch.column("sums")[i].as_py():
                    if part["text"] is not None:
                        total[np.cumsum(_unpacked(part["text"]))] += _unpacked(part["sum"])
                columns = [batch.column(f"x{k}")[i].values for k in range(len(names))]
                made = [pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(-total / STEPS)]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*names, *MADE])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return lists.mapInArrow(rows, ", ".join([*kinds, "n_tokens long, n_known long, base_score double, score double"])), words.n


def op8_lm(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    found, n = score(docs.withColumn("learn", ~F.col("held_out") & F.col("doc_id").isNotNull()))
    return found.withColumn("train_tokens", F.lit(n).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

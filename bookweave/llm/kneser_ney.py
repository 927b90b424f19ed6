"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

Training: the texts of half of the trusted documents, chosen by a hash, all of them and whole, with two starts and an
end.  Counts, the continuation counts of the lower orders, the discounts D1, D2, D3+ of each order and the weights of
contexts are those of all these texts.  A word used ``SPLIT`` times or more in them has several homes (as in ``lm``), by
a hash of the word before it, so no shard holds a frequent word alone; its pairs' counts are added up over all homes.

Jobs: every text is cut into words once, in pieces (``lm.pieces``); labels go to the pieces.  Pairs of neighbours give
the words' continuation counts, which go back to the pieces (frequent words' to every task).  Training tokens are dealt
by their context to shards, which count how many n-grams occur one to four times, for the discounts, and the pairs of
words of several homes; of the latter's sums a shard gets those that it asks for.  Then the tokens of
every text are dealt so, but for those after words without a use in training, whose probability the piece knows; a shard
counts its training tokens and answers all its tokens, and answers are summed by text, in steps of 1 / ``STEP`` of log10.
Pairs and words go by hash in ``WORD_PARTS`` parts, shards in ``PARTS``: each part is a statement whose shuffle files go when it
ends (``tidy``) and whose result is written, so the disk holds the pieces and one part of what is shuffled, not all of it.
Nothing that grows with the corpus is in one place but the pieces and shards.  A document's perplexity is 10 to the mean
negative log10 probability of its tokens.  ``fit`` makes the same model of a few texts as one object.

Thresholds: half of the trusted documents, by a hash, are never learned from.  For each language ``slack``
times the ``quantile`` of their perplexities is the limit (of all languages together where a language has
none); documents above are rejected.

Toxic texts are ordinary prose but for a few words, which perplexity does not show.  A second model is that of the words
alone (continuations; longer n-grams are those of the few toxic texts, insult or not) of half of the documents labelled
toxic, all of them.  A document's ratio is the highest sum, over runs of ``WINDOW`` tokens, of log10 of toxic over
trusted probability of the words and 0 for words that the toxic model has not seen; above the ``toxic_quantile`` of the
ratios of the trusted documents kept out (by language as above) it is rejected.

Defined results: null text counts as empty and is not learned from, and a text without words has the end token only; it
is kept, as its perplexity says nothing.  A null language is a language of its own.  Without any trusted text there is no
model: perplexity null, all kept; without any toxic text the ratio decides nothing.  Repeated rows are judged alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lm
from . import words as W
from .lm import BEGIN, FIRST, UNSEEN, _packed, _unpacked, pieces
from .shared import bucketed, tidy, written

U = np.uint64
#: Tokens over which the ratio of the two models is summed.
WINDOW = 4
START, END = U(0x51ED270B35AE2D19), U(0x2545F4914F6CDD1D)
#: Uses in training of a word in a home (every text asks it, so fewer than in ``lm``), and steps of answers.
SPLIT, STEP = 1 << 17, 1 << 10
#: Parts, one after the other, in which words are counted and looked up, and shards asked.
WORD_PARTS, PARTS = 2, 4
#: What a document is: learned from as trusted, learned from as toxic, trusted and kept out.
TRUSTED, TOXIC, KEPT_OUT = 1, 2, 4


def _sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each with two starts in front and an end; which tokens are starts."""
    starts, ends, at = W.bounds(data, offsets)
    own = np.insert(W.hashes(data, starts, ends), at[1:], END)
    begins = np.repeat(at[:-1] + np.arange(len(at) - 1), 2)
    out = np.insert(own, begins, START)
    first = np.zeros(len(out), bool)
    place = begins + np.arange(len(begins))
    first[place] = True
    return out, first


def _joined(*parts: np.ndarray) -> np.ndarray:
    """One hash for n-grams, from the hash of all but the last word and the last word."""
    h = np.zeros(len(parts[0]), U)
    for p in parts:
        h = W.mixed(h * W.BASE + p + U(1))
    return h


def _ngrams(texts: DataFrame) -> DataFrame:
    """u, v, w (hashes of words) and c: counted trigrams of all texts, combined in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column("text")):
                t, first = _sequences(data, offsets)
                at = np.flatnonzero(~first)
                _, i, n = np.unique(_joined(t[at - 2], t[at - 1], t[at]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(t[at[i] - k].view(np.int64)) for k in (2, 1, 0)), pa.array(n.astype(np.int64))], ["u", "v", "w", "c"])

    return texts.select("text").mapInArrow(count, "u long, v long, w long, c long").groupBy("u", "v", "w").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur one to four times."""
    return _three(counts.agg(*(F.sum((F.col("c") == k).cast("long")) for k in range(1, 5))).first())


def _three(n) -> tuple[float, float, float]:
    n = [0, *(x or 0 for x in n)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(x, 0.1), k - 0.05) for k, x in enumerate(d, 1))


def _order(counts: DataFrame, context: list[str], word: str) -> DataFrame:
    """``counts`` with the discounted share of each n-gram in its context, and the context's weight."""
    d1, d2, d3 = _discounts(counts)
    off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    cut = counts.withColumn("off", off)
    totals = cut.groupBy(*context).agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("weight"))
    joined = cut.join(totals, context) if context else cut.crossJoin(F.broadcast(totals))
    return joined.select(*context, word, ((F.col("c") - F.col("off")) / F.col("total")).alias("share"), "weight")


class Model:
    """Tables of log10 probabilities of seen n-grams and of the weights of seen contexts, by hash, in shards."""

    def __init__(self, floor: float, tables: list[tuple[np.ndarray, np.ndarray]], shards: int):
        self.floor, self.shards = floor, shards
        self.parts = []
        for keys, values in tables:
            shard = (keys % U(shards)).astype(np.int64)
            self.parts.append([(W.Index(keys[shard == s]), values[shard == s].astype(np.float32)) for s in range(shards)])

    def look(self, table: int, keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys, and which were found: shard by shard."""
        out, found = np.full(len(keys), missing), np.zeros(len(keys), bool)
        shard = (keys % U(self.shards)).astype(np.int64)
        for s, (index, values) in enumerate(self.parts[table]):
            own = np.flatnonzero(shard == s) if self.shards > 1 else np.arange(len(keys))
            at = index.find(keys[own])
            hit = at >= 0
            out[own[hit]], found[own[hit]] = values[at[hit]], True
        return out, found

    def logs(self, t: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token of ``_sequences`` that is no start."""
        at = np.flatnonzero(~first)
        u, v, w = t[at - 2], t[at - 1], t[at]
        p, _ = self.look(0, _joined(w), self.floor)
        for table, gram, context in ((1, (v, w), (v,)), (2, (u, v, w), (u, v))):
            weight, _ = self.look(2 + table, _joined(*context), 0.0)
            own, seen = self.look(table, _joined(*gram), 0.0)
            p = np.where(seen, own, p + weight)
        return p


def _highest(x: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text the highest sum of a run of ``WINDOW`` values (of all where it has fewer)."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    begin = np.maximum(np.repeat(begins.astype(np.int32), n), np.arange(1 - WINDOW, len(x) + 1 - WINDOW, dtype=np.int32))
    return np.maximum.reduceat(sums[1:] - sums[begin], begins) if len(x) else np.zeros(0)


def _arrays(df: DataFrame, key: list[str], value: str) -> tuple[np.ndarray, np.ndarray]:
    t = df.select(*key, value).toArrow()
    return _joined(*(t.column(k).to_numpy().view(U) for k in key)), t.column(value).to_numpy()


def fit(trusted: DataFrame, shards: int = 4) -> Model | None:
    """The model of a few texts as one object, in the driver's memory; ``judged`` has no such bound."""
    grams = written(_ngrams(trusted), "trigrams")
    if grams.isEmpty():
        return None
    pairs = grams.groupBy("v", "w").agg(F.count("*").alias("c"))
    singles = pairs.groupBy("w").agg(F.count("*").alias("c"))
    v = singles.count()
    low = _order(singles, [], "w")
    p1 = low.select("w", (F.col("share") + F.col("weight") / (v + 1)).alias("p1"), (F.col("weight") / (v + 1)).alias("floor"))
    p1 = written(p1, "order-1")
    mid = _order(pairs, ["v"], "w").join(p1, "w")
    p2 = written(mid.select("v", "w", (F.col("share") + F.col("weight") * F.col("p1")).alias("p2"), "weight"), "order-2")
    high = _order(grams, ["u", "v"], "w").join(p2.drop("weight"), ["v", "w"])
    p3 = written(high.select("u", "v", "w", (F.col("share") + F.col("weight") * F.col("p2")).alias("p3"), "weight"), "order-3")
    log = lambda df, c: df.withColumn(c, F.log10(c))
    tables = [
        _arrays(log(p1, "p1"), ["w"], "p1"),
        _arrays(log(p2, "p2"), ["v", "w"], "p2"),
        _arrays(log(p3, "p3"), ["u", "v", "w"], "p3"),
        _arrays(log(p2.groupBy("v").agg(F.first("weight").alias("weight")), "weight"), ["v"], "weight"),
        _arrays(log(p3.groupBy("u", "v").agg(F.first("weight").alias("weight")), "weight"), ["u", "v"], "weight"),
    ]
    return Model(math.log10(p1.first()["floor"]), tables, shards)


def _off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


class Unigrams:
    """Probabilities of words by their continuation counts; ``n``: how many words have the counts 1 to 4."""

    def __init__(self, total: int, kinds: int, n: list[int]):
        self.total, self.d = total, _three(n)
        self.floor = (self.d[0] * n[0] + self.d[1] * n[1] + self.d[2] * (kinds - n[0] - n[1])) / total / (kinds + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return (c - _off(c, self.d)) / self.total + self.floor


class Words:
    """What tasks hold of the words: totals, the frequent words' counts and numbers, and where among the numbers, which
    fall with c in each of ``slices`` parts of the table, c changes.  c: continuations in trusted texts, t: in toxic ones,
    f: uses as a trusted text's first word, m: uses in trusted texts."""

    def __init__(self, totals: dict, frequent: pa.Table, steps: pa.Table):
        each = lambda c: [totals[f"{c}{k}"] or 0 for k in range(1, 5)]
        self.good, self.bad = (Unigrams(totals[c], totals[f"{c}_kinds"], each(c)) if totals[c] else None for c in "ct")
        self.docs, self.firsts, self.first_n, self.tokens, self.slices = totals["f"] or 0, totals["f_kinds"] or 0, each("f"), totals["m"] or 0, totals["slices"]
        self.index = W.Index(frequent.column("hash").to_numpy().view(U))
        self.of = {c: frequent.column(c).to_numpy() for c in ("c", "t", "f", "m", "id")}
        key = steps.column("slice").to_numpy() << 40 | steps.column("first").to_numpy()
        order = np.argsort(key)
        self.key, self.counts = key[order], steps.column("c").to_numpy()[order]
        self.d2 = self.d3 = self.uses = None

    def p1(self, ids: np.ndarray) -> np.ndarray:
        c = np.zeros(len(ids), np.int64)
        at = np.flatnonzero(ids >= FIRST)
        if len(at):
            row, part = np.divmod(ids[at] - FIRST, self.slices)
            c[at] = self.counts[np.searchsorted(self.key, part << 40 | row, "right") - 1]
        return self.good.p(c)

    def opening(self, f: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """Probabilities of words as a text's first: after two starts, then one, whose only context is the start."""
        p2 = (f > 0) * (1 - self.d2[0]) / self.firsts + self.d2[0] * p1
        kinds = [*self.first_n[:2], self.firsts - sum(self.first_n[:2])]
        return (f - _off(f, self.d3)) / self.docs + sum(d * k for d, k in zip(self.d3, kinds, strict=True)) / self.docs * p2


def _labelled(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each piece: which of its ``texts`` are learned from or kept out (``flags``)."""
    good = F.bool_or(F.coalesce(F.expr("quality = 1 AND coalesce(toxic, 0) = 0"), F.lit(False)))
    bad = F.bool_or(F.coalesce(F.expr("toxic = 1"), F.lit(False)))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    flag = F.when(F.col("good"), F.when(half, TRUSTED).otherwise(KEPT_OUT)).otherwise(0) + F.when(F.col("bad") & half, TOXIC).otherwise(0)
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(good.alias("good"), bad.alias("bad")).select("doc_id", flag.alias("flag")).where("flag > 0")
    rows = table.select("piece", F.posexplode(F.arrays_zip("x0", "x2")).alias("text", "row")).where("row.x2").select("piece", "text", F.col("row.x0").alias("doc_id"))
    marks = rows.join(flags, "doc_id").groupBy("piece").agg(F.collect_list(F.struct("text", "flag")).alias("m"))
    return bucketed(marks.select("piece", F.col("m.text").alias("texts"), F.col("m.flag").alias("flags")), "piece-labels", "piece", compression="zstd")


def _piece(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece: its words and the start, its tokens as places among them, the texts' sizes and flags, and of each token its text."""
    words = np.append(batch.column("words")[i].values.to_numpy().view(U), START)
    code, sizes = _unpacked(batch.column("codes")[i].as_py()).astype(np.int32), _unpacked(batch.column("sizes")[i].as_py())
    flag = np.zeros(len(sizes), np.int64)
    if batch.column("texts")[i].is_valid:
        flag[batch.column("texts")[i].values.to_numpy()] = batch.column("flags")[i].values.to_numpy()
    return words, code, sizes, flag, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _pairs(marked: DataFrame, parts: int, part: int) -> DataFrame:
    """kind, v, w (hashes) and c: counted pairs of neighbours in the texts learned from, of the words w of a part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, code, sizes, flag, text = _piece(batch, i)
                before = np.append(len(words) - 1, code[:-1]).astype(np.int64)
                before[np.cumsum(sizes)[:-1]] = len(words) - 1
                mine = (words % U(parts) == part)[code]
                for kind in (TRUSTED, TOXIC):
                    own = np.flatnonzero(((flag & kind) > 0)[text] & mine)
                    key, n = np.unique(before[own] * len(words) + code[own], return_counts=True)
                    columns = [np.full(len(key), kind), *(words[x].view(np.int64) for x in (key // len(words), key % len(words))), n.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "v", "w", "c"])

    counted = marked.select("words", "codes", "sizes", "texts", "flags").mapInArrow(count, "kind long, v long, w long, c long")
    return counted.groupBy("kind", "v", "w").agg(F.sum("c").alias("c"))


def _counted(pairs: DataFrame, parts: int, part: int) -> DataFrame:
    """hash, c, t, f and m of a part's words, and their rows in slices that no other part has."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    start = F.col("v") == int(START.view(np.int64))
    counts = pairs.groupBy(F.col("w").alias("hash")).agg(
        of(TRUSTED, 1).alias("c"), of(TOXIC, 1).alias("t"), of(TRUSTED, F.when(start, F.col("c")).otherwise(0)).alias("f"), of(TRUSTED, F.col("c")).alias("m"))
    place = F.monotonically_increasing_id()
    counts = counts.sortWithinPartitions(F.desc("c"), "hash").select("*", (F.shiftright(place, 33) * parts + part).alias("slice"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    return written(counts, "word-counts", compression="zstd")


def _words(marked: DataFrame) -> tuple[Words, DataFrame]:
    """What tasks hold, and (hash, c, t, f, id) of the words that they don't."""
    counts = reduce(DataFrame.unionAll, [_counted(_pairs(marked, WORD_PARTS, part), WORD_PARTS, part) for part in range(WORD_PARTS)])
    sums = [F.sum(c).alias(c) for c in "ctfm"] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in "ctf"]
    sums += [F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in "ctf" for k in range(1, 5)]
    totals = counts.agg(*sums, F.coalesce(F.max("slice") + 1, F.lit(1)).alias("slices")).first().asDict()
    counts = counts.withColumn("id", F.col("row") * totals["slices"] + F.col("slice") + FIRST)
    steps = counts.groupBy("slice", "c").agg(F.min("row").alias("first")).select("slice", "first", "c").toArrow()
    least = max(1, lm.KNOWN * (totals["m"] or 0))
    frequent = counts.where(F.col("m") >= least).select("hash", "c", "t", "f", "m", "id").toArrow()
    return Words(totals, frequent, steps), counts.where(F.col("m") < least).select("hash", "c", "t", "f", "id")


def _known(table: DataFrame, frequent: DataFrame, rare: DataFrame, parts: int, part: int) -> DataFrame:
    """Of each piece: counts and numbers of its words of a part that not every task holds."""
    mine = F.pmod("hash", F.lit(parts)) == part
    listed = table.select("piece", F.posexplode("words").alias("place", "hash")).where(mine)
    known = listed.join(F.broadcast(frequent), "hash", "left_anti").join(rare.where(mine), "hash")
    known = known.groupBy("piece").agg(F.collect_list(F.struct("place", "c", "t", "f", "id")).alias("k"))
    return bucketed(known.select("piece", *(F.col(f"k.{c}").alias(f"k{part}_{c}") for c in KNOWN)), "piece-words", "piece", compression="zstd")


KNOWN = ("place", "c", "t", "f", "id")
NAMES = ["shard", "piece", "u", "v", "w", "text", "learn"]


def _dealt(marked: DataFrame, shared, shards: int, training: bool, parts: int = 1, part: int = 0, pairs: int = 0) -> DataFrame:
    """Tokens after words that training texts have, with the two before them, by shard, from ``shards`` on those after words
    of several homes, for the shards of a part: of the texts learned from, or of all; then there is in part 0 a row of its
    own for each piece, with its texts' sizes, flags, log10 probability of the other tokens, and ratios.  ``pairs``:
    instead, of the tokens after words of several homes, the different v, w and shard of each piece, in so many parts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def out(shard: int, piece: int, parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([piece]), *(pa.array([x], pa.binary()) for x in parts)], NAMES)

        for batch in batches:
            for i in range(batch.num_rows):
                piece = batch.column("piece")[i].as_py()
                words, code, sizes, flag, text = _piece(batch, i)
                row = m.index.find(words)
                of = {}
                for c, values in m.of.items():
                    of[c] = np.full(len(words), UNSEEN if c == "id" else 0, np.int64)
                    of[c][row >= 0] = values[row[row >= 0]]
                    for k in range(WORD_PARTS):
                        if c != "m" and batch.column(f"k{k}_place")[i].is_valid:
                            of[c][batch.column(f"k{k}_place")[i].values.to_numpy()] = batch.column(f"k{k}_{c}")[i].values.to_numpy()
                of["id"][-1] = BEGIN
                at = np.concatenate([[0], np.cumsum(sizes)])
                place = np.arange(len(code), dtype=np.int32) - at.astype(np.int32)[text]
                first = place == 0
                known = ~first
                known[1:] &= of["c"][code[:-1]] > 0
                learn = (flag & TRUSTED > 0)[text]
                if not training and part == 0 and not pairs:
                    log, ratio = np.zeros(len(code)), b""
                    if m.good:
                        p1, left = m.good.p(of["c"]), np.flatnonzero(~known)
                        log[left] = np.log10(np.where(first[left], m.opening(of["f"], p1)[code[left]], p1[code[left]]))
                    log = np.add.reduceat(log, at[:-1])
                    if m.good and m.bad:
                        ratios = np.where(of["t"] > 0, np.log10(m.bad.p(of["t"]) / p1), 0.0)
                        ratio = _highest(ratios[code], at[:-1], sizes).tobytes()
                    yield out(-1 - piece, piece, [sizes.tobytes(), flag.tobytes(), log.tobytes(), ratio, b""])
                # Of a word with one home, the shard is that of the word.
                several, mixed = of["m"] >= SPLIT, W.mixed(words)
                shard_of = (mixed % U(shards)).astype(np.int64)
                mine = several if pairs else several | (shard_of % parts == part)
                known[1:] &= mine[code[:-1]]
                own = np.flatnonzero(known & learn if training else known)
                u = np.where(place[own] > 1, code[own - 2], len(words) - 1)
                v, w = code[own - 1], code[own]
                shard = shard_of[v]
                at = np.flatnonzero(several[v])
                home = mixed[u[at]] % (1 + of["m"] // SPLIT)[v[at]].astype(U)
                shard[at] = (W.mixed(words[v[at]] + home * W.BASE) % U(shards)).astype(np.int64) + shards
                if pairs:
                    one = np.unique((shard * len(words) + v) * len(words) + w, return_index=True)[1]
                    yield from lm.in_parts(pairs, ["v", "w", "shard"], [of["id"][v[one]], of["id"][w[one]], shard[one]])
                    continue
                left = np.flatnonzero(shard % parts == part)
                own, u, v, w, shard = (x[left] for x in (own, u, v, w, shard))
                text = text[own]
                # Numbers of two bytes are sorted much faster.
                order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 15 else shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(2 * shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    x = order[cuts[s] : cuts[s + 1]]
                    ids = (of["id"][y[x]] for y in (u, v, w))
                    yield out(int(s), piece, [_packed(y) for y in (*ids, np.diff(text[x], prepend=0), learn[own[x]])])

    return marked.select("piece", "words", "codes", "sizes", "texts", "flags", *(f"k{k}_{c}" for k in range(WORD_PARTS) for c in KNOWN)).mapInArrow(
        deal, "part long, v binary, w binary, shard binary" if pairs else "shard long, piece long, " + ", ".join(f"{c} binary" for c in NAMES[2:]))


def _distinct(x: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which is slower on numbers without its other results, as it hashes them first."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Shard:
    """The different n-grams of a shard's tokens and their counts in training: ``c3`` of triples, ``c2`` of pairs (how
    many words come before), of ``tokens``' triples the index."""

    def __init__(self, rows: list[dict]):
        u, v, w = (np.concatenate([_unpacked(r[c]) for r in rows]) for c in "uvw")
        learn = np.concatenate([_unpacked(r["learn"]).astype(bool) for r in rows])
        self.ids = _distinct(np.concatenate([_distinct(x) for x in (u, v, w)]))
        u = np.searchsorted(self.ids, u).astype(np.int32)
        v = np.searchsorted(self.ids, v).astype(np.int32)
        w = np.searchsorted(self.ids, w).astype(np.int32)
        size = len(self.ids)
        before, pair = np.unique(u.astype(np.int64) * size + v, return_inverse=True)
        del u, v
        contexts, of = np.unique(before % size, return_inverse=True)
        self.v = self.ids[contexts]
        pair *= size
        pair += w
        full, self.tokens = np.unique(pair, return_inverse=True)
        del pair, w
        self.c3 = np.bincount(self.tokens[learn], minlength=len(full))
        self.before, self.word = full // size, full % size
        short, self.short = np.unique(of[self.before] * size + self.word, return_inverse=True)
        self.c2 = np.bincount(self.short[self.c3 > 0], minlength=len(short))
        self.context, self.short_word = short // size, short % size

    def seen(self) -> list[int]:
        """How many pairs, then triples, have the counts 1 to 4."""
        return [int(n) for c in (self.c2, self.c3) for n in np.bincount(np.minimum(c, 5), minlength=6)[1:5]]

    def pairs(self) -> list[np.ndarray]:
        """v, w and count of the pairs in training."""
        own = np.flatnonzero(self.c2)
        return [self.v[self.context[own]], self.ids[self.short_word[own]], self.c2[own]]

    def logs(self, m: Words, pairs: list[dict] | None = None) -> np.ndarray:
        """log10 probability of each token.  ``pairs``, of a shard of words of several homes: counts over all of them."""
        c2, sums = self.c2, None
        if pairs is not None:
            v, w, c = lm.pairs_of(pairs, "v", "w", "c")
            c2 = np.zeros(len(c2), np.int64)
            c2[np.searchsorted(self.context * len(self.ids) + self.short_word, np.searchsorted(self.v, v) * len(self.ids) + np.searchsorted(self.ids, w))] = c
            row = np.searchsorted(m.uses.column("v").to_numpy(), self.v)
            total, kinds, n1, n2 = (m.uses.column(x).to_numpy()[row] for x in ("total", "kinds", "n1", "n2"))
            sums = total.astype(float), sum(d * k for d, k in zip(m.d2, (n1, n2, kinds - n1 - n2), strict=True))
        p = _level(c2, self.context, m.d2, m.p1(self.ids)[self.short_word], sums)
        return np.log10(_level(self.c3, self.before, m.d3, p[self.short]))[self.tokens]


def _level(c: np.ndarray, context: np.ndarray, d: tuple[float, float, float], lower: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Probabilities of n-grams by their counts, contexts and the shorter ones' probabilities.  ``sums``: the contexts'
    counts and discounts, where not all of their n-grams are here."""
    off = _off(c, d)
    total, cut = sums or (np.bincount(context, c), np.bincount(context, off))
    some = total > 0
    total[~some], cut[~some] = 1, 1
    return (c - off) / total[context] + (cut / total)[context] * lower


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, ratio and flag of each row of ``docs``."""
    with tidy(docs.sparkSession, lm.batch()):
        return _judged(docs, labels)


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", F.col("text").isNotNull().alias("given"), "text", F.lit(False).alias("learn"))
    table = bucketed(pieces(docs), "pieces", "piece", compression="zstd")
    marked = table.join(_labelled(table, labels), "piece", "left")
    words, rare = _words(marked.where("texts IS NOT NULL"))
    frequent = spark.createDataFrame(pa.table({"hash": words.index.keys.view(np.int64)}))
    for part in range(WORD_PARTS):
        marked = marked.join(_known(table, frequent, rare, WORD_PARTS, part), "piece", "left")
    several = words.good is not None and int(words.of["m"].max(initial=0)) >= SPLIT
    size = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = max(1, -(-size // lm.TOKENS))
    pair_parts = max(1, every // lm.SHARDS)
    if words.good:
        shards = max(1, -(-words.tokens // lm.TOKENS))
        seen = pa.schema([*((f"n{k}", pa.int64()) for k in range(8)), ("part", pa.int64()), *((c, pa.binary()) for c in "vwc")])

        def count(key: tuple, rows: pa.Table) -> pa.Table:
            shard = Shard(rows.to_pylist())
            n, pairs = shard.seen(), []
            if key[0].as_py() >= shards:
                n[:4] = [0] * 4
                pairs = [r for x in lm.in_parts(pair_parts, ["v", "w", "c"], shard.pairs()) for r in x.to_pylist()]
            return pa.Table.from_pylist([{f"n{k}": x for k, x in enumerate(n)}, *pairs], schema=seen)

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            v, w, c = lm.added(rows.to_pylist())
            return pa.Table.from_pylist([{"part": key[0].as_py(), "v": _packed(v), "w": _packed(w), "c": _packed(c), **lm.uses_of(v, c)}])

        binary = lambda *names: ", ".join(f"{c} binary" for c in names)
        dealt = _dealt(marked, spark.sparkContext.broadcast(words), shards, True).groupBy("shard")
        counted = dealt.applyInArrow(count, ", ".join(f"n{k} long" for k in range(8)) + ", part long, " + binary(*"vwc"))
        counted = written(counted, "training-counts", compression="zstd") if several else counted
        n = [x or 0 for x in counted.agg(*(F.sum(f"n{k}") for k in range(8))).first()]
        if several:
            pairs = counted.where("part IS NOT NULL").select("part", *"vwc").groupBy("part").applyInArrow(add, "part long, " + binary(*"vwc", *lm.USES))
            pairs = written(pairs, "pairs", compression="zstd")
            words.uses = lm.uses(pairs)
            n[:4] = [a + sum(words.uses.column(f"n{k}").to_pylist()) for k, a in enumerate(n[:4], 1)]
        # The start's n-grams are in no shard: each first word is one pair.
        words.d2 = _three([n[0] + words.firsts, *n[1:4]])
        words.d3 = _three([a + b for a, b in zip(n[4:], words.first_n, strict=True)])
    shared = spark.sparkContext.broadcast(words)
    answer = pa.schema([("piece", pa.int64()), *((c, pa.binary()) for c in ("text", "sum", "n", "flag", "base", "ratio"))])

    shards, found = every, []

    def answers(_: tuple, table: pa.Table, pairs: pa.Table | None = None) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["shard"] < 0:
            return pa.Table.from_pylist([{"piece": r["piece"], "n": r["u"], "flag": r["v"], "base": r["w"], "ratio": r["text"]} for r in rows], schema=answer)
        logs = Shard(rows).logs(shared.value, pairs.to_pylist() if rows[0]["shard"] >= shards else None)
        steps, out, begin = np.rint(-STEP * logs).astype(np.int64), [], 0
        for r in rows:
            texts, place = np.unique(np.cumsum(_unpacked(r["text"])), return_inverse=True)
            sums = np.zeros(len(texts), np.int64)
            np.add.at(sums, place, steps[begin : begin + len(place)])
            begin += len(place)
            out.append({"piece": r["piece"], "text": _packed(np.diff(texts, prepend=0)), "sum": _packed(sums)})
        return pa.Table.from_pylist(out, schema=answer)

    if several:
        def tell(_: tuple, asked: pa.Table, counted: pa.Table) -> pa.Table:
            return pa.Table.from_pylist(lm.told(asked.to_pylist(), lm.pairs_of(counted.to_pylist(), "v", "w", "c")), schema=lm.TOLD)

        asked = _dealt(marked, shared, shards, False, pairs=pair_parts).groupBy("part").cogroup(pairs.select("part", *"vwc").groupBy("part"))
        pairs = written(asked.applyInArrow(tell, "shard long, " + binary(*"vwc")), "asked-pairs", compression="zstd")
    shape = "piece long, " + ", ".join(f"{c} binary" for c in answer.names[1:])
    for part in range(parts := min(PARTS, shards)):
        asked = _dealt(marked, shared, shards, False, parts, part).groupBy("shard")
        if several:
            own = pairs.where(F.pmod("shard", F.lit(parts)) == part).groupBy("shard")
            asked = asked.cogroup(own).applyInArrow(lambda key, rows, own: answers(key, rows, own), shape)
        else:
            asked = asked.applyInArrow(lambda key, rows: answers(key, rows), shape)
        found.append(written(asked, "answers", compression="zstd"))
    found = reduce(DataFrame.unionAll, found)
    found = found.groupBy("piece").agg(F.collect_list(F.struct("text", "sum")).alias("sums"), *(F.max(c).alias(c) for c in answer.names[3:]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                n, flag = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("n", "flag"))
                total = np.zeros(len(n), np.int64)
                for part in batch.column("sums")[i].as_py():
                    if part["text"] is not None:
                        total[np.cumsum(_unpacked(part["text"]))] += _unpacked(part["sum"])
                log = (total / STEP - np.frombuffer(batch.column("base")[i].as_py())) / n
                ratio = np.frombuffer(batch.column("ratio")[i].as_py())
                made = [pa.array(n), pa.array(np.power(10.0, log)) if m.good else pa.nulls(len(n), pa.float64()), pa.array(ratio) if len(ratio) else pa.nulls(len(n), pa.float64()), pa.array(flag)]
                yield pa.RecordBatch.from_arrays([batch.column("x0")[i].values, batch.column("x1")[i].values, *made], ["doc_id", "lang", "n_tokens", "perplexity", "ratio", "flag"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang"))
    return table.select("piece", "x0", "x1").join(found, "piece").mapInArrow(rows, kinds + ", n_tokens long, perplexity double, ratio double, flag long")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.5, toxic_quantile: float = 0.995) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, kept for each row of ``docs`` (doc_id, text, lang).

    Trusted are documents labelled of quality and not toxic."""
    with tidy(docs.sparkSession, lm.batch()):
        scored = written(judged(docs, labels), "perplexities")
    known = scored.where((F.col("flag").bitwiseAND(KEPT_OUT) > 0) & (F.col("n_tokens") > 1))
    limit = slack * F.percentile_approx("perplexity", quantile, 10_000)
    highest = F.percentile_approx("ratio", toxic_quantile, 10_000)
    by_lang = known.groupBy(F.col("lang").alias("of")).agg(limit.alias("own"), highest.alias("own_ratio"))
    overall = known.agg(limit.alias("any"), highest.alias("any_ratio"))
    both = scored.join(F.broadcast(by_lang), F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(overall))
    threshold = F.coalesce("own", "any")
    plain = F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    civil = F.coalesce(F.col("ratio") <= F.coalesce("own_ratio", "any_ratio"), F.lit(True))
    kept = (F.col("n_tokens") <= 1) | (plain & civil)
    return both.select("doc_id", "lang", "n_tokens", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = classify(docs, labels)
    return found.withColumns({c: F.round(c, 6) for c in ("perplexity", "threshold")})

"""Language identification: known words first, then shorter and shorter character n-grams.

A model holds, for each language, how often words and the character n-grams of its words occur, learned from
a bounded sample of labelled texts.  A text's words are runs of letters, in lower case.  A known word counts
with its log frequency in each language.  For an unseen word the longest n-grams that the model knows any of
are used: all of its 5-grams that are known, else its 4-grams, down to single letters; a word of which not
even a letter is known counts for nothing.  The language with the highest sum wins, the smallest name on
ties; the score is its share of the posterior, with the evidence per word as temperature.

Bounds of the model: the sample is at most about ``sample_chars`` characters a language (whole texts, chosen
by a hash), so words and n-grams are no more than that; only those found at least ``least`` times are kept.

Defined results: null text, or text without a letter, is ``und`` with score 0; a text of unknown letters only
gets the most frequent language of the sample with its share as score; labels that are null aren't learned;
repeated rows are judged alike; without any learned label every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

U = np.uint64
LONGEST = 5
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


_table: list[np.ndarray] = []


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower case, each text followed by a 0; the texts' ranges."""
    parts = [(t or "").lower() for t in texts.to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return np.frombuffer(("\0".join([*parts, ""])).encode("utf-32-le", "replace"), np.uint32), at


def word_hashes(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, lengths, hashes and texts of the words (runs of letters)."""
    if not _table:
        _table.append(_letters())
    letter = _table[0][points]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # The bytes of the code points, so that the words' hashes are those of ``words``.
    raw = points.view(np.uint8)
    return starts, ends - starts, W.hashes(raw, starts * 4, ends * 4, lower=False), np.searchsorted(at, starts, "right") - 1


def gram_hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words, and the word that each belongs to."""
    count = np.maximum(lengths - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(starts, count) + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    h = np.full(len(word), n, U)
    for k in range(n):
        h = h * W.BASE + points[at + k].astype(U) + U(1)
    return W.mixed(h), word


def _counted(docs: DataFrame) -> DataFrame:
    """lang, kind (0: word, n: n-gram), hash, n: counts over texts, combined in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for low in range(0, batch.num_rows, 64):
                part = batch.column("text").slice(low, 64)
                points, at = _points(part)
                starts, lengths, words, text = word_hashes(points, at)
                names, code = np.unique(np.array(langs[low : low + 64], dtype=str), return_inverse=True)
                for kind in range(LONGEST + 1):
                    keys, of = (words, np.arange(len(words))) if kind == 0 else gram_hashes(points, starts, lengths, kind)
                    lang = code[text[of]]
                    for c in range(len(names)):
                        u, n = np.unique(keys[lang == c], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([str(names[c])] * len(u), pa.string()), pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))],
                            ["lang", "kind", "hash", "n"],
                        )

    return docs.select("lang", "text").mapInArrow(count, "lang string, kind int, hash long, n long").groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language of words (kind 0) and n-grams (kinds 1 to 5)."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], share: np.ndarray):
        self.langs, self.share = langs, share
        self.index, self.logs = [], []
        for lang, keys, n in counts:
            distinct, which = np.unique(keys, return_inverse=True)
            table = np.zeros((len(distinct), len(langs)))
            table[which, lang] = n
            total = table.sum(0)
            self.index.append(W.Index(distinct))
            self.logs.append(np.log((table + 0.1) / (total + 0.1 * (len(distinct) + 1))).astype(np.float32))

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        points, at = _points(texts)
        starts, lengths, words, text = word_hashes(points, at)
        rows = len(at) - 1
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        value = np.zeros((len(distinct), len(self.langs)))
        found = self.index[0].find(distinct)
        value[found >= 0] = self.logs[0][found[found >= 0]]
        open_ = np.flatnonzero(found < 0)
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            keys, of = gram_hashes(points, starts[first[open_]], lengths[first[open_]], n)
            hit = self.index[n].find(keys)
            of, hit = of[hit >= 0], hit[hit >= 0]
            for lang in range(len(self.langs)):
                value[open_, lang] += np.bincount(of, self.logs[n][hit, lang], len(open_))
            # The sum over a word's n-grams counts as much as one word does.
            seen = np.bincount(of, minlength=len(open_))
            value[open_] /= np.maximum(seen, 1)[:, None]
            open_ = open_[seen == 0]
        total = np.stack([np.bincount(text, value[which, lang], rows) for lang in range(len(self.langs))], 1)
        used = np.bincount(text, value[which].any(1), rows)
        best = total.argmax(1)
        spread = np.exp((total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(used, 1))[:, None])
        score = 1 / spread.sum(1)
        best[used == 0], score[used == 0] = self.share.argmax(), self.share.max()
        none = np.bincount(text, minlength=rows) == 0
        score[none] = 0
        return [UNKNOWN if none[i] else self.langs[b] for i, b in enumerate(best)], score


def fit(docs: DataFrame, sample_chars: int = 2_000_000, least: int = 2) -> Model | None:
    """A model of ``docs`` (text, lang): whole texts of each language, chosen by a hash of the text so that
    about ``sample_chars`` characters of each are taken (all of them where there are fewer)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = known.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows"))
    sizes = {r["lang"]: (r["chars"], r["rows"]) for r in sizes.collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, (chars, _) in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(1_000_000 * sample_chars / max(chars, 1)) + 1))
    counts = _counted(known.where(wanted)).where((F.col("n") >= least) | (F.col("kind") == 1)).toArrow()
    langs = sorted(sizes)
    code = np.array([langs.index(x) for x in counts.column("lang").to_pylist()], np.int64)
    kind, keys, n = (counts.column(c).to_numpy() for c in ("kind", "hash", "n"))
    share = np.array([sizes[x][1] for x in langs], float)
    return Model(langs, [(code[kind == k], keys[kind == k].view(U), n[kind == k]) for k in range(LONGEST + 1)], share / share.sum())


def predict(docs: DataFrame, model: Model | None, extra: list[Column] = ()) -> DataFrame:
    """doc_id, lang_pred, score (and ``extra`` columns of ``docs``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *extra, "text")
    names = [c for c in rows.columns if c != "text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low, high, _, _ in W.chunks(batch.column("text"), 1 << 19):
                part = batch.slice(low, high - low)
                pred, score = m.judge(part.column("text")) if m else ([UNKNOWN] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(judge, f"{kinds}, lang_pred string, score double")


def op5_langid(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    model = fit(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))))
    return predict(docs, model, [held_out])

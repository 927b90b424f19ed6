"""Each operator on hard rows: nulls, empty and long texts, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookweave.llm import decontaminate, kneser_ney, langid, line_dedup, lm, minhash, pieces, pii, quality_rules, warc
from bookweave.llm import words as W
from bookweave.llm.eliasfano import Monotone, Trie

SCHEMA = "doc_id long, text string, lang string, _extra string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = make(120)
    swapped = base.split()
    swapped[60] = "other"
    rows = [
        (1, base, "en", "x"), (2, base.upper().replace("É", "é"), "en", "x"), (3, " ".join(swapped), None, "x"),
        (4, None, "en", None), (5, "", "de", "x"), (6, "  \n\t ", "de", "x"), (7, "two words", "de", "x"), (7, "two words", "de", "x"),
        (8, make(40) + "\nA line that repeats here\n" + make(5), "de", "x"), (9, "a LINE that repeats here  \nshort\nA line that repeats here", "en", "x"),
        (None, "A line that repeats here\nwithout an id", "en", "x"), (10, make(9000), "en", "x"), (11, "x" * 70_000, "en", "x"), (12, "日本語のテキスト" * 40, "ja", "x"),
    ]
    return rows + [(20 + i, make(r.randint(1, 200)), r.choice(["en", "de"]), "x") for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_over_buffers():
    column = pa.array([None, "", "A b", "  b\nA  ", "ß É é", "x" * 600_000 + " y"]).slice(1)
    found = []
    for _, _, data, offsets in W.chunks(column, 10):
        s, e, at = W.bounds(data, offsets)
        h = W.hashes(data, s, e)
        found += [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert [len(x) for x in found] == [0, 2, 2, 3, 2]
    assert found[1] == found[2][::-1] and len(set(found[3])) == 3
    index = W.Index(np.array([5, 1, 1 << 63], np.uint64))
    assert index.find(np.array([1, 2, 5, 1 << 63], np.uint64)).tolist() == [1, -1, 0, 2]


def test_quality_rules_match_brute_force(docs, texts, none):
    def brute(t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        cover = {j for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)

    more = [(90, "a b c d e f g h " * 5, "en", "x"), (91, "same\n" * 30, "en", "x"), (92, "w# " * 25, "en", "x")]
    df = docs.union(docs.sparkSession.createDataFrame(more, SCHEMA))
    got = quality_rules.op9_quality_rules(df).collect()
    want = Counter((r[0], *brute(r[1])) for r in [*texts, *more])
    assert Counter(tuple(g)[:6] for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words)
        assert not (g.base_failed and g.kept)
    by = {g.doc_id: g for g in got}
    assert by[1].kept and not by[92].kept and by[90].base_failed
    assert quality_rules.op9_quality_rules(none).count() == 0


def test_cascade_order_changes_no_verdict(docs):
    names = [r.name for r in quality_rules.RULES]
    a = quality_rules.cascade(docs, order=names).where("kept").select("doc_id").collect()
    b = quality_rules.cascade(docs, order=names[::-1]).where("kept").select("doc_id").collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and quality_rules.cascade(docs).columns == [*docs.columns, "kept"]


@pytest.mark.parametrize("salts", [1, 5])
def test_line_dedup_matches_brute_force(docs, texts, none, salts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    first = {}
    for i, t, *_ in texts:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                first[key(x)] = min(i, first.get(key(x), i))
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if i is None or first.get(key(x), i) == i)) for i, t, *_ in texts)
    got = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, salts=salts))
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == want
    assert line_dedup.op6_line_dedup(none).count() == 0
    by = {r.doc_id: r for r in line_dedup.op6_line_dedup(docs).collect()}
    assert (by[9].n_lines, by[9].n_dropped) == (3, 2) and by[4].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_many_dropped_lines(spark):
    lines = [f"line number {i} of many" for i in range(3000)]
    df = spark.createDataFrame([(1, "\n".join(lines[::2])), (2, "\n".join(lines))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.keep_lines(df, line_dedup.line_bitmaps(df)).collect()}
    assert got[2] == "\n".join(lines[1::2]) and got[1] == "\n".join(lines[::2])


def components_of(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingle_sets(rows, n):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return sets


def test_minhash_matches_brute_force(spark, docs, texts, none):
    r = random.Random(3)
    base = [f"w{r.randint(0, 5000)}" for _ in range(150)]
    near = []
    for i in range(120):  # near copies, most of them just around the threshold
        w = list(base)
        for _ in range(r.choice([1, 2, 4, 5, 6, 8])):
            w[r.randrange(150)] = f"n{r.randint(0, 10**6)}"
        near.append((100 + i, " ".join(w), "en", "x"))
    rows = [(i, t) for i, t, *_ in [*texts, *near] if i is not None]
    want = components_of(shingle_sets(rows, 3), 85)
    got = minhash.op10_minhash(docs.union(spark.createDataFrame(near, SCHEMA))).collect()
    assert len(got) == len(texts) + len(near)
    for g in got:
        if g.doc_id is None:
            assert g.kept and g.component_id is None
        else:
            assert (g.component_id, g.kept) == (want[g.doc_id], want[g.doc_id] == g.doc_id), g
    assert minhash.op10_minhash(none).count() == 0
    left = minhash.deduplicate(docs)
    assert left.columns == docs.columns and left.where("doc_id = 7").count() == 2 and left.where("doc_id = 2").count() == 0


def test_minhash_blocks_match_pairs(spark, monkeypatch):
    """With the pair path closed, large buckets go block by block and give the same components."""
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(8)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(70):
        w = list(base)
        for _ in range(r.choice([1, 3, 4, 5])):
            w[r.randrange(100)] = f"n{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    want = components_of(shingle_sets(rows, 3), 85)
    got = minhash.op10_minhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: g.component_id for g in got} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 300), (300, 7)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(1, 61), *range(100, 140), 300}
    assert all(c == (1 if i < 100 or i == 300 else 100) for i, c in got.items())


def test_decontaminate(spark, docs, none):
    r = random.Random(2)
    fresh = lambda n: " ".join(f"q{r.randint(0, 10**6)}" for _ in range(n))
    items = [(1, fresh(30)), (2, fresh(12)), (3, "too few words"), (4, None), (5, fresh(60)), (5, fresh(25)), (6, fresh(400))]
    near = items[4][1].split()
    near[30] = "changed"
    rows = [
        (1, fresh(50) + " " + items[0][1].upper() + ", " + fresh(20)), (2, items[1][1]), (3, fresh(9) + " " + " ".join(near)), (4, None), (5, ""),
        (6, "too few words"), (7, fresh(300)), (8, " ".join(items[0][1].split()[:15]) + " " + fresh(40)), (9, fresh(40_000) + " " + items[5][1]), (2, items[1][1]), (10, items[6][1][:-30]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    got = decontaminate.contaminated(df, bench).collect()
    assert Counter((g.doc_id, g.item_id) for g in got) == Counter([(1, 1), (2, 2), (2, 2), (3, 5), (9, 5), (10, 6)])
    assert {g.doc_id: g.start_word for g in got}[1] == 50
    assert sorted(x.doc_id for x in decontaminate.decontaminate(df, bench).collect()) == [4, 5, 6, 7, 8]
    assert decontaminate.contaminated(none, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_hamming_blocks_find_all_in_radius():
    items = decontaminate.Items([1, 2], [" ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))])
    r = random.Random(1)
    for flips in (0, 5, 20, decontaminate.RADIUS, decontaminate.RADIUS + 1):
        bits = np.unpackbits(items.prints[:1].view(np.uint8))
        bits[r.sample(range(128), flips)] ^= 1
        window, item = items.candidates(np.packbits(bits).view(np.uint16).reshape(1, -1), 20)
        assert (0 in item.tolist()) == (flips <= decontaminate.RADIUS)


def test_pieces_equal_the_library(docs, texts, none):
    with open(pieces.default_model(), "rb") as f:
        model = pieces.Model(f.read())
    for size in (pieces.CHUNK, 100):  # 100: nearly all texts in chunks, runs without a space among them
        got = pieces.decode(pieces.encode(docs.where("doc_id != 11 OR doc_id IS NULL OR %d > 100" % size), size=size))
        assert got.columns == [*docs.columns, "token_ids", "decoded"]
        for g in got.collect():
            assert g.token_ids == model.full.encode(g.text or "") and g.decoded == (g.text or "")
    odd = docs.sparkSession.createDataFrame([(1, "a ▁ b▁▁c  ▁" * 30), (2, "tab\t\r\n\x00 end ")], "doc_id long, text string")
    for g in pieces.decode(pieces.encode(odd, size=70)).collect():
        assert g.decoded == g.text
    assert pieces.op2_sentencepiece(none).count() == 0


def test_max_plus_product_is_associative():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random((3, 3)) < 0.5, 0.0, -np.inf) for _ in range(3))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_langid(spark, docs, none):
    r = random.Random(4)
    kinds = {"en": "the and of to in is that".split(), "de": "der die und das nicht ist ein".split()}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(30)), k, "x") for i, k in enumerate(r.choices(["en", "de"], k=200))]
    df = spark.createDataFrame([*rows, (None, "das ist nicht", None, "x"), (900, None, "en", "x"), (901, "12 ... 34", "en", "x"), (902, "nichts", None, "x")], SCHEMA)
    got = langid.op5_langid(df).collect()
    assert len(got) == 204 and all(0 <= g.score <= 1 for g in got)
    by = {g.doc_id: g for g in got}
    assert all(by[i].lang_pred == k for i, _, k, _ in rows)
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == "de" and by[None].lang_pred == "de"
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert langid.op5_langid(none).count() == 0
    assert {g.lang_pred for g in langid.op5_langid(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_warc_round_trip(spark):
    r = random.Random(6)
    big = "é<p>" + "".join(r.choice("abc \r\n") for _ in range(90_000))
    rows = [(3, "http://a/\n b", big), (1, None, big), (2, "http://a", None), (5, "http://a", ""), (4, "u", "x"), (None, "u", "only null"), (7, "u", "y" * 32_768), (3, "http://a/\n b", big), (8, "u", big + "!"), (8, "u", big + "!")]
    df = spark.createDataFrame([(*x, "e") for x in rows], "page_id long, url string, html string, sha string")
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        first[h] = i if h not in first or (i is not None and (first[h] is None or i < first[h])) else first[h]
    want = Counter((i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if first[(h or "").encode()] == i else "revisit", None if first[(h or "").encode()] == i else first[(h or "").encode()]) for i, _, h in rows)
    assert Counter(map(tuple, warc.op7_warc(df).collect())) == want
    assert warc.op7_warc(df.limit(0)).count() == 0


def test_warc_tells_what_is_wrong():
    assert warc.unchunked(warc.chunked(b"x" * 20_000)) == b"x" * 20_000 and warc.unchunked(b"3;a=b\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"9\r\nabc\r\n0\r\n\r\n")
    assert warc._judged(b"HTTP/1.1 200 OK\r\n\r\nabc", "A" * 32)[2] == "payload digest differs"


def test_lm_matches_brute_force(docs, texts, none):
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in texts]
    counts = Counter(w for (_, t, *_), ok in zip(texts, train) if ok for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = lm.op8_lm(docs).collect()
    want = Counter((i, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 5)) for i, t, *_ in texts)
    assert Counter((g.doc_id, g.n_tokens, g.n_known, round(g.base_score, 5)) for g in got) == want
    assert all(g.train_tokens == n and g.score <= 0 for g in got)
    assert sum(g.score for g in got) > sum(g.base_score for g in got)
    assert lm.op8_lm(none).count() == 0


@pytest.mark.parametrize(("shard", "piece", "split"), [(1 << 22, 16 << 20, 1 << 20), (9000, 4000, 1 << 20), (9000, 4000, 5000)])
def test_lm_equals_brute_force_at_any_size(spark, monkeypatch, shard, piece, split):
    """One shard or many, one piece or many, and words with several contexts."""
    for name, x in (("TOKENS", shard), ("PIECE", piece), ("SPLIT", split), ("KNOWN", 1e-2 if piece < 1e4 else 1e-6)):
        monkeypatch.setattr(lm, name, x)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(9000))) for i in range(16)]
    rare = "quite rare words that occur here once"
    rows = [(i, f"{t} {rare}" if i in (0, 1) else t) for i, t in rows]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows += [(held, rare + " unseen " + rows[3][1][:300]), (held, None), (None, "only here")]
    learn = [[None, None, *words(t), ""] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    n, d = sum(len(t) - 2 for t in learn), 0.75
    c1 = Counter(w for t in learn for w in t[2:])
    step = lambda p: round(-16 * math.log10(p)) / -16
    one = lambda w: step((c1[w] + 1) / (n + len(c1) + 1))

    def number(w):
        if w is None or w == "":
            return int(lm.START if w is None else lm.END)
        data = np.frombuffer(w.encode(), np.uint8)
        return int(W.hashes(data, np.array([0]), np.array([len(data)]))[0])

    hashed = {w: int(W.mixed(np.array([number(w)], W.U))[0]) for i, t in rows for w in [None, "", *words(t)]}
    home = lambda u, v: (v, hashed[u] % (1 + c1[v] // split))
    grams = [g for t in learn for g in zip(t[1:], t[2:], t[3:])]
    c2, c3 = Counter((home(u, v), w) for u, v, w in grams), Counter(((u, v), w) for u, v, w in grams)
    total = lambda c: Counter(x for k, m in c.items() for x in [k[0]] * m)
    t2, t3, m2, m3 = total(c2), total(c3), Counter(k[0] for k in c2), Counter(k[0] for k in c3)

    def log(u, v, w):
        h, p1 = home(u, v), one(w)
        p2 = (c2[h, w] - d + d * m2[h] * 10**p1) / t2[h] if c2[h, w] else None
        if c3[(u, v), w]:
            return step((c3[(u, v), w] - d + d * m3[u, v] * p2) / t3[u, v])
        shorter = step(p2) if p2 else p1 + (step(d * m2[h] / t2[h]) if t2[h] else 0)
        return shorter + (step(d * m3[u, v] / t3[u, v]) if t3[u, v] else 0)

    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter()
    for i, t in rows:
        s = [None, *words(t), ""]
        want[(i, len(s) - 1)] = one(s[1]) + sum(log(*s[k - 2 : k + 1]) for k in range(2, len(s)))
    got = {(g.doc_id, g.n_tokens): g.score for g in lm.op8_lm(df).collect()}
    assert n > 100_000 and got.keys() == want.keys()
    off = {k: (got[k], want[k]) for k in got if abs(got[k] - want[k]) > 1e-4 * abs(want[k])}
    assert not off


def test_lm_counts_pairs_over_all_homes(spark, monkeypatch):
    """The pairs of a word that is spread over several homes are those of all of them: scores are as in one home, also of
    held-out texts that ask for a pair, or a word, that only other homes have learned."""
    for name, x in (("TOKENS", 2000), ("PIECE", 3000), ("KNOWN", 1e-2)):
        monkeypatch.setattr(lm, name, x)
    r = random.Random(9)
    vocabulary = ["the", "of"] * 15 + ["".join(r.choice("defgh") for _ in range(3)) for _ in range(90)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(600)] + [(600, None), (None, "the of the"), (601, "new the words the of never seen of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for split in (1 << 20, 400, 60):
        monkeypatch.setattr(lm, "SPLIT", split)
        found.append(sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), g.score) for g in lm.op8_lm(docs).collect()))
    assert len(found[0]) == 603 and found[0] == found[1] == found[2]


def test_elias_fano_trie():
    r = np.random.default_rng(2)
    for n, top in ((1, 1), (40, 41), (500, 10**6), (3000, 5000)):
        x = np.sort(r.choice(top, n, replace=False))
        m = Monotone.of(x)
        assert (m.access(np.arange(n)) == x).all()
        q = np.concatenate([x, r.integers(0, top + 9, 500)])
        assert (m.find(q) == [int(np.searchsorted(x, a)) if a in set(x.tolist()) else -1 for a in q.tolist()]).all()
    key = np.unique(r.integers(0, 50, 400) * 1000 + r.integers(0, 90, 400))
    level = {"context": key // 1000, "word": key % 1000, "prob": -r.random(len(key)), "gamma": -r.random(len(key))}
    trie = Trie.build({1: {"prob": -r.random(50), "gamma": -r.random(50)}, 2: level, 3: {"context": np.zeros(0, int), "word": np.zeros(0, int), "prob": np.zeros(0)}}, {2: 50, 3: len(key)})
    trie = Trie.mapped(*trie.pack())
    c, w = (a.ravel() for a in np.meshgrid(np.arange(50), np.arange(95)))
    place = {k: i for i, k in enumerate(key.tolist())}
    assert trie.child(2, c, w).tolist() == [place.get(k, -1) for k in (c * 1000 + w).tolist()]
    assert np.abs(trie.prob(2, np.arange(len(key))) - level["prob"]).max() < 0.05


def test_kneser_ney(spark, docs, none):
    r = random.Random(9)
    good = lambda: " ".join(r.choice("the cat sat on a mat and then it ran off".split()) for _ in range(40))
    rows = [(i, good(), "en", "x") for i in range(200)] + [(500, " ".join(f"Z{r.random()}" for _ in range(40)), "en", "x"), (501, None, None, "x"), (502, "", "xx", "x"), (503, good(), None, "x")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(500, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g for g in kneser_ney.op1_quality(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert len(got) == len(rows) and not got[500].kept and all(got[i].kept for i in (*range(200), 501, 502, 503))
    assert got[503].threshold is not None
    plain = kneser_ney.op1_quality(docs, labels.limit(0)).collect()
    assert all(g.kept and g.perplexity is None for g in plain)
    assert kneser_ney.op1_quality(none, labels).count() == 0


def test_kneser_ney_sums_to_one(spark):
    """Over the seen words and one unseen, for a seen, a rarer and an unseen context."""
    df = spark.createDataFrame([("a b a c a b",), ("b a b c",), ("c a b a",)], "text string")
    model = kneser_ney.fit(df)
    end = W.hashes(np.frombuffer(b"a b c", np.uint8), np.array([0, 2, 4]), np.array([1, 3, 5]))
    vocabulary = np.array([*end, kneser_ney.END, 12345], np.uint64)  # the last is unseen
    for u, v in ((end[0], end[1]), (end[2], end[0]), (np.uint64(77), end[2]), (np.uint64(77), np.uint64(78))):
        total = 0.0
        for w in vocabulary:
            p, _ = model.look(0, kneser_ney._joined(np.array([w])), model.floor)
            for table, gram, context in ((1, (v, w), (v,)), (2, (u, v, w), (u, v))):
                weight, _ = model.look(2 + table, kneser_ney._joined(*(np.array([x]) for x in context)), 0.0)
                own, seen = model.look(table, kneser_ney._joined(*(np.array([x]) for x in gram)), 0.0)
                p = np.where(seen, own, p + weight)
            total += 10 ** p[0]
        assert abs(total - 1) < 1e-4


def test_pii_matches_brute_force(spark, docs, none):
    tricky = [
        "a@b.c_d@e.f x@y z@q..r 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 x4111111111111111x 4111  1111",
        "+1 (234) 567-8901. +12 345 +123456789012345678 ++49 30 1234567", "é日 mail: ü.a@ex-ample.co.uk, ip 10.0.0.1é", "1" * 5000 + "." + "@" * 50, "a" * 20_000 + "@" + "b" * 100, None, "",
    ]
    patterns = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}
    digits = lambda v: re.sub("[^0-9]", "", v)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    valid = {
        "email": lambda v: True, "ip": lambda v: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 9 <= len(digits(v)) <= 15,
    }
    df = spark.createDataFrame([*enumerate(tricky), (None, tricky[0])], "doc_id long, text string")
    for g in pii.op3_pii(df).collect():
        t = tricky[g.doc_id or 0] or ""
        want = sorted((m.start(), k, n, m.end()) for k, (n, p) in enumerate(patterns.items()) for m in re.finditer(p, t) if valid[n](m[0]))
        text = ",".join(f"{n}:{a}:{b}" for a, _, n, b in want)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and g.spans == text
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(x[2] == n for x in want) for n in patterns)
    assert pii.op3_pii(none).count() == 0 and pii.op3_pii(docs).count() == docs.count()


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"case {i} common words\nthe Baker street number{i} home a.b@c.org visit {i}\nend") for i in range(5)]
    rows += [(10 + i, f"common words and the street of number{i + 20} only") for i in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, terms string")
    got = {g.doc_id: g for g in pii.op3_pii(df).collect()}
    text = rows[0][1]
    assert f"term:{text.index('Baker')}:{text.index('Baker') + 5}" in got[0].spans.split(",")
    assert f"term:{text.index('street')}:{text.index('street') + 6}" not in got[0].spans.split(",") and got[10].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Baker" not in clean[0] and "[EMAIL]" in clean[0] and "street" in clean[0] and clean[10] == dict(rows)[10]


def test_pii_terms_are_marked_in_every_document(spark):
    rows = [(i, f"case {i} of the Baker street number{i} home a.b@c.org visit {i}\nend") for i in range(5)]
    rows += [(10 + i, f"words of the street number{i + 20} only") for i in range(80)] + [(99, "x@y.org is not near\n(Baker) alone"), (None, "bakery Baker"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: [x for x in g.spans.split(",") if x.startswith("term")] for g in pii.op3_pii(df.where("doc_id != 99 OR doc_id IS NULL").union(df.where("doc_id = 99"))).collect()}
    assert got[99] == ["term:21:26"] and got[None] == ["term:7:12"] and got[0] and got[10] == got[100] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[99] == "[EMAIL] is not near\n() alone" and clean[None] == "bakery " and clean[10] == dict(rows)[10]


def test_kneser_ney_rejects_toxic_prose(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcde") for _ in range(4)) for _ in range(200)]
    prose = lambda: [r.choice(vocabulary) for _ in range(100)]
    bad = lambda w: w[:30] + [r.choice(["idiot", "moron"])] + w[30:60] + [r.choice(["idiot", "moron"])] + w[60:]
    rows = [(i, " ".join(bad(prose()) if i >= 400 else prose()), "en", "x") for i in range(500)]
    labels = spark.createDataFrame([(i, 1, int(i >= 400)) for i in range(460)], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g.kept for g in kneser_ney.op1_quality(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert sum(got[i] for i in range(460, 500)) <= 1 and sum(got[i] for i in range(400)) >= 392


def test_bucketed_rows_stay_in_place(spark):
    """A join by the buckets' column moves the other side only."""
    from bookweave.llm.shared import bucketed

    pieces = bucketed(spark.range(40).selectExpr("id AS piece", "repeat('x', 50) AS codes"), "some-pieces", "piece")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = pieces.join(spark.range(30).selectExpr("id % 9 AS piece").groupBy("piece").count(), "piece", "left")
        plan = both._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Exchange hashpartitioning") == 1
        assert both.count() == 40 and both.where("count IS NOT NULL").count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_access_and_find_over_whole_words():
    """Values that fill words of 64 bits to the last, and a sequence of one value."""
    for x in (np.arange(64), np.arange(128) * 2, np.array([0]), np.array([2**40])):
        m = Monotone.of(x)
        assert (m.every() == x).all() and (m.find(x) == np.arange(len(x))).all() and m.find(x + x[-1] + 1).max() == -1


@pytest.mark.parametrize(("shard", "piece"), [(1 << 20, 16 << 20), (3000, 2000)])
def test_kneser_ney_learns_from_every_trusted_text(spark, monkeypatch, shard, piece):
    """Perplexities are those of the model of all texts learned from, of more documents than a sample of 2,000 would
    hold, in one shard or many; each text counts: a word that one of them alone has is known."""
    for name, x in (("TOKENS", shard), ("PIECE", piece), ("KNOWN", 1e-2 if piece < 1e4 else 1e-6)):
        monkeypatch.setattr(lm, name, x)
    r = random.Random(12)
    n = 4800
    rows = [(i, " ".join([*(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(0, 6))), f"own{i}"]), "en") for i in range(n)]
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, "never seen a b", "en"), (None, "a b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(n, 1, 0), (n + 2, 0, 1)], "doc_id long, quality int, toxic int")
    got = kneser_ney.judged(docs, labels).collect()
    learned = {g.doc_id for g in got if g.flag & kneser_ney.TRUSTED}
    assert len(learned) > 2000 and len(got) == len(rows)
    assert learned | {g.doc_id for g in got if g.flag & kneser_ney.KEPT_OUT} == set(range(n))
    model = kneser_ney.fit(docs.where(F.col("doc_id").isin(sorted(learned))))
    assert model is not None
    texts = dict((i, t) for i, t, _ in rows)
    for g in r.sample(got, 400) + [g for g in got if g.doc_id is None or g.doc_id >= n]:
        data = (texts[g.doc_id] or "").encode()
        t, first = kneser_ney._sequences(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        p = model.logs(t, first)
        assert g.n_tokens == len(p) and abs(math.log10(g.perplexity) + p.mean()) < 2e-3


def test_kneser_ney_in_parts(spark, monkeypatch):
    """Shards that are asked part after part, and words by part, give what one part gives; frequent words have several
    contexts, in different parts; no part answers half of the whole."""
    for name, x in (("TOKENS", 1500), ("PIECE", 4000), ("KNOWN", 1e-2)):
        monkeypatch.setattr(lm, name, x)
    monkeypatch.setattr(kneser_ney, "SPLIT", 300)
    r = random.Random(5)
    vocabulary = ["a", "b", "c"] * 10 + ["".join(r.choice("defgh") for _ in range(3)) for _ in range(90)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))), "en") for i in range(600)] + [(None, None, None), (600, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    moved, write = [], kneser_ney.written

    def seen(df, name, **options):
        out = write(df, name, **options)
        if name == "answers":
            moved.append(sum(len(lm._unpacked(x["sum"])) for x in out.where("sum IS NOT NULL").collect()))
        return out

    monkeypatch.setattr(kneser_ney, "written", seen)
    found = []
    for words, parts in ((1, 1), (2, 4)):
        monkeypatch.setattr(kneser_ney, "WORD_PARTS", words)
        monkeypatch.setattr(kneser_ney, "PARTS", parts)
        found.append(sorted((str(g.doc_id), g.n_tokens, g.perplexity, g.ratio, g.flag) for g in kneser_ney.judged(docs, labels).collect()))
    assert found[0] == found[1] and len(found[0]) == 602
    whole, *rest = moved
    assert len(rest) == 4 and sum(rest) == whole and max(rest) < whole / 2


def test_kneser_ney_counts_pairs_over_all_homes(spark, monkeypatch):
    """Counts of pairs, discounts and weights are those of all homes of a word: perplexities are as in one home."""
    for name, x in (("TOKENS", 1500), ("PIECE", 4000), ("KNOWN", 1e-2)):
        monkeypatch.setattr(lm, name, x)
    r = random.Random(6)
    vocabulary = ["the", "of"] * 15 + ["".join(r.choice("defgh") for _ in range(3)) for _ in range(90)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))), "en") for i in range(600)] + [(None, "the of the", None), (600, "never seen of the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    found = []
    for split in (1 << 17, 300, 80):
        monkeypatch.setattr(kneser_ney, "SPLIT", split)
        found.append(sorted((str(g.doc_id), g.n_tokens, round(g.perplexity, 6), g.ratio, g.flag) for g in kneser_ney.judged(docs, labels).collect()))
    assert len(found[0]) == 602 and found[0] == found[1] == found[2]


def test_kneser_ney_leaves_no_shuffle_files(spark):
    """What a statement shuffled goes when it ends, before the next one shuffles; the session's setting is as before."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        every = manager.getAllFiles()
        return {name for k in range(every.size()) if (name := every.apply(k).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    docs = spark.createDataFrame([(i, "a b c a b " * (1 + i % 5), "en") for i in range(60)], "doc_id long, text string, lang string")
    scored = kneser_ney.classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int"))
    late = time.time() + 5
    while (left := files() - before) and time.time() < late:
        time.sleep(0.2)
    assert not left and spark.conf.get(name) == setting
    assert scored.count() == 60

"""Hard negatives, repaired conversations and packed sequences on hard rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookweave.llm import conversations, negatives, packing
from bookweave.llm import words as W

# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, down string, anchor_id long"


def mined(rows):
    def whole(v):
        return [math.floor(256 * float(np.float32(x))) for x in v]

    good = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        good[i] = min(good.get(i, (label, v)), (label, v))
    good = {i: (label, whole(v)) for i, (label, v) in good.items()}
    out = []
    for a, (label, v) in good.items():
        if a % 100:
            continue
        scored = sorted((-max(-negatives.MOST, min(negatives.MOST, sum(x * y for x, y in zip(v, w)))), i, own) for i, (own, w) in good.items() if i != a)
        for p, positive in [(-s, i) for s, i, own in scored if own == label][:5]:
            found = [(-s, i) for s, i, own in scored if own != label and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(a, positive, k, i, p, s) for k, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(8)
    near = [[r.gauss(0, 0.2) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(near)], r.randrange(3), "x", 1) for i in range(-200, 700)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 3, None, None) for i in range(700, 1101)]  # one vector, many ties
    rows += [(1200, None, 1, "x", 1), (1300, [0.1, None], 1, "x", 1), (1400, [float("nan")], 1, "x", 1), (1500, [float("inf")], 1, "x", 1), (1600, [], 1, "x", 1)]
    rows += [(None, [0.1] * 6, 1, "x", 1), (1700, [0.1] * 6, None, "x", 1), (0, near[0], 2, "x", 1), (0, near[0], 2, "x", 1), (1800, [0.3, 0.3], 1, "x", 1)]
    rows += [(1900, [3e38] * 6, 1, "x", 1), (1901, [3e38] * 6, 2, "x", 1), (1902, [-3e38] * 6, -11, "x", 1), (1904, [2e38] * 6, 1, "x", 1)]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_negatives_equal_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    df = spark.createDataFrame(vectors, VECTORS).repartition(5)
    assert sorted(map(tuple, negatives.op11_hard_negatives(df).collect())) == mined(vectors)


def test_no_vectors(spark):
    out = negatives.op11_hard_negatives(spark.createDataFrame([], VECTORS))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0


# ---------------------------------------------------------------- conversations

TURNS = "conv_id long, turn long, role string, text string, cost string, part int"
SPACE = " \t\n\x0b\x0c\r"


def repaired(rows):
    """A walk over the grammar's states that holds the best (cost, audit) of each."""
    convs = defaultdict(list)
    plain = lambda v: " " if v is None else str(v)
    for c, t, role, text, *_ in rows:
        hit, role, text = zlib.crc32(f"{plain(c)}:{plain(t)}".encode()) % 20, plain(role), plain(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        convs[c] += [] if hit == 0 else [(t, "user" if hit == 4 else role, text)] * (1 + (hit == 3))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for t, role, text in turns:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        names = {"u": "user", "a": "assistant"}
        following = {0: "u", 1: "u", 2: "a", 3: "u"}

        def inserted(states):
            states = dict(states)
            for _ in range(3):
                for e, (cost, audit, lines) in list(states.items()):
                    letter = following[e]
                    way = cost + 5, audit + "I", (*lines, names[letter] + ":")
                    to = 2 if letter == "u" else 3
                    if to not in states or way[:2] < states[to][:2]:
                        states[to] = way
            return states

        states = inserted({0: (0, "", ())})
        for (t, role, text), fault in zip(turns, faults):
            new = {}

            def put(to, way):
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way

            for e, (cost, audit, lines) in states.items():
                put(e, (cost + 2, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more, letter = 5 * (fault == "truncated"), following[e]
                to = 2 if letter == "u" else 3
                if role[:1] == "s" and e == 0:
                    put(1, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                if role[:1] == letter:
                    put(to, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                put(to, (cost + more + 1, audit + "R", (*lines, f"{names[letter]}:{text}")))
            states = inserted(new)
        cost, audit, lines = min((states[e] for e in (0, 3) if e in states), key=lambda x: x[:2])
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ux"]
    texts = ["Hi.", "what", "", "  ", "ok!\n", "x y z?", None, "…", "日本。"]
    return [
        (r.choice([1, 1, 1, 1, 2, None, r.randint(10, 90)]), r.choice([None, r.randint(0, 900), r.randint(0, 900)]), r.choice(roles), r.choice([*texts, f"t{r.random()}.", f"u{r.random()}"]), "x", 1)
        for _ in range(n)
    ]


@pytest.mark.parametrize("size", [3, 64, conversations.SEGMENT])
def test_repair_equals_a_walk_over_states(spark, size, monkeypatch):
    monkeypatch.setattr(conversations.repair, "__defaults__", (size,))
    rows = talk(size, 1500) + [(100, 3, "user", "long " * 50_000 + ".", "x", 1), (101, 1, "a", "q.", "x", 1), (101, 1, "a", "q.", "x", 1)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in conversations.op12_conversations(df).collect()}
    assert got == repaired(rows)


def test_alignment_of_every_short_conversation():
    """All role and fault patterns of up to four turns against the walk."""
    import itertools

    text = {"f": ".", "b": "", "t": "x"}
    for n in range(5):
        for pattern in itertools.product(("s", "u", "a", "x"), ("f", "b", "t"), repeat=n):
            turns = list(zip(pattern[::2], pattern[1::2]))
            if n == 4 and zlib.crc32(repr(turns).encode()) % 20:  # a twentieth of the longest ones
                continue
            initials, faults = "".join(r for r, _ in turns), bytes({"f": 0, "b": 1, "t": 3}[f] for _, f in turns)
            cost, audit = conversations.combined(iter([conversations.transfer(initials, faults)]))
            best = least_edits(initials, faults)
            assert (cost, audit) == best, (initials, faults)
            cut = len(initials) // 2
            halves = [conversations.transfer(initials[:cut], faults[:cut]), conversations.transfer(initials[cut:], faults[cut:])]
            assert conversations.combined(iter(halves)) == best


def least_edits(initials, faults):
    """Least (cost, audit) over all strings of the grammar, each aligned by plain recursion."""
    from functools import lru_cache

    targets = [s + "ua" * k for k in range(0, len(initials) + 2) for s in ("", "s") if k or not s]

    def aligned(target):
        @lru_cache(None)
        def rest(i, j):
            if i == len(initials) and j == len(target):
                return (0, "")
            ways = []
            if i < len(initials):
                cost, audit = rest(i + 1, j)
                ways.append((cost + 2, "D" + audit))
                if j < len(target) and faults[i] != 1:
                    cost, audit = rest(i + 1, j + 1)
                    more = 5 * (faults[i] == 3)
                    if initials[i] == target[j]:
                        ways.append((cost + more, "K" + audit))
                    if target[j] != "s":
                        ways.append((cost + more + 1, "R" + audit))
            if j < len(target) and target[j] != "s":
                cost, audit = rest(i, j + 1)
                ways.append((cost + 5, "I" + audit))
            return min(ways, default=(10**6, ""))

        return rest(0, 0)

    return min(map(aligned, targets))


def test_repaired_turns_keep_their_order(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"t{i}.") for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit(False))
    audits, edited = conversations.repair(turns)
    assert audits.first().audit == "K" * 700 and audits.first().cost == 0
    assert [(r.pos, r.turn) for r in edited.collect()] == [(i, i) for i in range(700)]


def test_no_conversations(spark):
    assert conversations.op12_conversations(spark.createDataFrame([], TURNS)).count() == 0


# ---------------------------------------------------------------- packing

DOCS = "doc_id long, text string, start string, ids int"
ODD = [
    "a<|endoftext|>b ́x é  z   q", "", " \n lead", "tail  ", "ΑΣ ΣΑΣ ﬁ", "it's We'LL 's\x00 \x1c\x1d b", "I'stuff ''s ('s x'", None, "'", "s", "'l", "  ",
    "x" * 5000, "日本語 テキスト 12½", "İs", "<|startof text|> <|startoftext|>", "'re've'm'd'll'ss", "a\x85b c d", "😀😀 it’s", "'ſ 'S 'ſtuff",
]


@pytest.fixture(scope="module")
def encoder():
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        return packing.Encoder(f.read())


def library(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("size", [10**9, 1])
def test_ids_equal_the_library(encoder, plain, size, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    whole = lambda t: "<|" in t or "İ" in t or "́" in t
    texts = [t for t in ODD if t and not whole(t)] if plain else ODD
    for low, high, data, offsets in W.chunks(pa.array(texts, pa.string()), size):
        ids, ranges = encoder.encode(data, offsets, 2)
        for k, text in enumerate(texts[low:high]):
            assert ids[ranges[k] : ranges[k + 1]].tolist() == library(encoder, text), text


def test_first_fit_equals_a_scan():
    """The tree finds the bin that a scan from the first one finds."""
    r = random.Random(9)
    sizes = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    bins, rooms, want = packing.Bins(100, len(sizes)), [], []
    for i, size in enumerate(sizes):
        bins.put(i, size)
        at = next((b for b, room in enumerate(rooms) if room >= size), None)
        if at is None:
            rooms.append(100)
            want.append([])
            at = len(rooms) - 1
        rooms[at] -= size
        want[at].append((i, size))
    assert bins.items == want


@pytest.mark.parametrize("tokens", [[], [4096], [1], [0], [4095, 1], [3000], [5, 5, 5], [8192, 1], "many"])
def test_groups_are_whole_and_full(tokens):
    r = random.Random(1)
    tokens = [r.choice([r.randint(1, 300), r.randint(1, 6000), r.randint(1, 30000)]) for _ in range(2000)] if tokens == "many" else tokens
    filled = defaultdict(list)
    for n, pieces in zip(tokens, packing.pack_group(tokens, 4096), strict=True):
        at = 0
        for start, length, sequence, offset in pieces:
            assert start == at and length > 0
            at += length
            filled[sequence].append((offset, length))
        assert at == n
    sums = []
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
        sums.append(at)
    assert sum(s < 4096 for s in sums) <= 12


@pytest.mark.parametrize("group", [1 << 14, 4])
def test_packed_pieces_hold_every_id_once(spark, encoder, group):
    texts = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1), (3, "tail  ", "x", 1), (99, "word " * 30_000, "x", 1)]
    pieces = packing.pack(spark.createDataFrame(texts, DOCS).repartition(3), group_docs=group).collect()
    want = sorted((str(i), tuple(library(encoder, t))) for i, t, *_ in texts)
    open_ = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == packing.crc(np.frombuffer(p.ids, "<u4").tolist())
        open_[p.doc_id].append(p)
    got = []
    for doc, own in open_.items():
        starts = defaultdict(list)
        for p in sorted(own, key=lambda p: p.start):
            starts[p.start].append(p)
        if doc == 3:  # two documents of one id
            got += [("3", tuple(np.frombuffer(p.ids, "<u4").tolist())) for p in own]
        else:
            got.append((str(doc), tuple(np.concatenate([np.frombuffer(p[0].ids, "<u4") for p in starts.values()]).tolist())))
    assert sorted(got) == want
    filled = defaultdict(int)
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())
    assert packing.padding(packing.pack(spark.createDataFrame(texts, DOCS))).first().padding == 0


def test_packing_query(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], DOCS)
    rows = packing.op13_packing(docs)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() >= len(ODD) and packing.op13_packing(docs.limit(0)).count() == 0


def test_counts_of_nothing_whatever_the_session_says(spark):
    """size(NULL) is -1 outside ANSI mode; counts stay 0."""
    from bookweave.llm import line_dedup, pii

    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "a line that is long\nb", "x", 1), (4, "a line that is long", "x", 1)], DOCS)
    for ansi in ("false", "true"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            dropped = {r.doc_id: r.n_dropped for r in line_dedup.op6_line_dedup(docs).collect()}
            found = {(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op3_pii(docs).collect()}
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert dropped == {1: 0, 2: 0, 3: 0, 4: 1} and found == {(0, 0, 0, 0)}

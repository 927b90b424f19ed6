"""The blocked scan and the operators on it against plain windows and plain Python, on tiny blocks."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookweave.operators import layout as Y
from bookweave.operators import merging
from bookweave.operators import ordered as O
from bookweave.operators import resolve as R
from bookweave.operators import toc as T


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(O, "BLOCK_ROWS", 4)


def test_scan_equals_windows(frame):
    rnd = random.Random(1)
    df = frame([(d, i * (1 + d % 2), rnd.choice([None, 1, 2, 3])) for d in (1, 2, 3) for i in range(25)], "d int, seq bigint, v int")
    v = F.col("v")
    got = O.ordered_scan(
        df, ["d"], ["seq"],
        {"p": O.previous(v), "n": O.following(v), "f": O.fill(v), "b": O.fill_next(v), "s": O.sum_before(v), "t": O.total(v), "lo": O.least_of(v), "hi": O.greatest_of(v)},
    )
    w = W.partitionBy("d").orderBy("seq")
    want = df.select(
        "*", F.lag(v).over(w).alias("p"), F.lead(v).over(w).alias("n"),
        F.last(v, True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("f"),
        F.first(v, True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("b"),
        F.coalesce(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"),
        F.sum(v).over(W.partitionBy("d")).alias("t"), F.min(v).over(W.partitionBy("d")).alias("lo"), F.max(v).over(W.partitionBy("d")).alias("hi"),
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_scan_shares_one_exchange(frame):
    df = frame([(1, i, i) for i in range(50)], "d int, seq bigint, v int")
    out = O.ordered_scan(df, ["d"], ["seq"], {"p": O.previous(F.col("v")), "t": O.total(F.col("v"))})
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_top_per_group_limits_before_the_shuffle(frame):
    out = O.top_per_group(frame([(1, i) for i in range(9)], "k int, v int"), ["k"], [F.col("v")], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert sorted(r.v for r in out.collect()) == [0, 1]


def test_levels_equal_a_stack(frame):
    rnd = random.Random(2)
    titles = ["第一部分 a", "第一章 b", "第二节 c", "一、d", "附录 e", "plain", "第三篇 f"]
    rows = [(d, i, rnd.choice(titles), i, rnd.choice([None, None, None, -1, 0, 5])) for d in (1, 2) for i in range(60)]
    info = {"第一部分 a": (1, True), "第一章 b": (2, True), "第二节 c": (3, True), "一、d": (4, False), "附录 e": (1, False), "plain": (2, False), "第三篇 f": (1, True)}
    want = {}
    for d in (1, 2):
        stack = []
        for _, i, t, _, explicit in (r for r in rows if r[0] == d):
            lv, box = info[t]
            if explicit is not None:
                want[d, i] = -1 if explicit == -1 else min(explicit + 1, 4)
                continue
            while stack and (stack[-1] >= lv if box else stack[-1] > lv):
                stack.pop()
            if box:
                stack.append(lv)
            want[d, i] = min(len(stack) + (0 if box else 1), 4)
    got = T.assign_levels(frame(rows, "doc_id bigint, seq bigint, title string, page bigint, explicit bigint"))
    assert {(r.doc_id, r.seq): r.level for r in got.collect()} == want


def _similar(new, kept):
    common = sum(c in kept for c in new)
    return new in kept or kept in new or common > len(new) * 0.8 or common > len(kept) * 0.8


@pytest.mark.parametrize("block", [2, 8, 512])
def test_merge_equals_one_pass(frame, monkeypatch, block):
    monkeypatch.setattr(merging, "BLOCK", block)
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz一二三四五六七八九十章节篇目录"
    rows = [(d, s, i, "".join(rnd.sample(letters, rnd.randint(3, 6))), i) for d in (1, 2, None) for s in range(2) for i in range(30)]
    rows += [(4, 0, i, t, i) for i, t in enumerate(["  ", None, "A b", "ab", "\u3000x", "x"])]
    want = []
    for d in (1, 2, None, 4):
        kept = []
        for _, s, i, t, p in sorted((r for r in rows if r[0] == d), key=lambda r: r[1:3]):
            key = "".join((t or "").split()).lower()
            if key and not any(_similar(key, k) for k in kept):
                kept.append(key)
                want.append((d, s, i, t, p if s == 0 else None))
    got = T.merge_tocs(frame(rows, "doc_id bigint, source_rank int, seq bigint, title string, page bigint"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_merge_of_a_very_long_book(frame):
    """20,000 titles of one book: equal to one pass, in many tasks, and without a job while the plan is built."""
    rnd = random.Random(4)
    titles = ["".join(chr(0x4E00 + rnd.randint(0, 250)) for _ in range(rnd.randint(2, 5))) for _ in range(20_000)]
    rows = frame([(7, 0, i, t, i) for i, t in enumerate(titles)], "doc_id bigint, source_rank int, seq bigint, title string, page bigint")
    tracker = rows.sparkSession.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    merged = T.merge_tocs(rows)
    assert len(tracker.getJobIdsForGroup(None)) == before
    kept, sets, order = [], [], []
    for i, t in enumerate(titles):
        own = set(t)
        if not any(len(own & s) and sum(c in s for c in t) > 0.8 * min(len(t), len(k)) for s, k in zip(sets, kept)):
            kept.append(t)
            sets.append(own)
            order.append(i)
    assert sorted(r.seq for r in merged.collect()) == order


def _merge_lines(text):
    """Line by line statement of the rule for wrapped lines."""
    import re

    dots = lambda s: re.fullmatch(r"[.…·•\s~\-—]{3,}", s)
    lines, out, i = [x.strip() for x in text.strip().split("\n")], [], 0
    while i < len(lines):
        a, b, c = (lines[j] if j < len(lines) else None for j in (i, i + 1, i + 2))
        if a == "":
            i += 1
        elif dots(a):
            if out:
                out[-1] = out[-1].rstrip() + a
            i += 1
        elif c is not None and dots(b) and c.isdigit():
            out.append(a + b + c)
            i += 3
        elif b is not None and re.search(r"[.…·]{2,}$", a) and b.isdigit():
            out.append(a + b)
            i += 2
        else:
            out.append(a)
            i += 1
    final, i = [], 0
    while i < len(out):
        bare = re.fullmatch(r"第[一二三四五六七八九十百千\d]+[章节篇回卷]|\d+[.．]", out[i])
        if bare and i + 1 < len(out):
            final.append(out[i] + " " + out[i + 1])
            i += 2
        else:
            final.append(out[i])
            i += 1
    return "\n".join(final)


def test_wrapped_lines_equal_the_walk(frame):
    rnd = random.Random(4)
    pool = ["......", "…… · —", "12", "7", "标题", "Title....", "第三章", "2.", "", "  ", " x … ", "第四节 y", "~~~"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    got = frame(list(enumerate(texts)), "i int, text string").select("i", T.merge_wrapped("text").alias("m")).collect()
    wrong = [(texts[r.i], r.m, _merge_lines(texts[r.i])) for r in got if r.m != _merge_lines(texts[r.i])]
    assert not wrong, wrong[:2]


def test_contains_join_equals_brute_force(frame):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abc一") for _ in range(n))
    texts, needles = {word(rnd.randint(1, 12)) for _ in range(80)}, {word(rnd.randint(1, 5)) for _ in range(40)} | {"zzz", ""}
    got = R.contains_join(frame([(n,) for n in needles], "n string"), frame([(t,) for t in texts], "t string"), "n", "t")
    assert {tuple(r) for r in got.collect()} == {(n, t) for n in needles for t in texts if n and n in t}


def test_dense_pages_equal_brute_force(frame, monkeypatch):
    monkeypatch.setattr(Y, "BAND_BOXES", 2)
    rnd = random.Random(6)
    boxes = [(1, p, i, x := rnd.random(), y := rnd.random(), x + 0.1, y + 0.02) for p in (0, 1) for i in range(40)]
    blocks = [(1, p, i, "text", x := rnd.random() - 0.1, y := rnd.random() - 0.1, x + rnd.random(), y + rnd.random()) for p in (0, 1) for i in range(6)]
    got = Y.spatial_assign(
        frame(boxes, "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double"),
        frame(blocks, "doc_id int, page_no int, block_no int, text string, bx0 double, by0 double, bx1 double, by1 double"),
    )
    want = sorted(
        (b[1], b[2], k[2]) for b in boxes for k in blocks
        if b[1] == k[1] and k[4] <= (b[3] + b[5]) / 2 <= k[6] and k[5] <= (b[4] + b[6]) / 2 <= k[7]
    )
    assert sorted((r.page_no, r.box_no, r.block_no) for r in got.collect()) == want


def test_allocation_follows_width(frame):
    m = frame([(1, 0, b, 0, 0.0, 0.0, w, 0.1, "abcdefghij") for b, w in ((0, 0.2), (1, 0.2), (2, 0.4))], "doc_id int, page_no int, box_no int, block_no int, x0 double, y0 double, x1 double, y1 double, block_text string")
    got = {r.box_no: r.text for r in Y.allocate_text(m).collect()}
    assert got == {0: "ab", 1: "cd", 2: "efghij"}  # 2.5 rounds to even


def test_page_number_of_images(frame):
    names = [f"{i:05d}.jpg" for i in range(30)] + ["a.JPG", "x.png", "notes.txt"]
    out = {r.name: (r.page_no, r.page_count) for r in Y.page_order(frame([(1, n) for n in names], "doc_id int, name string")).collect()}
    assert out["00000.jpg"] == (0, 32) and out["a.JPG"] == (30, 32) and out["x.png"] == (31, 32) and "notes.txt" not in out

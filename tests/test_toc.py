"""Literal cases for contents lists."""

import pytest

from bookweave.operators import resolve as R
from bookweave.operators import toc as T
from bookweave.operators.batch import map_pages, plan_batches


def pages_of(frame, texts):
    return frame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, page_no bigint, text string")


def range_of(frame, *texts):
    r = T.toc_range(pages_of(frame, texts)).first()
    return r.toc_start, r.toc_end


LIST = "第四章 河流与湖泊 ······ 61\n第五章 沿海的港口 ······ 88"


def test_range(frame):
    assert range_of(frame, "航海图志", "序言", "目录\n" + LIST, "第六章 灯塔 ······ 120", "灯塔建于山顶") == (2, 3)
    assert range_of(frame, "no list here", "nor here", "and the end") == (-1, -1)
    assert range_of(frame, "plain", "7.1 Oak\n7.2 Ash\n7.3 Elm\n7.4 Yew", "plain") == (-1, -1)  # sections without pages aren't dense
    dense = "\n".join(f"第{n}章 树木 ······ {7 * n}" for n in range(20, 26))
    assert range_of(frame, "plain", "plain", dense, "plain") == (2, 2)
    # A Chinese header word on a page that is mostly Latin doesn't count.
    assert range_of(frame, "a page of latin words with 目录 among very many of them", "plain") == (-1, -1)


def test_range_has_no_last_page(frame):
    texts = ["plain"] * 50 + ["Contents\nOak ...... 3\nAsh ...... 9"] + ["Elm ...... 12\nYew ...... 15"] * 40
    assert range_of(frame, *texts) == (50, 90)


def entries_of(frame, text):
    rows = T.toc_from_text(frame([(1, text)], "doc_id bigint, text string")).orderBy("seq").collect()
    return [(r.title, r.page) for r in rows]


def test_text_to_entries(frame):
    got = entries_of(frame, "第六章 灯塔 ······ 120\n  6.1 光源 ······ 121\n第七章 潮汐表 ······ 140")
    assert got == [("第六章 灯塔", 120), ("6.1 光源", 121), ("第七章 潮汐表", 140)]
    assert entries_of(frame, "附录\t301\n索引\t315") == [("附录", 301), ("索引", 315)]
    assert entries_of(frame, "") == [] and entries_of(frame, "海水的颜色随深度而变") == []
    # A chapter without a page takes that of the entry below it; one at the end has none and goes.
    assert entries_of(frame, "第八章 风暴\n8.1 预警 ······ 172\n第九章 归航") == [("第八章 风暴", 172), ("8.1 预警", 172)]


def test_pages_to_bookmark(frame):
    r = T.toc_from_pages(pages_of(frame, ["航海图志", "目录\n" + LIST, "第六章 灯塔 ······ 120", "灯塔"] + ["海"] * 50)).first()
    assert (r.bookmark, r.toc_start, r.toc_end) == ("第四章 河流与湖泊\t61\n第五章 沿海的港口\t88\n第六章 灯塔\t120", 1, 2)
    few = T.toc_from_pages(pages_of(frame, ["目录\n第四章 河流 ······ 2", "河流"])).first()
    assert (few.bookmark, few.toc_start, few.toc_end) == ("", 0, 0)
    none = T.toc_from_pages(pages_of(frame, ["oak", "ash", "elm"])).first()
    assert (none.bookmark, none.toc_start, none.toc_end) == ("", -1, -1)


def verdict(frame, pages, total):
    e = frame([(1, i, f"part {i}", p) for i, p in enumerate(pages)], "doc_id bigint, seq bigint, title string, page bigint")
    return T.validate_toc(e, frame([(1, total)], "doc_id bigint, total_pages bigint")).first().ok


def test_validation(frame):
    assert verdict(frame, [4, 19, 47, 80], 120)
    assert not verdict(frame, [], 120) and not verdict(frame, [4, 19], 120)  # too few
    assert verdict(frame, [4, 19, 360], 120) and not verdict(frame, [4, 361, 900], 120)  # up to three times the pages; most beyond
    assert not verdict(frame, [90, 4, 95, 6, 99], 120)  # falls too often
    assert verdict(frame, [4, 19, 47, 80, 3], 120) and verdict(frame, [19, 9, 20, 10], 120)  # one fall; falls of ten are small


def test_cross_validation(frame):
    titles = ["Granite and slate", "Limestone caves", "Volcanoes of Mars", "Tin"]
    e = frame([(5, i, t, 10 * i) for i, t in enumerate(titles)] + [(6, 0, "no text at all", 2)], "doc_id bigint, seq bigint, title string, page bigint")
    t = frame([(5, "Of granite ... Granite  and slate are hard. Lime stone caves are wet.")], "doc_id bigint, text string")
    # Found by its first four signs, blanks left out; titles of fewer than four and texts that are missing pass.
    assert sorted((r.doc_id, r.title) for r in T.cross_validate(e, t).collect()) == [(5, "Granite and slate"), (5, "Limestone caves"), (5, "Tin"), (6, "no text at all")]


def answer(frame, text):
    rows = T.parse_response(frame([(1, text)], "doc_id bigint, response string")).orderBy("seq").collect()
    return [(r.title, r.page) for r in rows]


def test_model_answers(frame):
    assert answer(frame, "第六章\t120\n第七章\t140\n第八章\t171\nTOC_COMPLETE") == [("第六章", 120), ("第七章", 140), ("第八章", 171)]
    assert answer(frame, "第六章\t120\n第七章\t140\nTOC_CONTINUES: 12-15") == [("第六章", 120), ("第七章", 140)]
    assert answer(frame, "NO_TOC") == []
    assert answer(frame, "- 第六章 灯塔 ······ 120\n- 第七章 ······ 140") == [("第六章 灯塔", 120), ("第七章", 140)]
    table = "| 第六章 | 灯塔 | 120 |\n|   | 光源 | none |\n|  | 透镜 | 126 |"
    assert answer(frame, table) == [("第六章 灯塔", 120), ("第六章 透镜", 126)]
    assert answer(frame, "第八章 风暴\n三、预警\n气压 ······ 174") == [("第八章 风暴", 174), ("三、预警", 174), ("气压", 174)]
    long = "第八章 " + "风" * 70
    assert answer(frame, f"{long}\n三、预警\n气压 ······ 174")[0] == (long, 174)


def test_split_response(frame):
    df = frame([(1, "here it is\n```\n第六章 灯塔 120\n\t光源 123456\n\t\t透镜 lxxviii\n余下\n```\nthat is all")], "doc_id bigint, response string")
    got = [(r.title, r.page, r.level) for r in T.split_response(df).orderBy("seq").collect()]
    assert got == [("第六章 灯塔", "120", 0), ("光源", "123456", 1), ("透镜", "lxxviii", 2), ("余下", "123456", 0)]


def test_split_response_long_numbers(frame):
    """With the limit of the SQL a card number or a word of numeral letters is no page."""
    df = frame([(1, "第一章 4015623723127985\nEl raezta llcill\n灯塔 12345\n光源 xviii")], "doc_id bigint, response string")
    got = [(r.title, r.page) for r in T.split_response(df, digits=5).orderBy("seq").collect()]
    assert got == [("第一章 4015623723127985", "1"), ("El raezta llcill", "1"), ("灯塔", "12345"), ("光源", "xviii")]


def test_bookmark_text(frame):
    df = frame([(1, "oak\t7\nash\tix\nelm\t9\t3\nyew")], "doc_id bigint, text string")
    assert [(r.title, r.page, r.explicit) for r in T.parse_bookmark_text(df).orderBy("seq").collect()] == [("oak", 7, None), ("elm", 9, 3)]
    assert [r.page for r in T.parse_bookmark_text(df, roman=True).orderBy("seq").collect()] == [7, 9, 9]


def test_batches(frame):
    docs = frame([(1, 90, 10, 39), (2, 33, -1, -1), (3, 9, 5, 4)], "doc_id bigint, total_pages bigint, toc_start bigint, toc_end bigint")
    got = sorted((r.doc_id, r.first_page, r.last_page) for r in plan_batches(docs, 4).collect())
    known = [(1, p, min(p + 3, 39)) for p in range(10, 40, 4)]
    assert got == known + [(2, p, min(p + 4, 32)) for p in range(0, 33, 5)]
    assert plan_batches(docs, 4, max_rounds=2).count() == 4


def test_failing_batches_say_why(frame):
    def fn(pdf):
        if (pdf["page_no"] == 2).any():
            raise RuntimeError("down")
        return list(pdf["text"].str.upper())

    got = map_pages(pages_of(frame, ["a", "b", "c"]), fn, batch=1)
    assert sorted((r.page_no, r.text, r.error) for r in got.collect()) == [(0, "A", None), (1, "B", None), (2, "", "RuntimeError: down")]


def test_tasks_grow_with_the_session(spark, frame):
    """A fixed number of tasks is the least, not the most; small batches keep their order and errors."""

    def fn(pdf):
        if pdf["page_no"].iloc[0] % 3 == 1:
            raise RuntimeError("down")
        return [t + "!" for t in pdf["text"]]

    got = map_pages(pages_of(frame, [str(i) for i in range(50)]), fn, batch=1, concurrency=2)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = [(i, "", "RuntimeError: down") if i % 3 == 1 else (i, f"{i}!", None) for i in range(50)]
    assert sorted((r.page_no, r.text, r.error) for r in got.collect()) == want


BOOKS = "id bigint, title string, author string, publisher string, isbn string, ss_code string"


def test_the_best_of_all_titles_is_found(frame):
    cat = frame([(i, f"tides and {'very ' * (9 - i)}long storms {i}", "", "", "", "") for i in range(9)] + [(20, "tides and", "", "", "", "")], BOOKS)
    req = frame([(1, "Tides and", "", "", "mine", "kept")], "req_id bigint, title string, isbn string, ss_code string, author string, note string")
    assert R.lookup_title(req, cat).first().hit_id == 20
    got = R.resolve(req, cat).first()
    assert (got.book_id, got.tier, got.author, got.note) == (20, "title", "mine", "kept")


def test_short_and_frequent_needles(frame):
    cat = frame([(i, t, "", "", "", "") for i, t in enumerate(["aaa b", "aab", "b", "xaaay", "a b", "aaa b"])], BOOKS)
    texts = cat.select("title").distinct().withColumnRenamed("title", "text")
    for needles in (["a"], ["aa", "b"], ["aaa"], ["aaa b", "zz", "ab"]):
        got = R.contains_join(frame([(n,) for n in needles], "needle string"), texts, "needle", "text").collect()
        want = {(n, t) for n in needles for t in {"aaa b", "aab", "b", "xaaay", "a b"} if n in t}
        assert sorted((r.needle, r.text) for r in got) == sorted(want)


def test_codes_with_signs_find_their_files(frame):
    files = frame([("a_b_title.pdf", 5000), ("c.d.epub", 5000), ("e_f.pdf", 10), ("plain", 5000)], "file_name string, bytes bigint")
    req = frame([(1, "x", "a_b"), (2, "x", "c.d"), (3, "x", "e_f"), (4, "plain", ""), (5, "x", "a")], "id bigint, name string, code string")
    got = {r.id: r.file_name for r in R.match_files(req, files, "id").collect()}
    assert got == {1: "a_b_title.pdf", 2: "c.d.epub", 4: "plain", 5: "a_b_title.pdf"}


@pytest.mark.parametrize("size", [5, 4096])
def test_openings_in_slices_equal_a_search(frame, monkeypatch, size):
    import random
    import re

    monkeypatch.setattr(T, "SLICE", size)
    r = random.Random(2)
    letters = "abcd 章—.\n😀"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = {d: make(r.randint(0, 60)) for d in range(12)} | {12: make(9000), 13: None, 14: " "}
    entries = [(d, i, make(r.randint(0, 9)), i) for d in range(16) for i in range(12)] + [(None, 0, "abcd", 1)]
    bare = lambda t: re.sub(r"[\s.\-—·…]", "", t or "")
    want = []
    for d in {e[0] for e in entries}:
        own = [e for e in entries if e[0] == d]
        text = texts.get(d)
        if not (text or "").strip():
            want += own
            continue
        hit = [len(bare(e[2])) >= 4 and bare(e[2])[:4] in bare(text) for e in own]
        short = [len(bare(e[2])) < 4 for e in own]
        want += own if len(own) >= 3 and sum(hit) / len(own) < 0.3 else [e for e, h, s in zip(own, hit, short) if h or s]
    got = T.cross_validate(frame(entries, "doc_id bigint, seq bigint, title string, page bigint"), frame(list(texts.items()), "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

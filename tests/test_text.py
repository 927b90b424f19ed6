import pytest

from bookweave.functions import logs as G
from bookweave.functions import text as X
from bookweave.functions import toclines as L

MD5 = "0" * 31 + "a"


@pytest.mark.parametrize(
    "title,main",
    [
        ("深度学习：方法与实践", "深度学习"),
        ("a: long subtitle", "a: long subtitle"),  # one character is no title
        ("Title—part", "Title"),
        ("书名（第二版）", "书名"),
        ("Trailing:", "Trailing:"),
        ("甲乙　丙", "甲乙"),
    ],
)
def test_main_title(one, title, main):
    assert one(X.main_title, title) == main


def test_title_similarity(one):
    assert one(X.title_similarity, "Spark", "spark") == pytest.approx(0.9)
    assert one(X.title_similarity, "abcd", "ab") == pytest.approx(0.8)
    assert one(X.title_similarity, "abcx", "abcy") == pytest.approx(0.75)
    assert one(X.title_similarity, "", "ab") == 0.0


def test_title_relevance_normalises(one):
    assert one(X.title_relevance, "ＳＰＡＲＫ", "spark guide") == 100
    assert one(X.title_relevance, "中国历史", "中国地理") == 50
    assert one(X.title_relevance, "red blue", "red green") == 50
    assert one(X.title_relevance, "", "x") == 0


def test_isbn(one):
    assert one(X.isbn_extract, "ISBN: 978-7-302-51234-5") == "9787302512345"
    assert one(X.isbn_extract, "none") is None
    assert one(X.isbn_norm, "978-7 302") == "9787302"
    assert one(X.isbn13_tail, "9787302512345") == "7302512345"


@pytest.mark.parametrize("label,size", [("15.2 MB", 15938355), ("1,5 KB", 1536), ("3 MiB", 0), ("GB", 0), (" 2 gb ", 2147483648)])
def test_parse_size(one, label, size):
    assert one(X.parse_size, label) == size


def test_size_match(one):
    assert one(X.size_match, 100000, 0).level == "size_unknown"
    assert one(X.size_match, 100, 90).level == "too_small"
    assert one(X.size_match, 100500, 100000).level == "exact"
    assert one(X.size_match, 104000, 100000).level == "approximate"
    assert not one(X.size_match, 200000, 100000).ok


def test_names(one):
    assert one(X.sanitize, 'ａ<b>: "c"') == "a_b__ _c_"
    assert one(X.sanitize, "word " * 30) == ("word " * 30).strip()
    cut = [one(lambda t: X.sanitize(t, 40), "word " * 30 + end) for end in ("a", "b")]
    assert len(cut[0]) == 40 and cut[0] != cut[1] and cut[0].startswith("word word")
    fill = lambda t, a: X.apply_template("{author}_{title}", {"authors": a, "title": t})
    assert one(fill, "Book", "") == "Book.pdf"
    assert one(fill, "", "") is None
    assert one(lambda t: X.apply_template("fixed", {"title": t}), "x") is None


def test_cjk_ratio(one):
    assert one(X.cjk_ratio, "目录 ab") == 0.5
    assert one(X.cjk_ratio, "　 ") == 0.0


@pytest.mark.parametrize("text,n", [("十", 10), ("十二", 12), ("三十", 30), ("二十一", 21), ("xiv", 14), ("XX", 20), (" 12 ", 12), ("abc", None), ("", None)])
def test_page_number(one, text, n):
    assert one(L.page_number, text) == n


@pytest.mark.parametrize(
    "line,entry",
    [
        ("第一章 概论 ..... 1", ("第一章 概论", 1)),
        ("- 第一章 概论 ..... 1", ("第一章 概论", 1)),
        ("## 标准\t12", ("标准", 12)),
        ("Intro | 简介 | 5", ("Intro", 5)),
        ("绪论 …… xiv", ("绪论", 14)),
        ("2.1 background 15", ("2.1 background", 15)),
        ("目录", None),
        ("| --- | --- |", None),
        ("plain text", None),
        ("zero 0", None),
    ],
)
def test_parse_toc_line(one, line, entry):
    got = one(L.parse_toc_line, line)
    assert (tuple(got) if got else None) == entry


@pytest.mark.parametrize("title,level", [("第一部分", (1, True)), ("上篇 总论", (1, True)), ("第二章 x", (2, True)), ("Chapter 3", (2, True)), ("第三节", (3, True)), ("一、背景", (4, False)), ("1.2 x", (4, False)), ("附录A", (1, False)), ("前言", (2, False))])
def test_heading_level(one, title, level):
    assert tuple(one(L.heading_level, title)) == level


def test_response_status(one):
    assert tuple(one(L.response_status, "a\t1\nTOC_CONTINUES: 6-10")) == ("TOC_CONTINUES", 6, 10)
    assert one(L.response_status, "no_toc")["status"] == "NO_TOC"
    assert one(L.response_status, None)["status"] == "NO_TOC"


@pytest.mark.parametrize(
    "status,message",
    [
        ('{"current":{"md5":"%s","failed_at":"2026","error":"Mirror failed","status":"failed"},"queue":[],"recent_history":[]}', "Mirror failed"),
        ('{"current":null,"queue":[{"md5":"%s","failed_at":"2026","error_message":"Got 403"}]}', "Got 403"),
        ('{"recent_history":[{"md5":"%s","failed_at":"2026","error":"timeout"}]}', "timeout"),
        ('{"current":{"md5":"%s","progress":{"percent":45}},"queue":[]}', None),
        ('{"current":{"md5":"x%s","failed_at":"2026","error":"other"}}', None),
        ('{"current":{"md5":"%s","status":"downloading"}}', None),
        ('{"current":null,"queue":[],"recent_history":[],"id":"%s"}', None),
        ('{"id":"%s"}', None),
        ('{"current":{"md5":"%s","failed_at":"2026","status_message":"Mirror"}}', "Mirror"),
        ('{"queue":[{"md5":"%s","failed_at":"2026","message":"refused"}],"current":null}', "refused"),
        ('{"current":{"md5":"%s","status":"failed"}}', "unknown error"),
    ],
)
def test_failure_message(one, status, message):
    assert one(G.failure_message, status % MD5, MD5) == message


def test_progress_and_stage(one):
    assert tuple(one(G.parse_progress, "[3/10] page")) == (3, 10)
    assert tuple(one(lambda c, t: G.parse_progress(c, t), "46 [tesseract] x", 200)) == (46, 200)
    assert tuple(one(G.parse_stage, "Converting 50% (5/10)")) == ("convert", 50, 5, 10, 18)
    assert one(G.parse_stage, "Done").overall == 90
    assert one(G.parse_stage, "hello") is None


@pytest.mark.parametrize(
    "template, title, name",
    [
        ("{author}_{title} ({ss_code})", "T", "T.pdf"),
        ("{title}.pdf", " _ - ", None),
        ("{title} - .pdf", "a", "a.pdf"),
        ("__{title}__x", "a_b", "a_b_x.pdf"),
        ("{title}.PDF", "a", "a.PDF"),
        ("{title}.pdf", "a.pdf", "a.pdf.pdf"),
        ("{title}).", "a", "a.pdf"),
        ("{other} {title}", "a", "{other} a.pdf"),
        ("{title}", "{author}", "{author}.pdf"),
        ("({title})", "", None),
    ],
)
def test_template_names(one, template, title, name):
    assert one(lambda t: X.apply_template(template, {"title": t}), title) == name


def test_every_numeral_of_the_tables(spark):
    cn, roman = L.cn_numerals(), L.roman_numerals()
    words = [*cn, *roman, *(r.upper() for r in roman), "xxvi", "iiii", "十十十", "一一", "百", "", "12", "〇", "xviii", "一十"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", L.cn_to_int("w").alias("c"), L.page_number("w").alias("p")).collect()
    for r in rows:
        assert r.c == cn.get(r.w), r.w
        assert r.p == (int(r.w) if r.w.isdigit() and r.w.isascii() else cn.get(r.w, roman.get(r.w.lower()))), r.w

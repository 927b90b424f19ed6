import hashlib

import pytest

from bookweave.operators import pages as P
from bookweave.operators import resolve as R
from bookweave.operators import search as S
from bookweave.sources import catalog as C
from bookweave.sources import files as F
from bookweave.sources import layout as L


def test_catalogs_rename_tag_and_skip(spark, frame, tmp_path):
    frame([(1, "x", "978")], "id bigint, title string, ISBN string").write.parquet(str(tmp_path / "a"))
    frame([(2, "y", "07")], "id bigint, title string, SS_code string").write.parquet(str(tmp_path / "b"))
    got = C.read_catalog(spark, {"a": str(tmp_path / "a"), "gone": str(tmp_path / "gone"), "b": str(tmp_path / "b")})
    assert sorted((r.source, r.isbn, r.ss_code) for r in got.collect()) == [("a", "978", None), ("b", None, "07")]


def test_unknown_field(frame):
    with pytest.raises(ValueError):
        S.search_field(frame([("x",)], "title string"), "publisher_code", "x")


def test_search_reaches_the_scan(spark, frame, tmp_path):
    frame([("red", "b")], "title string, other string").write.parquet(str(tmp_path / "c"))
    plan = S.search_field(spark.read.parquet(str(tmp_path / "c")).select("title"), "title", "red")._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan


def test_rows_without_isbn_stay(frame):
    df = frame([(1, "", "a"), (2, "", "a"), (3, "9", "a"), (4, "9", "a"), (5, None, "a")], "id bigint, isbn string, ss_code string")
    assert sorted(r.id for r in S.dedupe_books(df, ["id"]).collect()) == [1, 2, 3, 5]


def test_fill_and_override(frame):
    base = frame([(1, "", "p", [])], "k int, author string, publisher string, authors array<string>")
    extra = frame([(1, "A", "q")], "k int, author string, publisher string")
    filled = R.enrich_fill(base, extra, ["k"], ["author", "publisher"]).first()
    assert (filled.author, filled.publisher, filled.authors) == ("A", "p", ["A"])
    assert R.enrich_override(base, extra, ["k"], ["publisher"]).first().publisher == "q"


def test_isbn_with_hyphens_in_the_catalog(frame):
    cat = frame([(5, "t", "a", "p", "978-7-1", "c")], "id bigint, title string, author string, publisher string, isbn string, ss_code string")
    req = frame([(1, "978-7", "", ""), (2, "9787", "", ""), (3, "", "", "")], "req_id bigint, isbn string, title string, ss_code string")
    assert [(r.req_id, r.hit_id) for r in R.lookup_isbn(req, cat).collect()] == [(1, 5)]


def test_audit(spark, frame, tmp_path):
    good, bad = b"%PDF" + b"x" * 60000, b"<html>" + b"y" * 60000
    for n, data in (("a.pdf", good), ("b.pdf", bad), ("c.pdf", good), ("d.pdf", b"%PDF")):
        (tmp_path / n).write_bytes(data)
    want = frame([("a.pdf", hashlib.md5(good).hexdigest().upper(), len(good)), ("c.pdf", "0" * 32, 0)], "name string, md5 string, bytes bigint")
    got = {r.name: (r.verdict, r.size_class) for r in F.audit_files(F.read_files(spark, str(tmp_path), "*.pdf"), want).collect()}
    assert got == {"a.pdf": ("ok", "exact"), "b.pdf": ("mismatch", "size_unknown"), "c.pdf": ("mismatch", "size_unknown"), "d.pdf": ("mismatch", "size_unknown")}


def test_markdown_pages(frame):
    line = '{"result":{"layoutParsingResults":[{"markdown":{"text":"# T","images":{"a":"u"}},"outputImages":{}},{"markdown":{"text":"x"}}]}}'
    df = frame([(1, 0, line), (1, 1, "  "), (1, 2, line)], "doc_id bigint, line_no bigint, line string")
    got = L.parse_page_markdown(df).orderBy("page_no").collect()
    assert [r.markdown for r in got] == ["# T", "x", "# T", "x"] and got[0].images == {"a": "u"}


def test_content_list(frame):
    data = '[{"type":"text","text":"a","bbox":[1,2,3,4],"page_idx":0},{"type":"text","text":" ","bbox":[1,2,3,4],"page_idx":0},{"type":"text","text":"b","bbox":[1,2,3,4],"page_idx":1}]'
    got = L.parse_content_list(frame([(1, data)], "doc_id bigint, json string")).orderBy("page_no").collect()
    assert [(r.page_no, r.text, r.bx0) for r in got] == [(0, "a", 1.0), (1, "b", 1.0)]


def test_line_boxes(frame):
    good = '{"pages":[{"page":0,"width":9,"height":9,"boxes":[[0,0,1,1],[0,1,1,2]]},{"page":1,"boxes":[[0,0,1,1]]},{"page":2,"boxes":[]}]}'
    got = L.parse_line_boxes(frame([(1, good), (2, "nope")], "doc_id bigint, json string")).collect()
    assert sorted((r.doc_id, r.page_no, r.box_no) for r in got if r.error is None and r.box_no is not None) == [(1, 0, 0), (1, 0, 1), (1, 1, 0)]
    assert [(r.page_no) for r in got if r.doc_id == 1 and r.box_no is None] == [2]
    assert [r.error for r in got if r.doc_id == 2] == ["invalid JSON"]


def test_repeated_links_keep_their_first_block(frame):
    a, b = "a" * 32, "b" * 32
    html = f'<a href="/md5/{a}"> One </a> Year: 2001 <a href="/md5/{a}">again</a> Year: 1999 <a href="/md5/{b}">Two</a> Year: 2002'
    got = P.extract_cards(frame([(1, html)], "page_id bigint, html string"), "/md5/([a-f0-9]{32})").orderBy("pos").collect()
    assert [(r.link, r.title, r.year) for r in got] == [(a, "One", "2001"), (b, "Two", "2002")]

"""Elements of stored HTML: nesting, quoting, unclosed and hidden markup, character references."""

import pytest
from pyspark.sql import functions as F

from bookweave.functions import html as H

ANY = lambda tag: F.lit(True)


@pytest.mark.parametrize(
    "html, tag, wanted, found",
    [
        ("<div><div>a</div>b</div><div>c</div>", "div", ANY, ["<div>a</div>b", "a", "c"]),
        ("x<DIV class='b a'>1</DIV><div class=\"a c\">2</div><div class=a>3</div>", "div", H.has_classes("a"), ["1", "2", "3"]),
        ("<div class='a-b'>1</div><div data-class='a'>2</div><divx class='a'>3</divx>", "div", H.has_classes("a"), []),
        ("<div class='b x a'>1</div><div class='a'>2</div>", "div", H.has_classes("a", "b"), ["1"]),
        ("<div class='text-2xl lead-[1.2]'>1</div>", "div", H.class_contains("lead-[1.2]", "2xl"), ["1"]),
        ("<div title='a > b' id=\"q\">1</div>", "div", lambda tag: H.attribute(tag, "id") == "q", ["1"]),
        ("<div>a<div/>b</div>c", "div", ANY, ["a<div/>b"]),
        ("<div>a<div>b", "div", ANY, ["a<div>b", "b"]),
        ("</div><div>a</div></div><div>b</div>", "div", ANY, ["a", "b"]),
        ("no tags", "div", ANY, []),
        ("", "div", ANY, []),
        (None, "div", ANY, None),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", "ul", ANY, ["<li>a<ul><li>b</li></ul></li>", "<li>b</li>"]),
    ],
)
def test_elements(one, html, tag, wanted, found):
    assert one(lambda c: H.elements(c, tag, wanted), html) == found


@pytest.mark.parametrize(
    "fragment, text",
    [
        (" a <b> b\n</b><i title='>'>c</i> ", "abc"),
        ("1 &lt; 2 &amp;&#65;&#x4e2d;&#0;&#99999999; &nbsp;", "1 < 2 &A中\0&#99999999;"),
        ("&amp;lt; & &#; &#12", "&lt; & &#; &#12"),
        ("", ""),
    ],
)
def test_inner_text(one, fragment, text):
    assert one(H.inner_text, fragment) == text


@pytest.mark.parametrize(
    "html, lines",
    [
        ("<p id='x'>a<br>b\nc <b>d</b></p>", "a\nb\nc\nd"),
        ("<div><ol class=k id=x><li>a <b>b</b><ol><li>c</li></ol></li><li></li></ol></div><li>z</li>", "a b c\nc\n"),
        ("<!-- <p id='x'>no</p> --><p id='xx'>no</p><p id=\"x\">yes</p>", "yes"),
        ("<p>none</p>", None),
        ("<p id='x'> </p>", None),
    ],
)
def test_list_lines(one, html, lines):
    assert one(lambda c: H.list_lines(c, "x"), html) == lines


@pytest.mark.parametrize(
    "html, toc",
    [
        ("<div class='indent'><span class='pl'>目录</span>short</div><div class='b indent'><span class=\"pl\">目录：</span><div>one, long</div>two</div>", "one, long\ntwo"),
        ("<div class='indent'><span class='pl'>other</span>longer than ten</div><div id='a_dir'>" + "x" * 50 + "</div><div id='dir2'><div>" + "y" * 51 + "</div></div>", "y" * 51),
        ("<script>'<div id=\"dir\">" + "x" * 60 + "</div>'</script>", None),
    ],
)
def test_page_toc_tries_every_candidate(one, html, toc):
    assert one(H.page_toc, html) == toc


def test_deep_nesting_takes_one_pass(one):
    deep = "<div>" * 400 + "x" + "</div>" * 400
    assert one(lambda c: F.length(H.first_element(c, "div", ANY)), deep) == len(deep) - 11


def test_small_tables_are_spread(spark):
    """Pages are made of rows of few bytes: one split of them would be one task."""
    from bookweave.plans.views import Views

    from .conftest import SMALL

    for view in ("book_pages", "record_pages", "cards"):
        assert getattr(Views(spark, SMALL), view).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_page_is_cleaned_once(spark, frame):
    """Comments and scripts are taken out of a page once, not once for each use of the page."""
    from bookweave.operators import pages as P

    pages = frame([(1, "<p>")], "page_id bigint, html string")
    for out in (P.extract_book_page(pages), P.extract_detail(pages), P.extract_page_toc(pages), P.extract_list_lines(pages, "x")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("<!--.*?-->") == 1


def test_jsonld_is_found_once(spark, frame):
    from bookweave.operators import pages as P

    plan = P.extract_page_fields(frame([(1, "<p>")], "page_id bigint, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ld\\+json") <= 2


def test_many_nested_elements(one):
    text = "<div>" * 3 + "a" + "</div>b" * 2 + "<div>c</div><DIV/>"
    assert one(lambda c: H.elements(c, "div", ANY), text) == ["<div><div>a</div>b</div>b<div>c</div><DIV/>", "<div>a</div>b", "a", "c"]

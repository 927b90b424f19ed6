"""Queries over stored HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import nonempty, strip_tags
from ..operators import pages as P
from .registry import query
from .views import Views

_HREF = "/md5/([a-f0-9]{32})"


def _all(html: str, pattern: str, n: int, src: str) -> str:
    cols = ", ".join(f"unnest(regexp_extract_all({html}, '{pattern}', {g})) AS g{g}" for g in range(1, n + 1))
    return f"SELECT page_id, {cols}, unnest(range(len(regexp_extract_all({html}, '{pattern}', 1)))) AS pos FROM {src}"


@query(
    "extract_links",
    f"""SELECT page_id, CAST(pos AS BIGINT) AS pos, g1 AS link, nullif(trim(g2), '') AS anchor FROM ({_all('html', 'href="/([^"]*)"[^>]*>\\s*([^<]+)', 2, 'pages')}) QUALIFY row_number() OVER (PARTITION BY page_id, g1 ORDER BY pos) = 1""",
)
def extract_links(v: Views):
    return P.extract_links(v.pages, '/([^"]*)')


def _field(p: str, extra: str = "") -> str:
    return f"nullif(trim(regexp_extract(block, '{p}', 1)), '')"


_CARD = f"""
    SELECT page_id, CAST(pos AS BIGINT) AS pos, link, nullif(trim(regexp_extract(block, '^[^>]*>\\s*([^<]+)', 1)), '') AS title,
           {_field(H.CARD_PATTERNS['year'])} AS year, {_field(H.CARD_PATTERNS['publisher'])} AS publisher, lower(coalesce({_field(H.CARD_PATTERNS['format'])}, {_field(H.BARE_FORMAT)})) AS format,
           coalesce({_field(H.CARD_PATTERNS['size'])}, {_field(H.BARE_SIZE)}) AS size, {_field(H.CARD_PATTERNS['author'])} AS author, {_field(H.CARD_PATTERNS['language'])} AS language, {_field(H.CARD_PATTERNS['isbn'])} AS isbn
    FROM (SELECT page_id, unnest(links) AS link, unnest(blocks[2:]) AS block, unnest(range(len(links))) AS pos FROM (
            SELECT page_id, regexp_extract_all(html, '<a[^>]*href="/md5/([a-f0-9]{{32}})"', 1) AS links, string_split_regex(html, '<a[^>]*href="/md5/[a-f0-9]{{32}}"') AS blocks FROM cards))
    QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1"""


@query("extract_cards", _CARD)
def extract_cards(v: Views):
    return P.extract_cards(v.cards, _HREF)


_LD = """
    SELECT page_id, json_extract_string(ld, '$.name') AS name, array_to_string(list_transform(CAST(json_extract(ld, '$.author') AS JSON[]), lambda a: json_extract_string(a, '$.name')), ', ') AS author,
           coalesce(json_extract_string(ld, '$.publisher.name'), json_extract_string(ld, '$.publisher')) AS publisher, json_extract_string(ld, '$.isbn') AS isbn, left(json_extract_string(ld, '$.datePublished'), 4) AS year, json_extract_string(ld, '$.inLanguage') AS language, html
    FROM (SELECT page_id, html, regexp_extract(html, '(?s)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1) AS ld FROM cards)"""


@query("parse_jsonld", f"SELECT * EXCLUDE (html) FROM ({_LD})")
def parse_jsonld(v: Views):
    from ..functions.text import first_match

    return v.cards.withColumn("ld", H.parse_jsonld(first_match("html", H.JSONLD))).select("page_id", "ld.*")


def _page(n: str) -> str:
    return f"nullif(trim(regexp_extract(html, '{H.PAGE_PATTERNS[n]}', 1)), '')"


_TITLE = "nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g')), '')"


@query(
    "extract_page_fields",
    f"""SELECT page_id, coalesce({_TITLE}, name, CAST(page_id AS VARCHAR)) AS title, coalesce(author, {_page('author')}) AS author, coalesce(language, {_page('language')}) AS language, {_page('format')} AS format, {_page('size')} AS size,
               coalesce(year, {_page('year')}) AS year, coalesce(isbn, {_page('isbn')}) AS isbn, coalesce(publisher, {_page('publisher')}) AS publisher FROM ({_LD})""",
)
def extract_page_fields(v: Views):
    return P.extract_page_fields(v.cards)


@query(
    "crawled_page_fields",
    f"SELECT page_id, coalesce({_TITLE}, url) AS title, {_page('author')} AS author, {_page('language')} AS language, {_page('format')} AS format, {_page('size')} AS size, {_page('year')} AS year, {_page('isbn')} AS isbn, {_page('publisher')} AS publisher FROM pages",
)
def crawled_page_fields(v: Views):
    return P.extract_page_fields(v.pages, fallback=F.col("url"))


@query("strip_tags", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars, regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g') AS heading FROM pages")
def strip(v: Views):
    return v.pages.select(
        "page_id", F.length(strip_tags("html")).cast("bigint").alias("chars"), strip_tags(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("heading")
    )


@query(
    "extract_detail",
    """SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN p_name WHEN page_id % 5 = 0 THEN concat(p_name, '.v2') ELSE concat(p_name, ' heading') END AS title, concat('978-', lpad(CAST(page_id AS VARCHAR), 10, '0')) AS isbn,
              CASE WHEN page_id % 2 = 0 THEN 'pdf' WHEN page_id % 5 = 0 THEN 'epub' END AS extension, CAST(page_id AS VARCHAR) AS provider_id,
              CASE WHEN page_id % 2 = 1 THEN page_id * 1000 ELSE CAST(floor((p_size + 0.5) * 1048576) AS BIGINT) END AS filesize_bytes
       FROM record_pages JOIN part ON p_partkey = page_id""",
)
def extract_detail(v: Views):
    return P.extract_detail(v.record_pages)


@query(
    "extract_book_page",
    """SELECT page_id, p_name AS title, concat_ws('|', p_brand, s_name) AS authors, concat_ws('|', concat('出版社::', p_type), concat('出版年::', CAST(1950 + page_id % 70 AS VARCHAR)), concat('ISBN::978', lpad(CAST(page_id AS VARCHAR), 10, '0'))) AS pub_info,
              concat('978', lpad(CAST(page_id AS VARCHAR), 10, '0')) AS isbn, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id % 10 AS DOUBLE) + 0.5 END AS rating, concat(p_name, 'by A&', p_brand) AS description, concat_ws('|', p_type, p_brand) AS tags
       FROM book_pages JOIN part ON p_partkey = page_id LEFT JOIN supplier ON s_suppkey * 20 = page_id - page_id % 20""",
)
def extract_book_page(v: Views):
    out = P.extract_book_page(v.book_pages)
    return out.select("page_id", "title", *[F.array_join(c, "|").alias(c) for c in ("authors", "pub_info", "tags")], "isbn", "rating", "description")


@query(
    "extract_page_toc",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat(p_name, ' one', chr(10), p_brand, ' two') WHEN 1 THEN concat(p_name, ' chapter one of many,', p_brand, ' chapter two of many, the end') END AS toc FROM book_pages JOIN part ON p_partkey = page_id""",
)
def extract_page_toc(v: Views):
    return P.extract_page_toc(v.book_pages)


@query("extract_marc", "SELECT page_id, p_brand AS author, p_type AS publisher, CAST(1950 + page_id % 70 AS VARCHAR) AS year FROM marc_pages JOIN part ON p_partkey = page_id")
def extract_marc(v: Views):
    return P.extract_marc(v.marc_pages)


@query("extract_marc_toc", "SELECT page_id, concat(p_name, ', a long enough abstract of ', p_brand) AS toc FROM marc_pages JOIN part ON p_partkey = page_id")
def extract_marc_toc(v: Views):
    return P.extract_marc_toc(v.marc_pages)


@query("extract_list_lines", "SELECT page_id, concat(p_name, ' x inner', chr(10), 'inner', chr(10), p_brand) AS lines FROM book_pages JOIN part ON p_partkey = page_id")
def extract_list_lines(v: Views):
    return P.extract_list_lines(v.book_pages, "book-contents")


@query("page_titles", f"SELECT page_id, coalesce({_TITLE}, url) AS title FROM pages")
def page_titles(v: Views):
    return v.pages.select("page_id", F.coalesce(H.page_title("html"), nonempty("url")).alias("title"))

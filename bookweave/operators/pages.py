"""Fields, links, cards and lists out of a table of stored HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import first_match, let, nonempty, parse_size, strip_tags, trim_u
from .ordered import top_per_group


def extract_links(pages: DataFrame, href: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """First occurrence of every link whose address matches ``href`` (one group), with its anchor text."""
    pattern = f'href="{href}"[^>]*>\\s*([^<]+)'
    ids = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2))
    found = pages.select(key, F.posexplode(F.arrays_zip(ids.alias("link"), texts.alias("anchor"))).alias("pos", "m"))
    links = found.select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col("m.link").alias("link"), nonempty(F.col("m.anchor")).alias("anchor")
    )
    return top_per_group(links, [key, "link"], [F.col("pos")])


def _card_blocks(html: Column, href: str) -> Column:
    return F.slice(F.split(html, f'<a[^>]*href="{href}"'), F.lit(2), F.lit(2**31 - 1))


def extract_cards(pages: DataFrame, href: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Fields of every result card; the block after a link belongs to that link.

    A repeated link keeps the block of its first occurrence.
    """
    bare = href.replace("(", "(?:", 1) if "(" in href else href
    links = F.regexp_extract_all(F.col(html), F.lit(f'<a[^>]*href="{href}"'), F.lit(1))
    cards = pages.select(
        key, F.posexplode(F.arrays_zip(links.alias("link"), _card_blocks(F.col(html), bare).alias("block"))).alias("pos", "m")
    ).select(key, F.col("pos").cast("bigint").alias("pos"), F.col("m.link").alias("link"), F.col("m.block").alias("block"))
    cards = top_per_group(cards, [key, "link"], [F.col("pos")])
    block = F.col("block")
    field = {n: nonempty(first_match(block, p)) for n, p in H.CARD_PATTERNS.items()}
    field["format"] = F.lower(F.coalesce(field["format"], first_match(block, H.BARE_FORMAT)))
    field["size"] = F.coalesce(field["size"], nonempty(first_match(block, H.BARE_SIZE)))
    title = nonempty(F.regexp_extract(block, "^[^>]*>\\s*([^<]+)", 1))
    return cards.select(key, "pos", "link", title.alias("title"), *[c.alias(n) for n, c in field.items()])


def extract_page_fields(pages: DataFrame, key: str = "page_id", html: str = "html", fallback: Column | None = None) -> DataFrame:
    """Detail page: <title>, then JSON-LD, then label patterns; the title falls back to the id."""
    text = F.col(html)
    staged = pages.withColumn("_ld", H.parse_jsonld(first_match(text, H.JSONLD))).withColumn("_title", H.page_title(text))
    ld = F.col("_ld")
    known = {"author": ld["author"], "publisher": ld["publisher"], "isbn": ld["isbn"], "year": ld["year"], "language": ld["language"]}
    other = fallback if fallback is not None else F.col(key).cast("string")
    return staged.select(
        key,
        F.coalesce("_title", ld["name"], other).alias("title"),
        *[
            F.coalesce(*([known[n]] if n in known else []), let(trim_u(F.regexp_extract(text, p, 1)), lambda t: F.nullif(t, F.lit("")))).alias(n)
            for n, p in H.PAGE_PATTERNS.items()
        ],
    )


def extract_detail(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Record page: title, isbn, extension, provider id and byte size."""
    # Columns of their own, used often, are computed once; an expression would be computed for each use.
    text, seen = F.col("_html"), F.col("_seen")
    tabs = H.elements(seen, "a", H.has_classes("js-md5-codes-tabs-tab"))
    spans = F.transform(tabs, lambda tab: F.transform(H.elements(tab, "span", lambda _: F.lit(True)), lambda x: H.inner_text(x)))
    found = F.transform(F.filter(spans, lambda s: (F.size(s) >= 2) & F.contains(F.get(s, 0), F.lit("Filepath"))), lambda s: F.get(s, 1))
    paths = F.col("_paths")
    names = F.transform(paths, lambda path: F.regexp_extract(path, "([^/\\\\]*)$", 1))
    name = F.col("_name")
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(name)
    guesses = F.transform(paths, lambda path: F.lower(F.regexp_extract(path, "\\.([^.]*)$", 1)))
    guess = F.get(F.filter(guesses, lambda g: g.isin(H.DETAIL_EXTENSIONS)), 0)
    meta = H.inner_text(H.first_element(seen, "div", H.class_contains("text-gray-800", "font-semibold", "text-sm", "mt-4")), " ")
    parts = F.transform(F.split(meta, "·"), lambda p: F.regexp_replace(F.lower(trim_u(p)), "^\\.", ""))
    listed = F.try_element_at(F.filter(parts, lambda p: p.isin(H.DETAIL_EXTENSIONS)), F.lit(-1))
    tagged = F.lower(first_match(text, "(?i)(?:filetype|extension|Format)[:\\s]*<[^>]*>([a-z0-9]{2,6})<"))
    heading = nonempty(first_match(text, "<h\\d[^>]*>([^<]{3,})</h\\d>"))
    cell = first_match(seen, "(?is)ISBN\\s*:(?:\\s|<[^>]+>)*?</td>\\s*<td[^>]*>(.*?)</td>")
    size = first_match(text, 'filesize_bytes["\\s:]+(\\d+)').try_cast("bigint")
    label = first_match(text, "(?i)File\\s*size[:\\s]*<[^>]*>([^<]+)<")
    title = H.inner_text(H.first_element(seen, "div", H.class_contains("font-semibold", "text-2xl", "leading-[1.2]")))
    staged = pages.select(key, F.col(html).alias("_html"), F.regexp_replace(F.col(html), H.HIDDEN, "").alias("_seen")).select(
        "*", found.alias("_paths"), F.replace(title, F.lit("​"), F.lit("")).alias("_title"), cell.alias("_cell"), listed.alias("_listed")
    ).select("*", F.get(F.filter(names, lambda n: n != ""), 0).alias("_name"), guess.alias("_guess"))
    return staged.select(
        key,
        F.coalesce(nonempty("_title"), nonempty(stem), heading).alias("title"),
        F.coalesce(
            first_match(strip_tags("_cell"), "(\\d[\\d\\-X]{9,})"), first_match(text, "(?i)ISBN[:\\s]*(\\d[\\d\\-X]{9,})")
        ).alias("isbn"),
        F.coalesce("_listed", "_guess", tagged).alias("extension"),
        F.coalesce(
            first_match(text, "z-lib(?:rary)?.{0,20}/(\\d+)"), first_match(text, 'zlib_id["\\s:]+(\\d+)')
        ).alias("provider_id"),
        F.coalesce(size, parse_size(label)).alias("filesize_bytes"),
    )


def extract_book_page(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Book page: title, authors, publication lines, isbn, rating, description, tags."""
    text = F.col("_text")
    label = "(?s)<span(?=[^>]*\\sclass\\s*=\\s*[\"']?[^\"'>]*(?<![\\w-])pl(?![\\w-]))[^>]*>\\s*"
    author_part = F.regexp_extract(text, label + "作者.*?</span>(.*?)(?:<br|</span>\\s*<span|</div>)", 1)
    names = F.transform(H.elements(author_part, "a", lambda _: F.lit(True)), lambda x: H.inner_text(x))
    line = label + "((?:出版社|出版年|ISBN)[^<]*)</span>([^<]*)"
    heads = F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(1)), trim_u)
    tails = F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(2)), lambda t: trim_u(H.unescaped(t)))
    info = F.filter(
        F.zip_with(heads, tails, lambda h, t: F.when(t != "", F.concat(h, F.lit(":"), t))), lambda x: x.isNotNull()
    )
    isbn_tail = F.regexp_extract(text, label + "[^<]*ISBN[^<]*</span>([^<]*)", 1)
    valued = lambda value: lambda tag: H.attribute(tag, "property") == value
    tags = F.transform(H.elements(text, "a", H.has_classes("tag")), lambda x: H.inner_text(x))
    # Columns of their own, used often, are computed once; an expression would be computed for each use.
    staged = pages.select(key, F.regexp_replace(F.col(html), H.HIDDEN, "").alias("_text")).select(
        key,
        H.inner_text(H.first_element(text, "span", valued("v:itemreviewed"))).alias("_title"),
        names.alias("_names"),
        info.alias("pub_info"),
        isbn_tail.alias("_isbn"),
        H.inner_text(H.first_element(text, "strong", valued("v:average"))).alias("_rating"),
        H.inner_text(H.first_element(text, "div", H.has_classes("intro"))).alias("_intro"),
        tags.alias("_tags"),
    )
    return staged.select(
        key,
        nonempty("_title").alias("title"),
        F.filter("_names", lambda a: a != "").alias("authors"),
        "pub_info",
        first_match("_isbn", "(\\d{10,13})").alias("isbn"),
        F.col("_rating").try_cast("double").alias("rating"),
        nonempty("_intro").alias("description"),
        F.filter("_tags", lambda a: a != "").alias("tags"),
    )


def extract_page_toc(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, H.page_toc(html).alias("toc"))


def extract_marc(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.withColumn("_marc", H.marc_fields(strip_tags(html))).select(key, "_marc.author", "_marc.publisher", "_marc.year")


def extract_marc_toc(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, H.marc_toc(html).alias("toc"))


def extract_list_lines(pages: DataFrame, element_id: str, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, H.list_lines(html, element_id).alias("lines"))

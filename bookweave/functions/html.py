"""Scalars that pull fields out of stored HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, first_match, let, nonempty, strip_tags, trim_u

TAGS = "(?:<[^>]+>)*"

# Labels of result cards.
CARD_PATTERNS = {
    "year": "(?:年|Year|year|Published)[^：:>]*[：:>]\\s*" + TAGS + "(\\d{4})",
    "publisher": "(?:出版社?|Publisher|publisher|Published by)[^：:>]*[：:>]\\s*" + TAGS + "([^<\\n]+)",
    "format": "(?:格式|文件类型|Format|format|Extension|类型)[^：:>]*[：:>]\\s*" + TAGS + "(\\w+)",
    "size": "(?:大小|文件大小|Size|size|File\\s*size)[^：:>]*[：:>]\\s*" + TAGS + "([\\d. ]+\\s*(?:MB|GB|KB|MiB|GiB|B))",
    "author": "(?:作者|Author|author)[^：:>]*[：:>]\\s*" + TAGS + "([^<\\n]+)",
    "language": "(?:语言|Language|lang)[^：:>]*[：:>]\\s*" + TAGS + "(\\w+)",
    "isbn": "[Ii][Ss][Bb][Nn][^：:>]*[：:>]\\s*" + TAGS + "([\\dX-]+)",
}
BARE_FORMAT = "(?i)\\.(pdf|epub|mobi|azw3|djvu|txt)\\b"
BARE_SIZE = "(?i)(\\d+(?:\\.\\d+)?\\s*(?:MB|GB|KB|MiB|GiB))\\b"

# Labels of detail pages.
PAGE_PATTERNS = {
    "author": "Author[s]?[：:\\s>]*" + TAGS + "([^<>\\n]{2,})",
    "language": "(?:Language|语言)[：:\\s>]*" + TAGS + "([A-Za-z\\x{4e00}-\\x{9fff}]{2,})",
    "format": "(?:Format|格式|Extension|类型)[：:\\s>]*" + TAGS + "(\\w+)",
    "size": "(?:File\\s*size|Size|文件大小|大小)[：:\\s>]*" + TAGS + "([\\d. ]+\\s*(?:MB|GB|KB|MiB|GiB|B))",
    "year": "(?:Year|年份|Published)[：:\\s>]*" + TAGS + "(\\d{4})",
    "isbn": "[Ii][Ss][Bb][Nn][：:\\s>]*" + TAGS + "([\\dX-]{10,})",
    "publisher": "(?:Publisher|出版社|Published by)[：:\\s>]*" + TAGS + "([^<>\\n]{2,})",
}
JSONLD = '(?s)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>'
DETAIL_EXTENSIONS = ["pdf", "epub", "mobi", "djvu", "cbz", "cbr", "zip"]


def page_title(html) -> Column:
    return nonempty(strip_tags(F.regexp_extract(_col(html), "(?s)<title>(.*?)</title>", 1)))


def parse_jsonld(c) -> Column:
    """struct(name, author, publisher, isbn, year, language) of a JSON-LD object, empty values as NULL."""
    paths = {"name": "name", "author": "author", "publisher": "publisher", "isbn": "isbn", "published": "datePublished", "language": "inLanguage"}

    # Each path is read once; an expression used twice would be computed twice.
    def read(text: Column) -> Column:
        raw = F.struct(*[F.nullif(F.get_json_object(text, f"$.{path}"), F.lit("")).alias(n) for n, path in paths.items()])
        return let(raw, lambda x: built(text, x))

    def built(text: Column, x: Column) -> Column:
        author, publisher = x["author"], x["publisher"]
        names = F.from_json(F.when(author.startswith("[") | author.startswith("{"), author), "array<struct<name:string>>")
        joined = F.array_join(F.transform(names, lambda a: F.coalesce(a["name"], F.lit(""))), ", ")
        return F.struct(
            x["name"].alias("name"),
            F.nullif(joined, F.lit("")).alias("author"),
            F.when(publisher.startswith("{"), F.nullif(F.get_json_object(text, "$.publisher.name"), F.lit(""))).otherwise(publisher).alias("publisher"),
            x["isbn"].alias("isbn"),
            F.left(x["published"], F.lit(4)).alias("year"),
            x["language"].alias("language"),
        )

    return let(_col(c), read)


#: A tag; quoted values may hold any sign.
TAG = "<(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
#: What has no text of its own: comments, scripts and styles.
HIDDEN = "(?is)<!--.*?-->|<(script|style)(?![\\w-])[^>]*>.*?</\\1\\s*>"

# Character references with a name.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "middot": "·", "amp": "&"}


def unescaped(c) -> Column:
    """Text with its character references (numbers and the common names) resolved."""

    def resolved(text: Column) -> Column:
        text = F.array_join(F.transform(F.split(text, "&#"), lambda p, i: F.when(i == 0, p).otherwise(_numbered(p))), "")
        for name, sign in NAMED.items():
            text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
        return text

    return let(_col(c), lambda t: F.when(F.contains(t, F.lit("&")), resolved(t)).otherwise(t))


def _numbered(piece: Column) -> Column:
    """A piece behind ``&#``: the character, and the rest."""
    digits = F.regexp_extract(piece, "^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
    code = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.upper(F.substring(digits, 2, 6))).otherwise(F.hex(digits.try_cast("bigint")))
    good = (digits != "") & (F.conv(code, 16, 10).try_cast("bigint") < 0x110000)
    sign = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when(good, F.concat(sign, F.regexp_replace(piece, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), piece))


def inner_text(fragment, separator: str = "") -> Column:
    """Text of a fragment: its pieces between tags, trimmed, the empty ones left out."""
    pieces = F.transform(F.split(_col(fragment), TAG), lambda t: trim_u(unescaped(t)))
    return F.array_join(F.filter(pieces, lambda t: t != ""), separator)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, quoted either way or not at all; '' if it has none."""
    value = F.regexp_extract(tag, f"(?is)[\\s\"']{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", 1)
    return unescaped(F.btrim(value, F.lit("\"'")))


def has_classes(*classes: str):
    """Condition on an opening tag: its class set holds all of ``classes``, in any order."""
    return lambda tag: F.size(F.array_intersect(F.split(trim_u(attribute(tag, "class")), "\\s+"), F.array(*map(F.lit, classes)))) == len(classes)


def class_contains(*parts: str):
    """Condition on an opening tag: its class attribute contains each of ``parts``."""

    def holds(tag: Column) -> Column:
        return let(attribute(tag, "class"), lambda v: reduce(lambda a, b: a & b, (F.contains(v, F.lit(p)) for p in parts)))

    return holds


def elements(html, tag, wanted) -> Column:
    """Inner HTML of every ``tag`` element whose opening tag is ``wanted``, in order, nested ones too.

    The page is split in front of each opening or closing tag of that name.  An element ends where the depth
    of its name is back at where it began, or with the page if it is never closed, so each takes one pass over
    the tags of that name.  ``tag`` may be a column."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    parts = F.split(_col(html), F.concat(F.lit("(?i)(?=</?"), name, F.lit("(?![\\w-]))")))

    def found(parts: Column) -> Column:
        opening = F.transform(parts, lambda p: F.regexp_extract(p, f"^(?!</){TAG}", 0))
        return let(F.struct(parts.alias("parts"), opening.alias("tags")), steps)

    def steps(x: Column) -> Column:
        # Some of the first piece may stand in front of every tag of the name; it begins with none then.
        named = F.concat(F.lit("(?is)^</?"), name, F.lit("(?![\\w-])"))
        step = F.zip_with(
            x["tags"], x["parts"],
            lambda tag, part: F.when(~F.regexp_like(part, named), 0).when(tag == "", -1)
            .when(F.regexp_like(tag, F.lit("(?s)(?:^<[\\w-]+|[\\s\"'])/>$")), 0).otherwise(1),
        )
        return let(F.struct(x["parts"].alias("parts"), x["tags"].alias("tags"), step.alias("steps")), begun)

    def begun(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x["parts"]) - 1), lambda i: (F.get(x["steps"], i) == 1) & wanted(F.get(x["tags"], i)))
        inner = lambda begins: let(_running(x["steps"]), lambda depth: F.transform(begins, lambda i: fragment(x, depth, i)))
        return let(at, lambda begins: F.when(F.size(begins) > 0, inner(begins)).when(begins.isNotNull(), F.array().cast("array<string>")))

    def fragment(x: Column, depth: Column, i: Column) -> Column:
        # Steps are of one, so the depth first gets under that of the tag by being one less.
        n = F.array_position(F.slice(depth, i + 1, F.size(depth)), F.get(depth, i) - 1)
        whole = F.array_join(F.slice(x["parts"], i + 1, F.when(n > 0, n.cast("int") - 1).otherwise(F.size(depth))), "")
        return F.substr(whole, F.length(F.get(x["tags"], i)) + 1)

    return let(parts, found)


def _running(steps: Column) -> Column:
    """Running sums of an array of integers."""
    return F.aggregate(steps, F.array().cast("array<int>"), lambda a, s: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + s))


def first_element(html, tag, wanted) -> Column:
    return F.get(elements(html, tag, wanted), 0)


def list_lines(html, element_id: str) -> Column:
    """Texts of the list items inside one element joined by line feeds, else its non-empty lines.

    An item with a list inside has that list's text, and the inner items follow on their own."""
    own = lambda tag: attribute(tag, "id") == element_id
    begin = f"(?is)<([\\w-]+)(?=\\s)(?=[^>]*\\sid\\s*=\\s*[\"']?{element_id}[\"'\\s>])"

    # The page and the name of its element are computed once: every piece of the page asks for the name.
    def named(page: Column) -> Column:
        return let(F.regexp_extract(page, begin, 1), lambda name: F.when(name != "", first_element(page, name, own)))

    block = let(F.regexp_replace(_col(html), HIDDEN, ""), named)

    def lines(block: Column) -> Column:
        items = F.transform(elements(block, "li", lambda tag: F.lit(True)), lambda x: inner_text(x, " "))
        pieces = F.flatten(F.transform(F.split(block, TAG), lambda x: F.split(unescaped(x), "\n")))
        rest = F.filter(F.transform(pieces, trim_u), lambda t: t != "")
        return let(items, lambda i: F.when(F.size(i) > 0, F.array_join(i, "\n")).otherwise(F.array_join(rest, "\n")))

    text = let(block, lines)
    return let(text, lambda t: F.when(t != "", t))


def marc_fields(text) -> Column:
    """struct(author, publisher, year) from the text of a MARC record page."""
    return F.struct(
        nonempty(F.regexp_extract(_col(text), "(?U)200\\s+\\d+#\\$a[^$]*\\$f([^$]+)", 1)).alias("author"),
        nonempty(F.regexp_extract(_col(text), "(?U)210\\s+\\d+#\\$a[^$]*\\$c([^$]+)", 1)).alias("publisher"),
        first_match(text, "(?U)210\\s+\\d+#\\$[a-d]*\\$d(\\d{4})", 1).alias("year"),
    )


def marc_toc(html) -> Column:
    """Neighbour cell (longer than 20 characters) of the first cell labelled 330 or 327."""
    cell = '(?s)<td[^>]*class="td1"[^>]*>\\s*((?:330|327).*?)</td>\\s*<td[^>]*>(.*?)</td>'
    texts = F.transform(F.regexp_extract_all(_col(html), F.lit(cell), F.lit(2)), lambda t: trim_u(strip_tags(t)))
    return F.get(F.filter(texts, lambda t: F.length(t) > 20), 0)


def page_toc(html) -> Column:
    """Contents section of a book page: the first block labelled 目录 of over 10 characters, else the first
    element of over 50 whose id holds 'dir'."""
    def section(block: Column) -> Column:
        label = first_element(block, "span", has_classes("pl"))
        pieces = F.flatten(F.transform(F.split(block, TAG), lambda t: F.split(unescaped(t), "\n")))
        lines = F.filter(F.transform(pieces, trim_u), lambda t: (t != "") & ~F.contains(t, F.lit("目录")))
        return F.when(F.contains(label, F.lit("目录")), F.array_join(lines, "\n"))

    def first(page: Column) -> Column:
        labelled = F.transform(elements(page, "div", has_classes("indent")), section)
        hidden = F.transform(elements(page, "div", lambda tag: F.contains(attribute(tag, "id"), F.lit("dir"))), lambda x: inner_text(x))
        return F.coalesce(
            F.get(F.filter(labelled, lambda t: F.length(t) > 10), 0),
            F.get(F.filter(hidden, lambda t: F.length(t) > 50), 0),
        )

    return let(F.regexp_replace(_col(html), HIDDEN, ""), first)

"""Scalars for lines of a table of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, first_match, let, trim_u

# Numerals.
CN_DIGITS = {
    "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
    "十": 10, "百": 100, "千": 1000,
}
ROMAN = [
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv",
    "xvi", "xvii", "xviii", "xix", "xx", "xxi", "xxii", "xxiii", "xxiv", "xxv",
]

# Words and patterns that mark tables of contents.
CN_HEADERS = ["目录", "目 录", "目  录"]
EN_HEADERS = ["CONTENTS", "Contents", "Table of Contents"]
HEADER_LINES = ["目录", "目  录", "目 录", "Table of Contents", "Contents"]
CN_NUM = "[一二三四五六七八九十百千\\d]+"
CHAPTER_MARK = f"第{CN_NUM}[章节篇回卷]"
CHAPTER_START = f"^第{CN_NUM}[章节篇回卷部]"
CHAPTER_ONLY = f"^第{CN_NUM}[章节篇回卷]$"
NUMBER_ONLY = "(?U)^\\d+[.．]\\s*$"
SECTION_LINE = "(?mU)^\\d+(?:\\.\\d+)*\\s+\\S"
DOT_LEADER = "(?U)[.…·]{2,}\\s*\\S+"
TAB_NUMBER = "(?mU)\\t\\S+\\s*$"
DOTS_ONLY = "(?U)^[.…·•\\s~\\-—]{3,}$"
DOTS_AT_END = "(?U)[.…·]{2,}\\s*$"
#: A title, its leader or gap, and its page; marks of headings without a page; what stands in front of a title.
LEADER_LINE = "(?U)^[-*]?\\s*(.+?)\\s*[.…·]{2,}\\s*(\\S+)\\s*$"
GAP_LINE = "(?U)^(.*\\S)\\s+(\\d+)$"  # of a trimmed line
DIGITS_LINE = "(?U)^(.*\\S)\\s+([0-9]+)\\s*$"
TAB_LINE = "(?s)^(.*)\\t([^\\t]*)$"
LONG_LEADER = "(?U)\\s*[·.…]{3,}\\s*"
NUMBERED = "(?U)^\\d+(\\.\\d+)*\\s+"
ENUMERATED = "[一二三四五六七八九十]+、"
BULLETS = "^[·•\\- \\t]+"
SKIP_WORDS = ["---", "章节", "标题"]
TITLE_HEADERS = ["目录", "目  录", "目 录", "Table of Contents"]
BACK_MATTER = ["附录", "参考文献", "参考书目", "索引", "后记", "跋", "补遗", "术语表", "名词索引", "人名索引"]


def cn_numerals() -> dict[str, int]:
    """All readable Chinese numerals: one numeral, 十X, X十, X十Y (rule order decides overlaps)."""
    table = {a + "十" + b: va * 10 + vb for a, va in CN_DIGITS.items() for b, vb in CN_DIGITS.items()}
    table |= {a + "十": v * 10 for a, v in CN_DIGITS.items()}
    table |= {"十" + a: 10 + v for a, v in CN_DIGITS.items()}
    return table | CN_DIGITS


def roman_numerals() -> dict[str, int]:
    return {r: i for i, r in enumerate(ROMAN, start=1)}


def _lookup(table: dict[str, int]) -> Column:
    """Literal map; parsed as one text, since a Column per entry is slow to build."""
    return F.expr("map(" + ", ".join(f"'{k}', {n}L" for k, n in table.items()) + ")")


def _numeral(c: Column) -> Column:
    """Value of one Chinese numeral, NULL for any other character."""
    small = [w for w, n in CN_DIGITS.items() if n <= 10]  # in the order of their values
    place = F.instr(F.lit("".join(small)), c)
    return F.when(c == "百", 100).when(c == "千", 1000).when((F.length(c) == 1) & (place > 0), place - 1).cast("bigint")


def _cn_value(t: Column) -> Column:
    """Chinese numeral in the range of ``cn_numerals``: X, 十X, X十 or X十Y."""
    at = lambda i: F.substring(t, i, 1)
    return (
        F.when(F.length(t) == 1, _numeral(t))
        .when((F.length(t) == 2) & (at(1) == "十"), _numeral(at(2)) + 10)
        .when((F.length(t) == 2) & (at(2) == "十"), _numeral(at(1)) * 10)
        .when((F.length(t) == 3) & (at(2) == "十"), _numeral(at(1)) * 10 + _numeral(at(3)))
    )


def cn_to_int(c) -> Column:
    return let(trim_u(c), _cn_value)


def page_number(c) -> Column:
    """Digits, Roman i..xxv or a Chinese numeral as a number, else NULL."""
    return let(
        trim_u(c),
        lambda t: F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))
        .when(t.rlike("^[ivxIVX]{1,5}$"), F.try_element_at(_lookup(roman_numerals()), F.lower(t)))
        .otherwise(_cn_value(t)),
    )


def clean_title(c) -> Column:
    """Drop leading '#' marks and whatever follows '| Latin'."""

    def tidy(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, "(?U)^#+\\s*", ""), "(?sU)\\s*\\|\\s*[A-Za-z].*$", "")
        return F.when(F.startswith(t, F.lit("#")) | F.contains(t, F.lit("|")), bare).otherwise(t)

    return trim_u(let(_col(c), tidy))


def _unbullet(c) -> Column:
    return trim_u(F.ltrim(trim_u(c), F.lit("- ")))


def parse_toc_line(c) -> Column:
    """struct(title, page) of one line, NULL when it is no entry.

    Formats in order: tab, pipes, dot leaders, trailing number.
    """

    def entry(title: Column, page: Column, final=lambda t: t, positive: bool = False) -> Column:
        def checked(e: Column) -> Column:
            ok = (e["title"] != "") & e["page"].isNotNull()
            ok = ok & (e["page"] > 0) if positive else ok
            return F.when(ok, F.struct(final(e["title"]).alias("title"), e["page"].alias("page")))

        return let(F.struct(title.alias("title"), page.alias("page")), checked)

    def parsed(line: Column) -> Column:
        tab = F.when(
            F.contains(line, F.lit("\t")),
            entry(
                _unbullet(F.split_part(line, F.lit("\t"), F.lit(1))),
                page_number(F.regexp_replace(line, "(?s)^[^\\t]*\\t", "")),
                clean_title,
            ),
        )
        cells = F.filter(F.transform(F.split(line, "\\|"), trim_u), lambda p: p != "")
        pipe = F.when(
            F.contains(line, F.lit("|")),
            let(
                cells,
                lambda p: F.when(F.size(p) >= 2, entry(clean_title(F.get(p, 0)), page_number(F.try_element_at(p, F.lit(-1))))),
            ),
        )
        dots = F.when(
            line.rlike("[.…·]{2}"),
            entry(clean_title(F.regexp_extract(line, LEADER_LINE, 1)), page_number(F.regexp_extract(line, LEADER_LINE, 2))),
        )
        number = F.when(
            line.rlike("(?U)\\s\\d+$"),
            entry(
                clean_title(_unbullet(F.regexp_extract(line, GAP_LINE, 1))),
                F.regexp_extract(line, GAP_LINE, 2).try_cast("bigint"),
                positive=True,
            ),
        )
        return F.coalesce(tab, pipe, dots, number)

    def usable(line: Column) -> Column:
        plain = (F.length(line) >= 3) & ~line.isin(HEADER_LINES)
        for word in SKIP_WORDS:
            plain = plain & ~F.contains(line, F.lit(word))
        return plain

    found = let(trim_u(c), lambda line: F.when(usable(line), parsed(line)))
    return let(found, lambda e: F.when(e["title"] != "", e))


def heading_level(c) -> Column:
    """struct(level 1..4, is_container) from naming conventions."""
    t = trim_u(c)
    num = "[一二三四五六七八九十百千]+"
    level1 = (
        t.rlike(f"第{num}部分") | t.rlike(f"第{num}篇") | t.rlike("^[上下]篇\\b") | t.rlike("卷[一二三四五六七八九十]+")
    )
    level2 = t.rlike(f"第{num}章") | t.rlike("(?iU)^Chapter\\s+\\d+")
    level3 = t.rlike(f"第{num}节") | t.rlike("(?iU)^Section\\s+\\d+")
    level4 = (
        t.rlike("^[一二三四五六七八九十]+、") | t.rlike("^（[一二三四五六七八九十]+）")
        | t.rlike("(?U)^\\d+(\\.\\d+)*\\s") | t.rlike("^\\([0-9]+\\)")
    )
    back = t.rlike("^(" + "|".join(BACK_MATTER) + ")")
    # Containers as 101..103, so the patterns are tried once for both fields.
    code = F.when(level1, 101).when(level2, 102).when(level3, 103).when(level4, 4).when(back, 1).otherwise(2)
    return let(code, lambda n: F.struct((n % 100).alias("level"), (n > 100).alias("is_container")))


def toc_title_only(c) -> Column:
    """Title of one line of a page-less contents list, NULL for headers and fragments."""
    line = trim_u(c)
    title = trim_u(F.regexp_replace(line, "(?U)^[\\s.\\d\\-—·•●○■□▪▫]+", ""))
    return F.when((F.length(line) >= 3) & ~line.isin(TITLE_HEADERS) & (F.length(title) >= 3), title)


def is_solid(c) -> Column:
    """Whether two characters of ``solid_title`` are left."""
    thin = ".…·~•\\s\\-—_"
    return _col(c).rlike(f"(?U)[^{thin}][{thin}]*+[^{thin}]")


def solid_title(c) -> Column:
    """Title without leader and bullet characters, to tell titles from leader remains."""
    return F.regexp_replace(_col(c), "(?U)[.…·~•\\s\\-—_]", "")


def response_status(c) -> Column:
    """struct(status, next_from, next_to) of a model's answer."""
    t = trim_u(c)
    pattern = "(?U)TOC_CONTINUES:\\s*(\\d+)\\s*-\\s*(\\d+)"
    a, b = first_match(t, pattern, 1), first_match(t, pattern, 2)
    none = t.isNull() | (t == "") | F.contains(F.upper(t), F.lit("NO_TOC"))
    return F.struct(
        F.when(none, "NO_TOC").when(a.isNotNull(), "TOC_CONTINUES").otherwise("TOC_COMPLETE").alias("status"),
        F.when(~none, a).try_cast("bigint").alias("next_from"),
        F.when(~none, b).try_cast("bigint").alias("next_to"),
    )

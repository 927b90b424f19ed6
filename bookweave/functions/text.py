"""Text scalars: titles, ISBNs, sizes, file names.  Every function maps Columns to a Column."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators between a title and its subtitle, in order of precedence.
SUBTITLE_SEPARATORS = ["：", ":", "\u3000", "——", "---", "－", "—", "‧", "•"]

# Code-point ranges counted as CJK characters.
CJK = "\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff"

# Placeholders of a file-name template and the field each one reads.
TEMPLATE_FIELDS = {
    "title": "title",
    "author": "authors",
    "authors": "authors",
    "publisher": "publisher",
    "isbn": "isbn",
    "ss_code": "ss_code",
    "source": "download_source",
    "download_source": "download_source",
    "year": "year",
    "book_id": "book_id",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


#: Every character that ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_u(c) -> Column:
    """Trim every kind of Unicode white space; SQL trim() only knows the blank."""
    return F.btrim(_col(c), F.lit(WHITE))


def nonempty(c) -> Column:
    """Trimmed text, or NULL when nothing is left, so coalesce() means "first non-empty"."""
    t = trim_u(c)
    return F.when(t != "", t)


def is_blank(c) -> Column:
    """True for NULL, empty and white-space-only text."""
    c = _col(c)
    return c.isNull() | ~c.rlike("(?U)\\S")


def first_match(c, pattern: str, group: int = 1) -> Column:
    """regexp_extract with NULL instead of '' when there is no (or an empty) match."""
    m = F.regexp_extract(_col(c), pattern, group)
    return F.when(m != "", m)


def like_literal(text: str) -> str:
    """Escape the LIKE wildcards of a search text."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


# ---------------------------------------------------------------- titles


def main_title(c) -> Column:
    """Part before the first usable subtitle separator, else the title without bracketed parts."""
    c = _col(c)

    def cut(sep: Column) -> Column:
        at = F.instr(c, sep)
        inside = (at > 1) & (at < F.length(c))
        return F.when(inside, let(trim_u(F.substring(c, F.lit(1), at - 1)), lambda h: F.when(F.length(h) >= 2, h)))

    separators = F.expr("array(" + ", ".join(f"'{s}'" for s in SUBTITLE_SEPARATORS) + ")")
    first = F.get(F.filter(F.transform(separators, cut), lambda h: h.isNotNull()), 0)
    return F.coalesce(first, trim_u(F.regexp_replace(c, "[（(][^）)]*[）)]", "")))


def char_set(c) -> Column:
    return F.array_distinct(F.split(_col(c), ""))


def char_overlap(a, b) -> Column:
    """Number of distinct characters two texts share."""
    return F.size(F.array_intersect(char_set(a), char_set(b)))


def title_similarity(a, b) -> Column:
    """0..1: containment scores by length difference, otherwise shared distinct characters."""
    la, lb = F.lower(_col(a)), F.lower(_col(b))
    longest = F.greatest(F.length(_col(a)), F.length(_col(b)), F.lit(1))
    contained = F.lit(0.9) - F.lit(0.2) * (F.abs(F.length(_col(a)) - F.length(_col(b))) / longest)
    sets = F.struct(char_set(la).alias("a"), char_set(lb).alias("b"))
    overlap = let(
        sets,
        lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.size(s["a"]), F.size(s["b"]), F.lit(1)),
    )
    empty = F.coalesce(la == "", F.lit(True)) | F.coalesce(lb == "", F.lit(True))
    return F.when(empty, F.lit(0.0)).when(F.contains(la, lb) | F.contains(lb, la), contained).otherwise(overlap)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c) -> Column:
    """NFKC form.  Spark has no builtin; only non-ASCII values carry data to the Arrow function."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(c.rlike("[^\\x00-\\x7f]"), c)), c)


def _relevance_words(c: Column) -> Column:
    words = F.split(c, "(?U)[\\s,，、。．：；！？\\-\\u4e00-\\u9fff]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _relevance_cjk(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda ch: ch.between("\u4e00", "\u9fff")))


def title_relevance(a, b, normalize: bool = True) -> Column:
    """0..100: 100 on containment, else the better of CJK-character and word overlap.

    ``normalize=False`` skips NFKC for inputs known to be in that form already.
    """
    form = nfkc if normalize else (lambda c: c)
    ta, tb = trim_u(form(F.lower(_col(a)))), trim_u(form(F.lower(_col(b))))

    def score(x: Column, y: Column) -> Column:
        both = F.struct(x.alias("x"), y.alias("y"))
        widest = lambda s: F.greatest(F.size(s["x"]), F.size(s["y"]), F.lit(1))
        return let(both, lambda s: F.floor(F.size(F.array_intersect(s["x"], s["y"])) / widest(s) * 100).cast("int"))

    def graded(t: Column) -> Column:
        p, q = t["a"], t["b"]
        return (
            F.when(F.coalesce(p == "", F.lit(True)) | F.coalesce(q == "", F.lit(True)), F.lit(0))
            .when(F.contains(p, q) | F.contains(q, p), F.lit(100))
            .otherwise(
                F.greatest(
                    score(_relevance_cjk(p), _relevance_cjk(q)), score(_relevance_words(p), _relevance_words(q))
                )
            )
        )

    return let(F.struct(ta.alias("a"), tb.alias("b")), graded)


def clean_query_title(c) -> Column:
    """Title as sent to a search: no bracketed parts, nothing from an equals sign on."""
    c = trim_u(F.regexp_replace(_col(c), "[（(][^)）]*[)）]", ""))
    return trim_u(F.regexp_replace(c, "[=＝].*$", ""))


def title_key(c) -> Column:
    """Comparison key of a title: lower case without white space."""
    return F.lower(F.regexp_replace(_col(c), "(?U)\\s+", ""))


# ---------------------------------------------------------------- identifiers


def isbn_norm(c) -> Column:
    return F.regexp_replace(_col(c), "[- ]", "")


def isbn13_tail(c) -> Column:
    """Last ten characters of a 13-character ISBN, otherwise the value itself."""
    c = _col(c)
    return F.when(F.length(c) == 13, F.substring(c, 4, 10)).otherwise(c)


# ISBN patterns in order, with the group that holds the number.
ISBN_PATTERNS = [
    ("(?i)ISBN[:\\s]*([\\d\\-]{10,17})", 1),
    ("978[\\d\\-]{10,14}", 0),
    ("979[\\d\\-]{10,14}", 0),
    ("[\\d]{13}", 0),
]


def isbn_extract(c) -> Column:
    """First pattern whose match has 10 or 13 digits."""
    found = []
    for pattern, group in ISBN_PATTERNS:
        digits = F.regexp_replace(F.regexp_extract(_col(c), pattern, group), "[^0-9]", "")
        found.append(F.when(F.length(digits).isin(10, 13), digits))
    return F.coalesce(*found)


# ---------------------------------------------------------------- sizes, markup, CJK


def parse_size(c) -> Column:
    """'15.2 MB' to bytes; 0 when there is no number with a unit at the start."""
    label = F.replace(F.upper(trim_u(c)), F.lit(","), F.lit("."))
    pattern = "^([0-9.]+)(?U:\\s*)(GB|MB|KB|B)"
    number = F.regexp_extract(label, pattern, 1).try_cast("double")
    unit = F.regexp_extract(label, pattern, 2)
    factor = (
        F.when(unit == "GB", 1024.0 * 1024 * 1024).when(unit == "MB", 1024.0 * 1024).when(unit == "KB", 1024.0)
        .when(unit == "B", 1.0)
    )
    return F.coalesce(F.floor(number * factor), F.lit(0)).cast("bigint")


def size_match(actual, expected, tolerance: float = 0.05) -> Column:
    """struct(ok, level) for a file size against the announced one."""
    actual, expected = _col(actual), _col(expected)
    off = F.abs(actual - expected) / F.when(expected > 0, expected)
    level = (
        F.when(expected.isNull() | (expected <= 0), "size_unknown")
        .when(actual < 50000, "too_small")
        .when(off <= 0.01, "exact")
        .when(off <= tolerance, "approximate")
        .otherwise("mismatch")
    )
    return F.struct(level.isin("size_unknown", "exact", "approximate").alias("ok"), level.alias("level"))


def strip_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def cjk_count(c) -> Column:
    return F.length(c) - F.length(F.regexp_replace(_col(c), f"[{CJK}]+", ""))


def nonspace_count(c) -> Column:
    return F.length(F.regexp_replace(_col(c), "(?U)\\s+", ""))


def cjk_ratio(c) -> Column:
    """CJK characters per non-space character; 0 for text without any."""
    c = _col(c)
    solid = nonspace_count(c)
    return F.when(solid > 0, cjk_count(c) / solid).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- file names


def _cut(c: Column, n: int | None) -> Column:
    """At most ``n`` characters; a longer text ends in a hash of all of it, so different ones stay so."""
    if n is None:
        return c
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(max(n - 9, 0))), F.lit("~"), F.left(F.md5(c), F.lit(8)))).otherwise(c)


def sanitize(c, n: int | None = None, normalize: bool = True) -> Column:
    """Path-safe text, of at most ``n`` characters where a limit is given."""
    c = nfkc(c) if normalize else _col(c)
    c = F.regexp_replace(c, '[<>:"/\\\\|?*]', "_")
    c = trim_u(F.regexp_replace(c, "(?U)\\s+", " "))
    return _cut(c, n)


# Signs that a name does not begin with (nor end with in front of its extension), and those
# that a name without an extension does not end with.
NAME_EDGE, NAME_END = "_\\s\\-", "_\\s\\-,.()|;:"


def _shed(c: Column, before: str, after: str) -> Column:
    return F.regexp_replace(c, f"(?U)^[{before}]+|[{after}]+$", "")


def apply_template(template: str, fields: dict[str, Column], normalize: bool = True) -> Column:
    """File name from a ``{field}`` template; NULL when the template has no field or nothing is left.

    ``fields`` maps metadata names to Columns; ``authors`` may be an array (its first element counts).  The
    template is taken apart once: its literal pieces and the values between them are joined, and what empty
    values leave at the ends of the stem is shed.  Braces around other words are literal.
    """
    if "{" not in (template or ""):
        return F.lit(None).cast("string")
    known = "|".join(map(re.escape, TEMPLATE_FIELDS))
    literal, *rest = re.split(f"\\{{({known})\\}}", template)
    pieces = [F.lit(literal)]
    for field, literal in zip(rest[::2], rest[1::2], strict=True):
        value = fields.get(TEMPLATE_FIELDS[field], F.lit(""))
        pieces += [F.coalesce(sanitize(value, normalize=normalize), F.lit("")), F.lit(literal)]

    def named(joined: Column) -> Column:
        whole = joined.endswith(".pdf")
        stem = F.when(whole, _shed(F.left(joined, F.length(joined) - 4), NAME_EDGE, NAME_EDGE)).otherwise(_shed(joined, NAME_EDGE, NAME_END))
        return let(stem, lambda s: F.when(s != "", F.when(~whole & F.lower(s).endswith(".pdf"), s).otherwise(F.concat(s, F.lit(".pdf")))))

    return let(F.regexp_replace(F.concat(*pieces), "_+", "_"), named)


def final_name(ss_code, title, ocr_done, compressed, ext=".pdf", n: int | None = None) -> Column:
    """``[code_]title[_ocr|_ocr_bw].pdf`` as stored in the finished folder."""
    safe = _cut(trim_u(F.regexp_replace(F.coalesce(_col(title), F.lit("book")), '[<>:"/\\\\|?*]', "_")), n)
    suffix = F.when(_col(ocr_done) & _col(compressed), "_ocr_bw").when(_col(ocr_done), "_ocr").otherwise("")
    code = F.when(~is_blank(ss_code), F.concat(_col(ss_code), F.lit("_"))).otherwise("")
    return F.concat(code, safe, suffix, F.lit(ext))

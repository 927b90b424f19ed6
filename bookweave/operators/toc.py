"""Finding, parsing, validating, levelling and merging tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import toclines as L
from ..functions.text import WHITE, cjk_ratio, is_blank, let, nonempty, title_key, trim_u
from . import ordered
from .merging import merge_tocs  # noqa: F401
from .ordered import Scan, fill, fill_next, following, least_of, ordered_scan, previous, top_per_group, total
from .resolve import asked_only

# ---------------------------------------------------------------- pages


def page_signals(pages: DataFrame, *extra: str) -> DataFrame:
    """Per page: chapter marks, section lines, page references, CJK ratio and header word."""
    t = F.col("text")
    cn = F.contains(t, F.lit(L.CN_HEADERS[0]))
    for w in L.CN_HEADERS[1:]:
        cn = cn | F.contains(t, F.lit(w))
    en = F.contains(t, F.lit(L.EN_HEADERS[0]))
    for w in L.EN_HEADERS[1:]:
        en = en | F.contains(t, F.lit(w))
    return pages.withColumn("cjk_ratio", cjk_ratio(t)).select(
        "doc_id",
        "page_no",
        F.regexp_count(t, F.lit(L.CHAPTER_MARK)).cast("bigint").alias("chapter_hits"),
        F.regexp_count(t, F.lit(L.SECTION_LINE)).cast("bigint").alias("section_hits"),
        (F.regexp_count(t, F.lit(L.DOT_LEADER)) + F.regexp_count(t, F.lit(L.TAB_NUMBER))).cast("bigint").alias("page_refs"),
        "cjk_ratio",
        (en | (cn & (F.col("cjk_ratio") >= 0.3))).alias("has_header"),
        *extra,
    )


def _scanned(pages: DataFrame, *text: str) -> DataFrame:
    """Pages with their document's ``_start`` and ``total_pages``, and whether they lie in its range.

    A range begins at the first header page, else the first dense one, and ends before the first page behind
    it that isn't like a contents page; so a page from the start on is inside if the last such page up to it
    is not behind the start.  The patterns run once, one blocked scan does the rest, and text goes along for
    pages that a range can hold.  Pages of a document are numbered without gaps.
    """
    hits, page = F.col("chapter_hits") + F.col("section_hits"), F.col("page_no")
    signals = page_signals(pages, *text).withColumns(
        {"dense": (hits >= 3) & (F.col("page_refs") >= 2), "like_toc": (hits >= 2) | (F.col("page_refs") >= 1)}
    )
    may_be = F.col("has_header") | F.col("dense") | F.col("like_toc")
    rows = signals.select("doc_id", "page_no", "has_header", "dense", "like_toc", *[F.when(may_be, F.col(c)).alias(c) for c in text])
    # All that the scan returns is used, so that its input is made once.
    out = ordered_scan(
        rows, ["doc_id"], ["page_no"],
        {
            "_header": least_of(F.when(F.col("has_header"), page)), "_dense": least_of(F.when(F.col("dense"), page)),
            "total_pages": total(F.lit(1)), "_stop": fill(F.when(~F.col("like_toc"), page)),
        },
        columns=["doc_id", "page_no", *text],
    ).withColumn("_start", F.coalesce("_header", "_dense"))
    inside = (page >= F.col("_start")) & (F.col("_stop").isNull() | (F.col("_stop") <= F.col("_start")))
    return out.withColumn("_inside", F.coalesce(inside, F.lit(False)))


def _ranges(scanned: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, total_pages, toc_start, toc_end) and what else is gathered of each document."""
    found = F.col("_start").isNotNull()
    return scanned.groupBy("doc_id").agg(
        F.any_value("total_pages").cast("bigint").alias("total_pages"),
        F.coalesce(F.any_value("_start"), F.lit(-1)).cast("bigint").alias("toc_start"),
        F.coalesce(F.max(F.when(found & F.col("_inside"), F.col("page_no"))), F.lit(-1)).cast("bigint").alias("toc_end"),
        *more,
    )


def toc_range(pages: DataFrame) -> DataFrame:
    """(toc_start, toc_end) per document, (-1, -1) when none is found."""
    return _ranges(_scanned(pages)).select("doc_id", "toc_start", "toc_end")


# ---------------------------------------------------------------- wrapped lines


def merge_wrapped(c) -> Column:
    """Text with the lines OCR broke apart joined again.

    First pass: title, dot line and number; title ending in dots and number; stray dot lines go to the
    line before.  Second pass: a bare chapter or section number takes the next line.  A global
    regexp_replace consumes lines greedily from left to right, which is exactly the rule.
    """
    dots = "[.…·•\\s~\\-—&&[^\\n]]{3,}"
    t = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(t, "(?dmU)^[\\s&&[^\\n]]+|[\\s&&[^\\n]]+$", "")
    t = trim_u(t)
    joined = (
        f"(?dmU)^(?!{dots}$)([^\\n]+)\\n(?:({dots})\\n(\\d+)$)"
        f"|(?dmU)^(?!{dots}$)([^\\n]*[.…·]{{2,}})\\n(\\d+)$"
    )
    t = F.regexp_replace(t, joined, "$1$2$3$4$5")
    t = F.regexp_replace(t, "\\n{2,}", "\n")
    t = F.regexp_replace(t, f"(?dU)\\A(?:{dots}(?:\\n|\\z))+", "")
    t = F.regexp_replace(t, f"(?dmU)\\n({dots})$", "$1")
    return F.regexp_replace(t, f"(?dmU)^({L.CHAPTER_ONLY[1:-1]}|\\d+[.．])\\n([^\\n]*)$", "$1 $2")


def merge_wrapped_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, merge_wrapped(text))


# ---------------------------------------------------------------- page backfill


def fill_page_forward(lines: DataFrame, page: str = "page_text") -> DataFrame:
    """Text page per line: its own, else the last numeric page above it, else 1.

    A Roman page stays as text and is not carried on.
    """
    own = nonempty(page)
    carried = F.when(own.rlike("^[0-9]+$"), own)
    out = ordered_scan(lines, ["doc_id"], ["seq"], {"_carry": fill(carried)})
    return out.withColumn("page", F.coalesce(own, F.col("_carry"), F.lit("1"))).drop("_carry")


def backfill_chapter(rows: DataFrame) -> DataFrame:
    """Chapter rows without page take the page of the next row unless that is a chapter too.

    Rows (doc_id, seq, title, page, is_chapter); what still has no page is dropped.
    """
    nxt = F.struct(F.col("page").alias("page"), F.col("is_chapter").alias("is_chapter"))
    return _borrow_page(ordered_scan(rows, ["doc_id"], ["seq"], {"_next": following(nxt)}))


def _borrow_page(rows: DataFrame) -> DataFrame:
    borrowed = F.when(F.col("is_chapter") & ~F.col("_next.is_chapter"), F.col("_next.page"))
    return rows.withColumn("page", F.coalesce("page", borrowed)).drop("_next").filter(F.col("page").isNotNull())


def backfill_pending(rows: DataFrame) -> DataFrame:
    """Titles without page take the next page below; trailing ones are dropped."""
    out = ordered_scan(rows, ["doc_id"], ["seq"], {"_next": fill_next(F.col("page"))})
    return out.withColumn("page", F.col("_next")).drop("_next").filter(F.col("page").isNotNull())


def carry_chapter(rows: DataFrame) -> DataFrame:
    """Prefix sub-titles by the last chapter cell above.  Rows carry ``chapter`` (NULL for sub-titles)."""
    out = ordered_scan(rows, ["doc_id"], ["seq"], {"_chapter": fill(F.col("chapter"))})
    sub = F.col("chapter").isNull() & F.col("_chapter").isNotNull()
    return out.withColumn(
        "title", F.when(sub, F.concat_ws(" ", "_chapter", "title")).otherwise(F.col("title"))
    ).drop("_chapter")


# ---------------------------------------------------------------- levels


def assign_levels(rows: DataFrame) -> DataFrame:
    """Level of every entry (doc_id, seq, title, page, explicit).

    An explicit level n becomes min(n+1, 4), -1 stays.  Otherwise the level follows from the open
    headings above.  Only four heading levels exist, so "is a heading of level v still open here" needs
    two running positions per level: the last heading of level v, and the last row that closed it.
    """
    h = L.heading_level("title")
    staged = rows.withColumn("_h", F.when(F.col("explicit").isNull(), h)).select("*", F.col("_h.is_container").alias("_container"))
    level, container, seq = F.col("_h.level"), F.col("_container"), F.col("seq")
    scans: dict[str, Scan] = {}
    for v in range(1, 5):
        scans[f"_open{v}"] = fill(F.when(container & (level == v), seq))
        scans[f"_shut{v}"] = fill(F.when((container & (level <= v)) | (~container & (level < v)), seq))
    # Of a heading only what is used behind the scan goes through it, so that its input is made once.
    out = ordered_scan(staged, ["doc_id"], ["seq"], scans, columns=[*rows.columns, "_container"])
    depth = F.lit(0)
    for v in range(1, 5):
        still = F.col(f"_open{v}") >= F.coalesce(f"_shut{v}", F.lit(-1))
        depth = depth + F.when(still, 1).otherwise(0)
    inferred = F.least(F.when(container, depth).otherwise(depth + 1), F.lit(4))
    given = F.when(F.col("explicit") == -1, -1).when(
        F.col("explicit").isNotNull(), F.least(F.col("explicit") + 1, F.lit(4))
    )
    return out.withColumn("level", F.coalesce(given, inferred).cast("bigint")).drop("_container", *scans)


# ---------------------------------------------------------------- validation


def validate_toc(entries: DataFrame, docs: DataFrame, min_entries: int = 3, max_drops: float = 0.3) -> DataFrame:
    """(doc_id, ok, reason) per document of ``docs`` (doc_id, total_pages)."""
    e = ordered_scan(entries.select("doc_id", "seq", "page"), ["doc_id"], ["seq"], {"_before": previous(F.col("page"))})
    # The page limit is applied on counts per (document, page), so a long contents list never
    # multiplies the join.
    per_page = e.groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("_before") - F.col("page") > 10, 1)).alias("drops")
    )
    total_pages = F.coalesce("total_pages", F.lit(0))
    outside = (total_pages > 0) & ((F.col("page") > total_pages * 3) | (F.col("page") <= 0))
    per_doc = (
        per_page.join(docs.select("doc_id", "total_pages"), "doc_id", "left")
        .groupBy("doc_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outside"),
            F.sum("drops").alias("drops"),
        )
    )
    n = F.coalesce("n", F.lit(0))
    reason = (
        F.when(n < min_entries, "too_few")
        .when(F.col("outside") > n * 0.5, "out_of_range")
        .when((n >= 3) & (F.col("drops") / (n - 1) > max_drops), "not_rising")
        .otherwise("ok")
    )
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", (reason == "ok").alias("ok"), reason.alias("reason")
    )


def _bare(c) -> Column:
    return F.translate(c, f"{WHITE}.-—·…", "")


#: Characters of a slice of a text; openings of a document, and characters of a text, up to which each opening is
#: looked for in the text.
SLICE, FEW, LONG = 4096, 2048, 1 << 20


def _openings(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked (doc_id, _open) that occur in their document's text.

    A text of ordinary length is searched for each opening that its document asks for, if those are few; that is
    bounded by LONG times FEW.  All others are told by their pieces.
    """
    counts = asked.groupBy("doc_id").agg(F.count("*").alias("_n"))
    lists = asked.join(counts.filter(F.col("_n") <= FEW), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("_open").alias("_asked"))
    # Texts are joined once, with their list or none.
    both = texts.join(counts.join(lists, "doc_id", "left"), "doc_id")
    apart = (F.length("text") > LONG) | (F.col("_n") > FEW)
    present = let(_bare("text"), lambda b: F.filter("_asked", lambda o: F.contains(b, o)))  # made bare once a text
    # The outer form, as Spark would make the texts bare again to tell which of the arrays are empty.
    near = both.select("doc_id", F.explode_outer(F.when(~apart, present)).alias("_open"))
    far = both.filter(apart).select("doc_id", "text")
    return near.filter(F.col("_open").isNotNull()).unionByName(_pieces(far, asked)).distinct()


def _pieces(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``_openings`` by pieces of four characters.

    Texts are cut into slices, which are dealt over the cluster; a slice takes the end of the one before
    along.  Of a slice's pieces of four characters only those that some entry may ask for go further.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = F.regexp_extract_all(_bare("text"), F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))
    led = lambda s, i: F.concat(F.coalesce(F.right(F.get(s, i - 1), F.lit(3)), F.lit("")), F.get(s, i))
    whole = let(cut, lambda s: F.transform(s, lambda _, i: led(s, i)))
    slices = texts.select("doc_id", F.posexplode(whole).alias("_k", "_slice")).repartition(parts, "doc_id", "_k")
    every = F.array_distinct(F.regexp_extract_all("_slice", F.lit("(?s)(?=(.{4}))"), F.lit(1)))
    pieces = asked_only(slices.select("doc_id", F.explode(every).alias("_open")), asked, ["doc_id", "_open"])
    return pieces.join(asked, ["doc_id", "_open"], "left_semi").distinct()


def cross_validate(entries: DataFrame, texts: DataFrame, min_ratio: float = 0.3) -> DataFrame:
    """Entries whose first four characters occur in the document's text; short titles pass.

    If too few of at least three entries match, the text is taken to be unusable and all stay.  All is decided for the
    openings of a document and their numbers of entries; entries move once, to those that stay.  Joins of what is read
    more than once are by structs, and texts pass a list of one row or none, as Spark would put the filters of a join by
    columns, or of blank texts, below one of the readers of an exchange and make it again for the others.
    """
    bare = _bare("title")
    e = entries.withColumn("_open", let(bare, lambda t: F.when(F.length(t) >= 4, F.left(t, F.lit(4)))))
    full = texts.select(F.inline_outer(F.when(~is_blank("text"), F.array(F.struct("doc_id", "text"))))).filter("text IS NOT NULL")
    counts = e.groupBy("doc_id", "_open").agg(F.count("*").alias("_c"))
    asked = counts.select(F.inline_outer(F.when(F.col("_open").isNotNull(), F.array(F.struct("doc_id", "_open"))))).filter("_open IS NOT NULL")
    found = _openings(full, asked).select(F.col("doc_id").alias("_d"), F.col("_open").alias("_o"))
    same = counts.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("_open") == F.col("_o")), "left")
    same = same.select(F.struct("doc_id").alias("_doc"), "_open", "_c", F.col("_o").isNotNull().alias("_m"))
    sums = same.groupBy("_doc").agg(F.sum("_c").alias("_n"), F.sum(F.when(F.col("_m"), F.col("_c")).otherwise(0)).alias("_matched"))
    read = full.select(F.col("doc_id").alias("_r")).distinct()
    sums = sums.join(read, F.col("_doc.doc_id") == F.col("_r"), "left")
    unusable = F.col("_r").isNull() | ((F.col("_n") >= 3) & (F.col("_matched") / F.col("_n") < min_ratio))
    kept = same.join(sums.select("_doc", unusable.alias("_all")), "_doc").filter(F.col("_all") | F.col("_open").isNull() | F.col("_m"))
    stays = kept.select(F.struct("_doc.doc_id", "_open").alias("_key"))
    return e.withColumn("_key", F.struct("doc_id", "_open")).join(stays, "_key", "left_semi").select(*entries.columns)


def dedupe_titles(rows: DataFrame) -> DataFrame:
    """First entry per document and title, compared in lower case without white space."""
    return top_per_group(rows.withColumn("_key", title_key("title")), ["doc_id", "_key"], [F.col("seq")]).drop("_key")


# ---------------------------------------------------------------- page offsets


def page_offset(docs: DataFrame, labels: DataFrame, entries: DataFrame, anchor: str = "000001.jpg") -> DataFrame:
    """Offset between printed and physical pages: position of the anchor label + 1 - first entry page."""
    at = labels.filter(F.col("label") == anchor).groupBy("doc_id").agg(F.min("page_no").alias("_at"))
    first = entries.filter(F.col("page").isNotNull()).groupBy("doc_id").agg(F.min_by("page", "seq").alias("_first"))
    return (
        docs.select("doc_id").join(at, "doc_id", "left").join(first, "doc_id", "left")
        .select("doc_id", F.coalesce(F.col("_at") + 1 - F.col("_first"), F.lit(0)).cast("bigint").alias("offset"))
    )


def apply_offset(entries: DataFrame, docs: DataFrame, labels: DataFrame, supplied: int = 0, toc_label: str = "!00001.jpg") -> DataFrame:
    """Entries on physical pages, clamped to the document; offsets <= 0 are detected from the labels.

    Level -1 marks absolute pages.  A contents page labelled so gets an entry
    of its own in front (seq -1).
    """
    offsets = page_offset(docs, labels, entries) if supplied <= 0 else docs.select("doc_id", F.lit(supplied).cast("bigint").alias("offset"))
    facts = docs.select("doc_id", "total_pages").join(offsets, "doc_id")
    moved = entries.join(facts, "doc_id")
    page = F.when(F.col("level") == -1, F.col("page")).otherwise(F.col("page") + F.col("offset"))
    body = moved.select(
        "doc_id", "seq", F.when(F.col("level") == -1, F.lit(1)).otherwise(F.col("level")).cast("bigint").alias("level"), "title",
        F.greatest(F.lit(1), F.least(page, F.col("total_pages"))).cast("bigint").alias("page"),
    )
    own = labels.filter(F.col("label") == toc_label).groupBy("doc_id").agg(F.min("page_no").alias("_at"))
    with_entries = entries.select("doc_id").distinct()
    front = own.join(with_entries, "doc_id", "left_semi").select(
        "doc_id", F.lit(-1).cast("bigint").alias("seq"), F.lit(1).cast("bigint").alias("level"), F.lit("目 录").alias("title"),
        (F.col("_at") + 1).cast("bigint").alias("page"),
    )
    return body.unionByName(front)


# ---------------------------------------------------------------- texts to entries


def parse_bookmark_text(df: DataFrame, text: str = "text", roman: bool = False) -> DataFrame:
    """(doc_id, seq, title, page, explicit) of ``title<TAB>page[<TAB>level]`` lines; others are skipped."""
    lines = df.select("doc_id", F.posexplode(F.split(trim_u(text), "\n")).alias("seq", "line"))
    parts = F.split(trim_u("line"), "\t")
    page_text = trim_u(F.get(parts, 1))
    page = L.page_number(page_text) if roman else page_text.try_cast("bigint")
    return lines.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), trim_u(F.get(parts, 0)).alias("title"),
        page.alias("page"), trim_u(F.get(parts, 2)).try_cast("bigint").alias("explicit"),
    ).filter(F.col("page").isNotNull())


def toc_titles_only(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, seq, title) of a contents list without pages."""
    lines = df.select("doc_id", F.posexplode(F.split(trim_u(text), "\n")).alias("seq", "line"))
    return lines.select("doc_id", F.col("seq").cast("bigint").alias("seq"), L.toc_title_only("line").alias("title")).filter(
        F.col("title").isNotNull()
    )


def _rows_of(found: Column) -> Column:
    """One row for a struct, none for NULL; unlike a filter this keeps Spark from computing it twice."""
    return F.inline(F.filter(F.array(found), lambda e: e.isNotNull()))


def parse_toc_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are entries, with ``title`` and ``page``; the line goes, everything else stays."""
    return lines.select(*[c for c in lines.columns if c != line], _rows_of(L.parse_toc_line(line)))


def raw_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, title, page, is_chapter) of lines, chapters without page included."""
    heading = f"(?U)^(第{L.CN_NUM}[章节篇回卷]\\s*.+)"

    def entry(x: Column) -> Column:
        title = F.when(
            x["e"].isNotNull(), F.when(L.is_solid(x["e"]["title"]), x["e"]["title"])
        ).when(x["chapter"], nonempty(F.regexp_extract(x["line"], heading, 1)))
        found = F.struct(title.alias("title"), x["e"]["page"].alias("page"), x["chapter"].alias("is_chapter"))
        return let(found, lambda f: F.when(f["title"].isNotNull(), f))

    def read(line: Column) -> Column:
        facts = F.struct(
            line.alias("line"), L.parse_toc_line(line).alias("e"),
            F.coalesce(line.rlike(L.CHAPTER_START), F.lit(False)).alias("chapter"),
        )
        return F.when((line != "") & (line != "目录"), let(facts, entry))

    return lines.select("doc_id", "seq", _rows_of(let(trim_u("line"), read)))


def toc_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, seq, title, page) of one contents text per document."""
    whole = df.filter(F.length(trim_u(text)) >= 5)
    lines = whole.select("doc_id", F.posexplode(F.split(merge_wrapped(text), "\n")).alias("seq", "line")).withColumn(
        "seq", F.col("seq").cast("bigint")
    )
    # The lines of one document came out of one text cell, so a plain window is bounded by that cell.
    nxt = F.lead(F.struct("page", "is_chapter")).over(W.partitionBy("doc_id").orderBy("seq"))
    return _borrow_page(raw_entries(lines).withColumn("_next", nxt)).select("doc_id", "seq", "title", "page")


def write_bookmarks(entries: DataFrame, levels: bool = False) -> DataFrame:
    """(doc_id, bookmark): the entries of a document as one text, the result cell being the document."""
    fields = ["title", F.col("page").cast("string"), *([F.col("level").cast("string")] if levels else [])]
    lines = F.sort_array(F.collect_list(F.struct("seq", F.concat_ws("\t", *fields).alias("line"))))
    return entries.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("bookmark"))


def toc_from_pages(pages: DataFrame) -> DataFrame:
    """Pages to bookmark text: (doc_id, bookmark, toc_start, toc_end).

    The bookmark is empty when the entries fail validation; the range survives that.
    """
    inside = F.when(F.col("_inside"), F.struct("page_no", "text"))
    texts = _ranges(_scanned(pages, "text"), F.sort_array(F.collect_list(inside)).alias("_pages")).select(
        "doc_id", "total_pages", "toc_start", "toc_end", F.array_join(F.transform("_pages", lambda p: p["text"]), "\n").alias("text")
    )
    # Contents are few bytes but much work: dealt anew so that they aren't merged into few tasks.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = toc_from_text(texts.filter(F.col("toc_start") >= 0).select("doc_id", "text").repartition(parts, "doc_id"))
    lists = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "title", "page"))).alias("e"))
    n, pages_of = F.size("e"), F.transform("e", lambda x: x["page"])
    ceiling = F.col("total_pages") * 3
    outside = F.size(F.filter(pages_of, lambda p: (p > ceiling) | (p <= 0)))
    steps = F.zip_with(F.slice(pages_of, F.lit(1), n - 1), F.slice(pages_of, F.lit(2), n - 1), lambda a, b: a - b)
    drops = F.size(F.filter(steps, lambda d: d > 10))
    ok = F.when(n < 3, False).otherwise((outside <= n * 0.5) & (drops / (n - 1) <= 0.3))
    lines = F.transform("e", lambda x: F.concat_ws("\t", x["title"], x["page"].cast("string")))
    # Asking for the text here too lets both readers of ``texts`` share their exchanges.
    return texts.join(lists, "doc_id", "left").select(
        "doc_id", F.when(ok & (F.length("text") >= 0), F.array_join(lines, "\n")).otherwise("").alias("bookmark"), "toc_start", "toc_end"
    )


# ---------------------------------------------------------------- model answers


def _answer_lines(df: DataFrame, text: str) -> DataFrame:
    lines = df.select("doc_id", F.posexplode(F.split(trim_u(text), "\n")).alias("seq", "line"))
    return lines.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "line")


def split_response(df: DataFrame, text: str = "response", digits: int | None = None) -> DataFrame:
    """(doc_id, seq, title, page, level) of an indented answer, fenced or not.

    The number of leading tabs is the level; lines without page take the last numeric page above.
    With ``digits`` a longer number or numeral at a line's end is part of the title, not a page.
    """
    fenced = F.regexp_extract(text, "(?s)```(.*?)```", 1)
    body = F.when(F.regexp_like(F.col(text), F.lit("(?s)```.*?```")), trim_u(fenced)).otherwise(trim_u(text))
    lines = df.select("doc_id", F.posexplode(F.split(body, "\n")).alias("seq", "line")).filter(~is_blank("line"))
    line = F.regexp_replace("line", "^\\r+|\\r+$", "")
    tabs = F.length(F.regexp_extract(line, "^\\t*", 0))
    size = "+" if digits is None else f"{{1,{digits}}}"
    arabic, roman = f"(?U)\\s+([0-9]{size})\\s*$", f"(?iU)\\s+([ivxlcdm]{size})\\s*$"
    staged = lines.select("doc_id", F.col("seq").cast("bigint").alias("seq"), trim_u(line).alias("t"), tabs.cast("bigint").alias("level"))
    t = F.col("t")
    entries = staged.select(
        "doc_id", "seq",
        F.when(t.rlike(arabic), trim_u(F.regexp_replace(t, arabic, "")))
        .when(t.rlike(roman), trim_u(F.regexp_replace(t, roman, ""))).otherwise(t).alias("title"),
        F.when(t.rlike(arabic), F.regexp_extract(t, arabic, 1).cast("bigint").cast("string"))
        .when(t.rlike(roman), F.regexp_extract(t, roman, 1)).alias("page_text"),
        "level",
    )
    return fill_page_forward(entries).select("doc_id", "seq", "title", "page", "level")


def _found(title: Column, page: Column, chapter: Column | None = None) -> Column:
    return F.struct(
        title.alias("title"), page.alias("page"), (chapter if chapter is not None else F.lit(None).cast("string")).alias("chapter")
    )


def _tab_entry(line: Column, e: Column) -> Column:
    usable = e.isNotNull() & ~line.startswith("TOC_") & ~line.isin("NO_TOC", *L.HEADER_LINES)
    return F.when(usable, _found(e["title"], e["page"]))


def _table_entry(line: Column) -> Column:
    """Entry of a Markdown table row: last cell the page; ``chapter`` is set on chapter rows."""

    def titled(t: Column, page: Column) -> Column:
        first = F.get(t, 0)
        is_chapter = first.rlike(L.CHAPTER_MARK)
        title = F.when(is_chapter, F.concat_ws(" ", first, F.get(t, 1))).otherwise(F.array_join(t, " "))
        return F.when(F.size(t) > 0, _found(title, page, F.when(is_chapter, first)))

    def read(c: Column) -> Column:
        parts = F.filter(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda x: x != "")
        page = L.page_number(F.try_element_at(c, F.lit(-1)))
        return F.when(
            F.size(c) >= 2,
            let(F.struct(parts.alias("t"), page.alias("p")), lambda x: F.when(x["p"].isNotNull(), titled(x["t"], x["p"]))),
        )

    cells = F.transform(F.split(F.regexp_replace(line, "^\\||\\|$", ""), "\\|"), trim_u)
    usable = (
        line.startswith("|") & ~F.contains(line, F.lit("---"))
        & ~F.contains(line, F.lit("章节")) & ~F.contains(line, F.lit("标题"))
    )
    return F.when(usable, let(cells, read))


def _indented_entry(line: Column) -> Column:
    usable = (line != "") & ~line.startswith("TOC_") & (line != "NO_TOC") & ~line.rlike("(?s)^\\|.*\\|")

    def tidy(c: Column) -> Column:
        return trim_u(F.regexp_replace(c, "[.…·]{2,}", ""))

    def checked(e: Column) -> Column:
        return F.when((e["title"] != "") & e["page"].isNotNull(), e)

    def read(t: Column) -> Column:
        by_tab = let(_found(tidy(F.regexp_extract(t, L.TAB_LINE, 1)), L.page_number(F.regexp_extract(t, L.TAB_LINE, 2))), checked)
        number = F.regexp_extract(t, L.DIGITS_LINE, 2).try_cast("bigint")
        by_number = let(_found(tidy(F.regexp_extract(t, L.DIGITS_LINE, 1)), F.when(number > 0, number)), checked)
        return F.coalesce(F.when(F.contains(t, F.lit("\t")), by_tab), F.when(t.rlike("(?U)\\s[0-9]+$"), by_number))

    return F.when(usable, let(F.regexp_replace(line, L.LONG_LEADER, "\t"), read))


def _free_entry(line: Column, e: Column) -> Column:
    usable = (line != "") & ~line.startswith("TOC_") & (line != "NO_TOC")

    def heading(clean: Column) -> Column:
        marked = (
            clean.rlike(L.CHAPTER_MARK) | clean.rlike(L.NUMBERED) | clean.rlike(L.ENUMERATED)
        )
        return F.when((F.length(clean) >= 2) & marked, _found(clean, F.lit(None).cast("bigint")))

    clean = trim_u(F.regexp_replace(line, L.BULLETS, ""))
    return F.when(usable, F.when(e.isNotNull(), _found(e["title"], e["page"])).otherwise(let(clean, heading)))


def _tagged(way: int, entry: Column) -> Column:
    return let(
        entry,
        lambda e: F.when(
            e.isNotNull(),
            F.struct(F.lit(way).alias("way"), e["title"].alias("title"), e["page"].alias("page"), e["chapter"].alias("chapter")),
        ),
    )


def parse_markdown_table(df: DataFrame, text: str = "response") -> DataFrame:
    """Entries of a Markdown table, sub-titles prefixed by the chapter above."""
    rows = _answer_lines(df, text).select("doc_id", "seq", _rows_of(let(trim_u("line"), _table_entry)))
    return carry_chapter(rows).select("doc_id", "seq", "title", "page")


def parse_response(df: DataFrame, text: str = "response") -> DataFrame:
    """(doc_id, seq, title, page) of a model's answer in whichever format it came.

    Tab entries if there are three, else a Markdown table if there is one, else three indented entries,
    else free lines.  Every line is read in all four ways at once, and one scan in (way, line) order
    carries chapters and pages and counts each way's entries.
    """
    usable = df.filter(L.response_status(text)["status"] != "NO_TOC")

    def ways(x: Column) -> Column:
        line, e = x["line"], x["e"]
        return F.array(
            _tagged(0, _tab_entry(line, e)), _tagged(1, _table_entry(line)),
            _tagged(2, _indented_entry(line)), _tagged(3, _free_entry(line, e)),
        )

    facts = let(trim_u("line"), lambda t: F.struct(t.alias("line"), L.parse_toc_line(t).alias("e")))
    read = F.filter(let(facts, ways), lambda w: w.isNotNull())
    rows = _answer_lines(usable, text).select("doc_id", "seq", F.inline(read))
    way, page = F.col("way"), F.col("page")
    out = ordered_scan(
        rows, ["doc_id"], ["way", "seq"],
        {
            "_chapter": fill(F.when(way == 1, F.col("chapter"))),
            "_page": fill_next(F.when(way == 3, page)),
            **{f"_n{w}": total(F.when((way == w) & page.isNotNull(), 1).otherwise(0)) for w in range(3)},  # way 3 is the rest
        },
        block=way * F.lit(2**40) + F.floor(F.col("seq") / ordered.BLOCK_ROWS),
    )
    best = F.when(F.col("_n0") >= 3, 0).when(F.col("_n1") >= 1, 1).when(F.col("_n2") >= 3, 2).otherwise(3)
    sub = (way == 1) & F.col("chapter").isNull() & F.col("_chapter").isNotNull()
    return out.filter(way == best).select(
        "doc_id", "seq",
        F.when(sub, F.concat_ws(" ", "_chapter", "title")).otherwise(F.col("title")).alias("title"),
        F.when(way == 3, F.col("_page")).otherwise(page).alias("page"),
    ).filter("page IS NOT NULL")

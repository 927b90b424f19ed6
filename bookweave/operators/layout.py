"""Aligning recognised text blocks with line boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, let, trim_u
from .ordered import following, ordered_scan, sum_before, total

BOX = ["doc_id", "page_no", "box_no"]
BLOCK = ["doc_id", "page_no", "block_no"]
#: Boxes a horizontal band of a page should hold; denser pages are cut into more bands.
BAND_BOXES = 64
#: Boxes, blocks and characters up to which a page is gathered in one row.
FEW_BOXES, FEW_BLOCKS, FEW_CHARS = 128, 128, 1 << 20


# ---------------------------------------------------------------- predicates


def has_text(c: str) -> Column:
    """A box counts as filled by any character, blanks included."""
    return F.coalesce(F.col(c) != "", F.lit(False))


def box_class(boxes: DataFrame, spatial: str = "spatial_text") -> DataFrame:
    """``body`` for wide lines of text height that have spatial text, else ``edge``."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    body = (w > 0.5) & (h > 0.01) & (h < 0.05) & has_text(spatial)
    return boxes.withColumn("box_class", F.when(body, "body").otherwise("edge"))


def crop_eligible(boxes: DataFrame, dpi: int = 200, width: str = "page_width", height: str = "page_height") -> DataFrame:
    """Boxes worth recognising on their own, with padded pixel rectangle and target height."""
    pw, ph = F.col(width), F.col(height)
    rect = boxes.withColumns(
        {
            "px0": F.greatest(F.lit(0.0), F.col("x0") * pw - 3).cast("int"),
            "py0": F.greatest(F.lit(0.0), F.col("y0") * ph - 3).cast("int"),
            "px1": F.least(pw.cast("double"), F.col("x1") * pw + 3).cast("int"),
            "py1": F.least(ph.cast("double"), F.col("y1") * ph + 3).cast("int"),
        }
    ).withColumns({"crop_w": F.col("px1") - F.col("px0"), "crop_h": F.col("py1") - F.col("py0")})
    w, h = F.col("crop_w"), F.col("crop_h")
    area = max(80, 150 * dpi * dpi // 90000)
    flat = F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h)) > 100
    return rect.filter((w > 0) & (h > 0) & ~flat & (w * h >= area)).withColumn(
        "target_h", F.when(h < 40, 48).otherwise(h)
    )


def low_quality_box(boxes: DataFrame, text: str = "text") -> DataFrame:
    """Flag empty texts, and texts under four characters in wide boxes."""
    short = (F.length(text) < 4) & ((F.col("x1") - F.col("x0")) > 0.15)
    return boxes.withColumn("low_quality", F.coalesce(F.length(text), F.lit(0)).eqNullSafe(0) | F.coalesce(short, F.lit(False)))


def usable_block(blocks: DataFrame, width: str = "page_width", height: str = "page_height") -> DataFrame:
    """Blocks with text and a rectangle of at least 2 x 2 points, with their font size."""
    w = F.col("bx1") * F.col(width) - F.col("bx0") * F.col(width)
    h = F.col("by1") * F.col(height) - F.col("by0") * F.col(height)
    return blocks.filter(~is_blank("text") & (w >= 2) & (h >= 2)).withColumn(
        "font_size", F.greatest(F.lit(9.0), F.least(F.lit(14.0), h / 12.0))
    )


# ---------------------------------------------------------------- placement


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks that a box can lie in, with their trimmed text."""
    fit = ~is_blank("text") & (F.col("by0") <= F.col("by1")) & F.col("bx0").isNotNull() & F.col("bx1").isNotNull()
    return blocks.filter(fit).select(*BLOCK, "bx0", "by0", "bx1", "by1", trim_u("text").alias("block_text"))


def _pairs(boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """(box, block) pairs where the box centre lies in the block, on the same page, with the text's length.

    Pages are cut into horizontal bands, as many as their boxes call for; a box falls into one band, a
    block into those it covers.  Ordinary pages have one band and nothing is repeated, a page with
    millions of boxes is spread over thousands of join keys.  Rectangles meet without their texts.
    """
    bands = boxes.groupBy("doc_id", "page_no").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / BAND_BOXES)).cast("int").alias("_bands")
    )

    def band(y: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(y * F.col("_bands")).cast("int"), F.col("_bands") - 1))

    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    left = boxes.join(bands, ["doc_id", "page_no"]).withColumns({"_cx": cx, "_cy": cy}).withColumn("_band", band(F.col("_cy")))
    right = placed.withColumn("_length", F.length("block_text")).join(bands, ["doc_id", "page_no"]).select(
        *BLOCK, "bx0", "by0", "bx1", "by1", "_length",
        F.explode(F.sequence(band(F.col("by0")), band(F.col("by1")))).alias("_band"),
    )
    pairs = left.join(right, ["doc_id", "page_no", "_band"]).filter(
        F.col("_cx").between(F.col("bx0"), F.col("bx1")) & F.col("_cy").between(F.col("by0"), F.col("by1"))
    )
    return pairs.select(*BOX, "block_no", "x0", "y0", "x1", "y1", "_length")


def spatial_assign(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(box, block) pairs where the box centre lies in the block, on the same page, with the block's text."""
    placed = _placed(blocks)
    return _pairs(boxes, placed).drop("_length").join(placed.select(*BLOCK, "block_text"), BLOCK)


def _pieces(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Block texts cut over their boxes in proportion to width: (doc_id, page_no, box_no, block_no, _piece).

    One aggregate gives each block's width and last box, one scan over ids and numbers each box's start; a
    block's text is read beside its boxes only where they are cut from it.  Widths are added as decimals, so
    the cut does not depend on the order of addition; twenty digits keep equal widths equal, which decides ties.
    """
    width = F.greatest(F.lit(0.001), F.col("x1") - F.col("x0"))
    whole = pairs.groupBy(*BLOCK).agg(F.sum(width.cast("decimal(28,20)")).cast("double").alias("_total"), F.max("box_no").alias("_last"))
    chars = F.bround(F.col("_length") * (width / F.col("_total")), 0).cast("int")
    sized = pairs.join(whole, BLOCK).select(*BOX, "block_no", chars.alias("_chars"), (F.col("box_no") == F.col("_last")).alias("_ends"))
    cut = ordered_scan(sized, BLOCK, ["box_no"], {"_start": sum_before(F.col("_chars"))}).join(texts, BLOCK)
    text = F.col("block_text")
    size = F.when(F.col("_ends"), F.length(text)).otherwise(F.col("_chars"))
    return cut.select(*BOX, "block_no", F.substring(text, (F.col("_start") + 1).cast("int"), size).alias("_piece")).filter(F.col("_piece") != "")


def _joined() -> Column:
    """The pieces of a group's box in the order of their blocks ('' where all are NULL)."""
    piece = F.when(F.col("_piece").isNotNull(), F.struct("block_no", "_piece"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["_piece"]), " ")


def allocate_text(matches: DataFrame) -> DataFrame:
    """Texts of matched blocks cut over their boxes in proportion to width: (doc_id, page_no, box_no, text)."""
    texts = matches.groupBy(*BLOCK).agg(F.any_value("block_text").alias("block_text"))
    pieces = _pieces(matches.withColumn("_length", F.length("block_text")).drop("block_text"), texts)
    return pieces.groupBy(*BOX).agg(_joined().alias("text"))


def _trimmed(t: Column, n: Column) -> Column:
    """Text ``t`` without the 4 to 2 characters at its end that ``n``, the beginning of the next line, starts with."""
    shared = F.lit(0)
    for k in (2, 3, 4):
        fits = (F.length(t) >= k) & (F.length(n) >= k) & (F.right(t, F.lit(k)) == F.left(n, F.lit(k)))
        shared = F.when(fits, k).otherwise(shared)
    shared = F.when((F.length(t) >= 3) & (F.length(n) >= 3), shared).otherwise(F.lit(0))
    return let(shared, lambda k: F.when(k > 0, F.regexp_replace(F.left(t, F.length(t) - k), "(?U)\\s+$", "")).otherwise(t))


def trim_overlap(boxes: DataFrame, text: str = "text") -> DataFrame:
    """Cut 4 to 2 characters that end a line and start the next one on the page."""
    out = ordered_scan(boxes, ["doc_id", "page_no"], ["box_no"], {"_next": following(F.left(F.col(text), F.lit(4)))})
    return out.withColumn(text, _trimmed(F.col(text), F.col("_next"))).drop("_next")


def box_texts(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, box_no, text): text of every box from the blocks around it, '' where there is none.

    Boxes are only their keys and rectangles here.  A page of few boxes, blocks and characters is gathered in one row,
    so its boxes and texts move once; the others are cut into bands and blocks of rows.  Both read the same exchanges, as
    pages are told apart by a struct, which has no null that a filter below one of the readers would drop.
    """
    page = F.struct("doc_id", "page_no").alias("_page")
    rows = boxes.select(page, "box_no", "x0", "y0", "x1", "y1")
    placed = _placed(blocks).select(page, "block_no", "bx0", "by0", "bx1", "by1", "block_text")
    per_box = rows.groupBy("_page").agg(F.count("*").alias("_n"))
    per_block = placed.groupBy("_page").agg(F.count("*").alias("_m"), F.sum(F.length("block_text")).alias("_chars"))
    few = (F.col("_n") <= FEW_BOXES) & (F.coalesce("_m", F.lit(0)) <= FEW_BLOCKS) & (F.coalesce("_chars", F.lit(0)) <= FEW_CHARS)
    sizes = per_box.join(per_block, "_page", "left").select("_page", few.alias("_few"))
    rows, placed = rows.join(sizes, "_page"), placed.join(sizes, "_page")

    def others(df: DataFrame) -> DataFrame:
        # A list of one row or none, as Spark would put the filters of the joins to come below the shared exchange.
        row = F.struct("_page.*", *[c for c in df.columns if c not in ("_page", "_few")])
        return df.select(F.inline(F.when(~F.col("_few"), F.array(row))))

    return _gathered(rows.filter("_few"), placed.filter("_few")).unionByName(_banded(others(rows), others(placed)))


def _banded(boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """``box_texts`` of pages of any size."""
    texts = _pieces(_pairs(boxes, placed), placed.select(*BLOCK, "block_text")).groupBy(*BOX).agg(_joined().alias("text"))
    every = boxes.select(*BOX).join(texts, BOX, "left").withColumn("text", F.coalesce("text", F.lit("")))
    return trim_overlap(every)


def _gathered(boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """``box_texts`` of pages that fit a row: the same rules over a page's sorted boxes and blocks."""
    sorted_list = lambda df: F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c not in ("_page", "_few")])))
    pages = boxes.groupBy("_page").agg(sorted_list(boxes).alias("_b"))
    pages = pages.join(placed.groupBy("_page").agg(sorted_list(placed).alias("_k")), "_page", "left")
    width = lambda b: F.greatest(F.lit(0.001), b["x1"] - b["x0"])

    def inside(k: Column) -> Column:
        cx, cy = lambda b: (b["x0"] + b["x1"]) / 2, lambda b: (b["y0"] + b["y1"]) / 2
        return F.filter("_b", lambda b: cx(b).between(k["bx0"], k["bx1"]) & cy(b).between(k["by0"], k["by1"]))

    def cut(k: Column, own: Column) -> Column:
        exact = F.aggregate(own, F.lit(0).cast("decimal(37,20)"), lambda a, b: (a + width(b).cast("decimal(28,20)")).cast("decimal(37,20)"))
        text = k["block_text"]
        sized = lambda whole: F.transform(own, lambda b: F.bround(F.length(text) * (width(b) / whole), 0).cast("int"))
        start = lambda chars, i: F.aggregate(F.slice(chars, 1, i), F.lit(0).cast("bigint"), lambda a, c: a + c)
        size = lambda chars, i: F.when(i == F.size(own) - 1, F.length(text)).otherwise(F.get(chars, i))
        piece = lambda chars, i: F.substring(text, (start(chars, i) + 1).cast("int"), size(chars, i))
        every = lambda chars: F.transform(own, lambda b, i: F.struct(b["box_no"].alias("box_no"), piece(chars, i).alias("piece")))
        return let(let(exact.cast("double"), sized), every)

    # A page without a key has no blocks, as in a join by it.
    known = F.when(F.col("_page.doc_id").isNotNull() & F.col("_page.page_no").isNotNull(), F.col("_k"))
    pieces = F.flatten(F.transform(known, lambda k: let(inside(k), lambda own: cut(k, own))))
    piece = lambda ps, b: F.transform(F.filter(ps, lambda p: (p["box_no"] == b["box_no"]) & (p["piece"] != "")), lambda p: p["piece"])
    texts = let(pieces, lambda ps: F.transform("_b", lambda b: F.coalesce(F.array_join(piece(ps, b), " "), F.lit(""))))
    line = lambda t, b, i: F.struct(b["box_no"].alias("box_no"), _trimmed(F.get(t, i), F.left(F.get(t, i + 1), F.lit(4))).alias("text"))
    trimmed = let(texts, lambda t: F.transform("_b", lambda b, i: line(t, b, i)))
    # The outer form, as Spark would make the texts again to tell which of the lists are empty.
    return pages.select("_page.*", F.inline_outer(trimmed))


def spatial_texts(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The boxes with their ``text`` of ``box_texts``."""
    found = boxes.drop("text").join(box_texts(boxes, blocks), BOX, "left")
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def fill_from_spatial(perbox: DataFrame, spatial: DataFrame) -> DataFrame:
    """Per-box texts, with empty or low-quality ones and all body boxes taken from the spatial texts."""
    # Boxes meet by a struct, as in ``box_texts``; a null key has no spatial text.
    found = spatial.select(F.struct(*BOX).alias("_box"), F.col("text").alias("spatial_text"))
    classed = box_class(perbox.withColumn("_box", F.struct(*BOX)).join(found, "_box", "left").drop("_box"))
    flagged = low_quality_box(classed)
    take = ((F.col("box_class") == "body") | F.col("low_quality")) & has_text("spatial_text")
    return flagged.select(
        *BOX, "box_class", "low_quality",
        F.when(take, F.col("spatial_text")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )


# ---------------------------------------------------------------- counts, chunks, order


def ocr_match_rate(boxes: DataFrame) -> DataFrame:
    """Per document: boxes with text, boxes, whole per cent, characters."""
    hit = F.count(F.when(has_text("text"), 1))
    # Asking for a whole row lets the readers of a scan behind ``boxes`` share its exchange.
    return boxes.groupBy("doc_id").agg(
        F.any_value(F.struct(*boxes.columns)).alias("_any"),
        hit.alias("matched"), F.count("*").alias("boxes"),
        F.floor(hit * 100 / F.greatest(F.lit(1), F.count("*"))).cast("bigint").alias("percent"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
    ).filter("_any IS NOT NULL").drop("_any")


def layout_counts(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per document: pages with blocks, blocks, boxes."""
    per_page = blocks.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    a = per_page.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("n").alias("blocks"))
    b = boxes.groupBy("doc_id").agg(F.count("*").alias("boxes"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, "doc_id", "full").select(
        "doc_id", F.coalesce("pages", zero).alias("pages"), F.coalesce("blocks", zero).alias("blocks"), F.coalesce("boxes", zero).alias("boxes")
    )


def chunk_pages(pages: DataFrame, max_pages: int = 200, chunk: int = 100) -> DataFrame:
    """Documents over the limit cut into chunks: ``chunk_no`` and ``local_page`` per page."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    long = F.col("_n") > max_pages
    return pages.join(counts, "doc_id").withColumns(
        {
            "chunk_no": F.when(long, F.floor(F.col("page_no") / chunk)).otherwise(0).cast("bigint"),
            "local_page": F.when(long, F.col("page_no") % chunk).otherwise(F.col("page_no")).cast("bigint"),
        }
    ).drop("_n")


def concat_chunks(chunks: DataFrame, size: int = 100) -> DataFrame:
    """Chunk results back on the pages of the document."""
    return chunks.withColumn("page_no", F.col("local_page") + F.col("chunk_no") * size).drop("chunk_no", "local_page")


# Image extensions in page order.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif"]


def page_order(files: DataFrame) -> DataFrame:
    """Page images (doc_id, name) numbered by extension group, lower case first, then name.

    The images are dealt by ranges of (document, extension, name), so a folder with very many of them is
    cut into blocks wherever its names lie; a range's number is its place in the order.
    """
    ext = F.regexp_extract("name", "(?i)(\\.[a-z]+)$", 1)
    group = F.array_position(F.array(*[F.lit(e) for x in IMAGE_EXTENSIONS for e in (x, x.upper())]), ext)
    images = files.withColumn("_ext", group).filter(F.col("_ext") > 0)
    images = images.repartitionByRange("doc_id", "_ext", "name").withColumn("_range", F.spark_partition_id())
    out = ordered_scan(
        images, ["doc_id"], ["_ext", "name"],
        {"page_no": sum_before(F.lit(1)), "page_count": total(F.lit(1))},
        block=F.col("_range"),
    )
    return out.select(*files.columns, F.col("page_no").cast("bigint").alias("page_no"), F.col("page_count").cast("bigint").alias("page_count"))

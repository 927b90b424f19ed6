"""Layout files of recognition services as tables of blocks, boxes and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, nonempty, trim_u
from ..operators.ordered import ordered_scan, sum_before, top_per_group

_RESULT = (
    "struct<result:struct<layoutParsingResults:array<struct<"
    "prunedResult:struct<width:double,height:double,parsing_res_list:array<struct<"
    "block_content:string,block_bbox:array<double>,block_label:string>>>,"
    "markdown:struct<text:string,images:map<string,string>>,"
    "outputImages:map<string,string>>>>>"
)


def _results(line: Column) -> Column:
    parsed = F.from_json(line, _RESULT)["result"]["layoutParsingResults"]
    return F.coalesce(parsed, F.array().cast(parsed_type()))


def parsed_type() -> str:
    return _RESULT[len("struct<result:struct<layoutParsingResults:"):-2]


def _usable_entries(r: Column) -> Column:
    return F.filter(
        r["prunedResult"]["parsing_res_list"],
        lambda e: nonempty(e["block_content"]).isNotNull() & (F.size(e["block_bbox"]) == 4),
    )


def parse_layout_jsonl(df: DataFrame, line_col: str = "line", dense: bool = False) -> DataFrame:
    """JSONL lines (doc_id, line_no, line) to blocks with normalised coordinates.

    ``page_no`` is the position of the page result over all lines of a document; ``dense=True`` counts
    only pages that have blocks.
    """
    results = _results(F.col(line_col))
    if dense:
        results = F.filter(results, lambda r: F.coalesce(F.size(_usable_entries(r)) > 0, F.lit(False)))
    staged = df.filter(~is_blank(line_col)).select("doc_id", "line_no", results.alias("_results"))
    placed = ordered_scan(staged, ["doc_id"], ["line_no"], {"_first": sum_before(F.size("_results"))})
    pages = placed.select("doc_id", "_first", F.posexplode("_results").alias("_pos", "_page"))
    page = F.col("_page.prunedResult")
    good = (page["width"] > 0) & (page["height"] > 0)
    absent = F.lit(1.0)
    width = F.when(F.coalesce(page["width"], absent) > 0, F.coalesce(page["width"], absent))
    height = F.when(F.coalesce(page["height"], absent) > 0, F.coalesce(page["height"], absent))
    both = width.isNotNull() & height.isNotNull()
    blocks = pages.select(
        "doc_id",
        (F.col("_first") + F.col("_pos")).cast("bigint").alias("page_no"),
        F.when(both | good, width).otherwise(absent).alias("_w"),
        F.when(both | good, height).otherwise(absent).alias("_h"),
        F.posexplode(_usable_entries(F.col("_page"))).alias("_block", "_e"),
    )
    box = F.col("_e.block_bbox")
    return blocks.select(
        "doc_id", "page_no", F.col("_block").cast("bigint").alias("block_no"),
        trim_u("_e.block_content").alias("text"),
        (box[0] / F.col("_w")).alias("bx0"), (box[1] / F.col("_h")).alias("by0"),
        (box[2] / F.col("_w")).alias("bx1"), (box[3] / F.col("_h")).alias("by1"),
        F.coalesce("_e.block_label", F.lit("")).alias("type"),
    )


def parse_page_markdown(df: DataFrame, line_col: str = "line") -> DataFrame:
    """JSONL lines to one row per page result: markdown text and image maps."""
    staged = df.filter(~is_blank(line_col)).select("doc_id", "line_no", _results(F.col(line_col)).alias("_results"))
    placed = ordered_scan(staged, ["doc_id"], ["line_no"], {"_first": sum_before(F.size("_results"))})
    pages = placed.select("doc_id", "_first", F.posexplode("_results").alias("_pos", "_page"))
    return pages.select(
        "doc_id", (F.col("_first") + F.col("_pos")).cast("bigint").alias("page_no"),
        F.coalesce("_page.markdown.text", F.lit("")).alias("markdown"),
        F.col("_page.markdown.images").alias("images"), F.col("_page.outputImages").alias("output_images"),
    )


_PART = "array<struct<text:string,content:string>>"
_ITEM = "struct<text:string,content:string,bbox:array<double>,page_idx:bigint>"
PART_KEYS = ["paragraph_content", "title_content", "page_header_content", "page_footer_content"]


def _item_text(item: Column) -> Column:
    """Own text, else string content, else the first non-empty list of parts put together."""
    content = item["content"]
    nested = F.when(content.startswith("{"), content)
    options = []
    for k in PART_KEYS:
        parts = F.from_json(F.get_json_object(nested, f"$.{k}"), _PART)
        joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.when(p["text"] != "", p["text"]), p["content"], F.lit(""))), "")
        options.append(F.when(F.size(parts) > 0, joined))
    return F.coalesce(nonempty(item["text"]), nonempty(F.when(nested.isNull(), content)), *options)


def parse_content_list(df: DataFrame, json_col: str = "json", kind: str = "content_list") -> DataFrame:
    """Content lists to blocks.

    ``model``: an array of pages that are arrays of items.  ``content_list``: a flat array whose items
    name their page (default 0).
    """
    if kind == "model":
        pages = df.select("doc_id", F.posexplode(F.from_json(json_col, f"array<array<{_ITEM}>>")).alias("_page", "_items"))
        items = pages.select("doc_id", F.col("_page").cast("bigint").alias("page_no"), F.posexplode("_items").alias("_i", "item"))
    elif kind == "content_list":
        flat = df.select("doc_id", F.posexplode(F.from_json(json_col, f"array<{_ITEM}>")).alias("_i", "item"))
        items = flat.select("doc_id", F.coalesce("item.page_idx", F.lit(0)).cast("bigint").alias("page_no"), "_i", "item")
    else:
        raise ValueError(f"unknown kind: {kind}")
    text = items.withColumn("text", _item_text(F.col("item"))).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    box = F.when(F.size("item.bbox") == 4, F.col("item.bbox"))
    return text.select(
        "doc_id", "page_no", F.col("_i").cast("bigint").alias("item_no"), "text",
        *[F.get(box, i).alias(n) for i, n in enumerate(("bx0", "by0", "bx1", "by1"))],
    )


def layout_file_choice(df: DataFrame) -> DataFrame:
    """The member (bundle, seq, name) of each bundle to read, with its ``kind``."""
    base = F.element_at(F.split("name", "/"), -1)
    kind = (
        F.when(base.endswith("_model.json"), "model")
        .when(base.endswith("_content_list.json"), "content_list")
        .when(base.endswith("_content_list_v2.json"), "content_list_v2")
        .when(F.col("name").endswith("full.md"), "markdown")
    )
    place = F.array_position(F.array(*map(F.lit, ["model", "content_list", "content_list_v2", "markdown"])), F.col("kind"))
    named = df.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("_place", place)
    return top_per_group(named, ["bundle"], [F.col("_place"), F.col("seq")]).drop("_place")


def markdown_lines(df: DataFrame, text: str = "markdown") -> DataFrame:
    """Non-empty markdown lines as blocks of page 0 without a place."""
    lines = df.select("doc_id", F.posexplode(F.filter(F.transform(F.split(text, "\n"), trim_u), lambda t: t != "")).alias("_i", "text"))
    return lines.select(
        "doc_id", F.lit(0).cast("bigint").alias("page_no"), F.col("_i").cast("bigint").alias("block_no"), "text",
        *[F.lit(None).cast("double").alias(n) for n in ("bx0", "by0", "bx1", "by1")],
    )


_BOXES = "struct<pages:array<struct<page:bigint,boxes:array<array<double>>>>,_bad:string>"


def parse_line_boxes(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Detector output to one row per box.  Pages without boxes keep one row; bad JSON gives ``error``."""
    parsed = F.from_json(json_col, _BOXES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    staged = df.withColumn("_p", parsed)
    bad = F.col("_p._bad").isNotNull() | F.col("_p").isNull()
    pages = staged.select("doc_id", F.when(bad, "invalid JSON").alias("error"), F.explode_outer("_p.pages").alias("_page"))
    boxes = pages.filter(F.col("_page").isNotNull() | F.col("error").isNotNull()).select(
        "doc_id", "error", F.col("_page.page").alias("page_no"), F.posexplode_outer("_page.boxes").alias("_i", "_b")
    )
    return boxes.select(
        "doc_id", "page_no", F.col("_i").cast("bigint").alias("box_no"),
        *[F.get("_b", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "error",
    )

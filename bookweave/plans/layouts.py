"""Layout, box and text-layer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as O
from ..operators import quality as Q
from ..operators.batch import map_pages
from ..sources import layout as S
from .registry import query
from .views import Views

# ---------------------------------------------------------------- readers

_RESULTS = """
    SELECT doc_id, line_no, CAST(first_page + i AS BIGINT) AS page_no, res[i + 1] AS r FROM (
      SELECT *, coalesce(sum(len(res)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_page, unnest(range(len(res))) AS i
      FROM (SELECT doc_id, line_no, CAST(json_extract(line, '$.result.layoutParsingResults') AS JSON[]) AS res FROM layout_jsonl))"""
_BLOCKS = f"""
    SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) - 1 AS BIGINT) AS block_no, text, bx0, by0, bx1, by1, type FROM (
      SELECT doc_id, page_no, i, trim(json_extract_string(e, '$.block_content')) AS text, CAST(json_extract(e, '$.block_bbox[0]') AS DOUBLE) / w AS bx0, CAST(json_extract(e, '$.block_bbox[1]') AS DOUBLE) / h AS by0,
             CAST(json_extract(e, '$.block_bbox[2]') AS DOUBLE) / w AS bx1, CAST(json_extract(e, '$.block_bbox[3]') AS DOUBLE) / h AS by1, coalesce(json_extract_string(e, '$.block_label'), '') AS type
      FROM (SELECT doc_id, page_no, i, es[i + 1] AS e, CASE WHEN w <= 0 OR h <= 0 THEN 1.0::DOUBLE ELSE w END AS w, CASE WHEN w <= 0 OR h <= 0 THEN 1.0::DOUBLE ELSE h END AS h FROM (
              SELECT *, CAST(json_extract(r, '$.prunedResult.width') AS DOUBLE) AS w, CAST(json_extract(r, '$.prunedResult.height') AS DOUBLE) AS h, unnest(range(len(es))) AS i
              FROM (SELECT *, CAST(json_extract(r, '$.prunedResult.parsing_res_list') AS JSON[]) AS es FROM ({_RESULTS}))))
      WHERE trim(json_extract_string(e, '$.block_content')) <> '' AND json_array_length(json_extract(e, '$.block_bbox')) = 4)"""


@query("parse_layout_jsonl", _BLOCKS)
def parse_layout_jsonl(v: Views):
    return S.parse_layout_jsonl(v.layout_jsonl)


@query(
    "parse_layout_jsonl_dense",
    f"SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS page_no, block_no, text FROM ({_BLOCKS})",
)
def parse_layout_jsonl_dense(v: Views):
    return S.parse_layout_jsonl(v.layout_jsonl, dense=True).select("doc_id", "page_no", "block_no", "text")


@query(
    "parse_page_markdown",
    f"SELECT doc_id, page_no, coalesce(json_extract_string(r, '$.markdown.text'), '') AS markdown, json_extract_string(r, '$.markdown.images.\"a.png\"') AS image FROM ({_RESULTS})",
)
def parse_page_markdown(v: Views):
    return S.parse_page_markdown(v.layout_jsonl).select("doc_id", "page_no", "markdown", F.col("images")["a.png"].alias("image"))


_CONTENT = "coalesce(nullif(trim(json_extract_string(item, '$.text')), ''), CASE WHEN json_type(item, '$.content') = 'VARCHAR' THEN nullif(trim(json_extract_string(item, '$.content')), '') END, {parts})"
_PARTS = """CASE WHEN json_type(item, '$.content') = 'OBJECT' THEN array_to_string(list_transform(CAST(coalesce(json_extract(item, '$.content.paragraph_content'), json_extract(item, '$.content.title_content')) AS JSON[]),
             lambda p: coalesce(json_extract_string(p, '$.text'), json_extract_string(p, '$.content'), '')), '') END"""
_BOX = ", ".join(f"CASE WHEN json_array_length(json_extract(item, '$.bbox')) = 4 THEN CAST(json_extract(item, '$.bbox[{i}]') AS DOUBLE) END AS {n}" for i, n in enumerate(("bx0", "by0", "bx1", "by1")))
_TEXTUAL = _CONTENT.format(parts=_PARTS)


@query(
    "parse_content_list",
    f"SELECT * FROM (SELECT doc_id, coalesce(CAST(json_extract(item, '$.page_idx') AS BIGINT), 0) AS page_no, CAST(i AS BIGINT) AS item_no, {_TEXTUAL} AS text, {_BOX} FROM (SELECT doc_id, unnest(CAST(flat AS JSON[])) AS item, unnest(range(CAST(json_array_length(flat) AS BIGINT))) AS i FROM content_lists)) WHERE text <> ''",
)
def parse_content_list(v: Views):
    return S.parse_content_list(v.content_lists, "flat")


@query(
    "parse_content_list_model",
    f"""SELECT * FROM (SELECT doc_id, CAST(p AS BIGINT) AS page_no, CAST(i AS BIGINT) AS item_no, {_TEXTUAL} AS text, {_BOX} FROM (
          SELECT doc_id, p, unnest(CAST(items AS JSON[])) AS item, unnest(range(CAST(json_array_length(items) AS BIGINT))) AS i FROM (
            SELECT doc_id, unnest(CAST(nested AS JSON[])) AS items, unnest(range(CAST(json_array_length(nested) AS BIGINT))) AS p FROM content_lists))) WHERE text <> ''""",
)
def parse_content_list_model(v: Views):
    return S.parse_content_list(v.content_lists, "nested", kind="model")


@query(
    "layout_file_choice",
    """SELECT bundle, seq, name, kind FROM (SELECT *, CASE WHEN suffix(name, '_model.json') THEN 'model' WHEN suffix(name, '_content_list.json') THEN 'content_list' WHEN suffix(name, '_content_list_v2.json') THEN 'content_list_v2' WHEN suffix(name, 'full.md') THEN 'markdown' END AS kind FROM bundle_members)
       WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bundle ORDER BY list_position(['model', 'content_list', 'content_list_v2', 'markdown'], kind), seq) = 1""",
)
def layout_file_choice(v: Views):
    return S.layout_file_choice(v.bundle_members)


@query(
    "markdown_lines",
    """SELECT doc_id, CAST(0 AS BIGINT) AS page_no, CAST(unnest(range(len(ls))) AS BIGINT) AS block_no, unnest(ls) AS text FROM (
         SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)""",
)
def markdown_lines(v: Views):
    return S.markdown_lines(v.documents.select("doc_id", F.col("text").alias("markdown"))).select("doc_id", "page_no", "block_no", "text")


@query(
    "parse_line_boxes",
    """WITH p AS (SELECT doc_id, unnest(CAST(json_extract(json, '$.pages') AS JSON[])) AS pg FROM (SELECT * FROM detector_output WHERE json_valid(json))),
            b AS (SELECT doc_id, CAST(json_extract(pg, '$.page') AS BIGINT) AS page_no, CAST(json_extract(pg, '$.boxes') AS JSON[]) AS bs FROM p)
       SELECT doc_id, page_no, CAST(i AS BIGINT) AS box_no, CAST(json_extract(bs[i + 1], '$[0]') AS DOUBLE) AS x0, CAST(json_extract(bs[i + 1], '$[1]') AS DOUBLE) AS y0, CAST(json_extract(bs[i + 1], '$[2]') AS DOUBLE) AS x1, CAST(json_extract(bs[i + 1], '$[3]') AS DOUBLE) AS y1, CAST(NULL AS VARCHAR) AS error
       FROM (SELECT *, unnest(range(len(bs))) AS i FROM b)
       UNION ALL SELECT doc_id, page_no, NULL, NULL, NULL, NULL, NULL, NULL FROM b WHERE len(bs) = 0
       UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid JSON' FROM detector_output WHERE NOT json_valid(json)""",
)
def parse_line_boxes(v: Views):
    return S.parse_line_boxes(v.detector_output)


# ---------------------------------------------------------------- boxes

_MATCH = """
    SELECT b.doc_id, b.page_no, b.box_no, k.block_no, b.x0, b.y0, b.x1, b.y1, trim(k.text) AS block_text FROM line_boxes b JOIN layout_blocks k ON k.doc_id = b.doc_id AND k.page_no = b.page_no
      AND (b.x0 + b.x1) / 2 BETWEEN k.bx0 AND k.bx1 AND (b.y0 + b.y1) / 2 BETWEEN k.by0 AND k.by1 WHERE trim(k.text) <> ''"""
_ALLOC = f"""
    SELECT doc_id, page_no, box_no, string_agg(piece, ' ' ORDER BY block_no) AS text FROM (
      SELECT doc_id, page_no, box_no, block_no, substr(block_text, CAST(coalesce(sum(chars) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT),
               CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY doc_id, page_no, block_no) THEN length(block_text) ELSE CAST(chars AS BIGINT) END) AS piece
      FROM (SELECT *, round_even(length(block_text) * (wd / CAST(sum(CAST(CAST(wd AS VARCHAR) AS DECIMAL(28, 20))) OVER (PARTITION BY doc_id, page_no, block_no) AS DOUBLE)), 0) AS chars
            FROM (SELECT *, greatest(CAST(0.001 AS DOUBLE), x1 - x0) AS wd FROM ({_MATCH}))) WINDOW w AS (PARTITION BY doc_id, page_no, block_no ORDER BY box_no))
    WHERE piece <> '' GROUP BY doc_id, page_no, box_no"""


def _trim_sql(src: str) -> str:
    k = "CASE WHEN length(text) < 3 OR coalesce(length(nxt), 0) < 3 THEN 0 WHEN length(text) >= 4 AND length(nxt) >= 4 AND right(text, 4) = left(nxt, 4) THEN 4 WHEN right(text, 3) = left(nxt, 3) THEN 3 WHEN right(text, 2) = left(nxt, 2) THEN 2 ELSE 0 END"
    return f"""SELECT doc_id, page_no, box_no, CASE WHEN k > 0 THEN rtrim(left(text, length(text) - k)) ELSE text END AS text FROM (SELECT *, {k} AS k FROM (
               SELECT *, lead(text) OVER (PARTITION BY doc_id, page_no ORDER BY box_no) AS nxt FROM ({src})))"""


_SPATIAL = _trim_sql(f"SELECT b.doc_id, b.page_no, b.box_no, coalesce(a.text, '') AS text FROM line_boxes b LEFT JOIN ({_ALLOC}) a USING (doc_id, page_no, box_no)")


@query("spatial_assign", _MATCH)
def spatial_assign(v: Views):
    return O.spatial_assign(v.line_boxes, v.layout_blocks)


@query("allocate_text", _ALLOC)
def allocate_text(v: Views):
    return O.allocate_text(O.spatial_assign(v.line_boxes, v.layout_blocks))


@query("trim_overlap", _trim_sql("SELECT doc_id, page_no, box_no, CASE WHEN box_no % 2 = 0 THEN concat(s, ' the') ELSE concat('the ', s) END AS text FROM line_boxes"))
def trim_overlap(v: Views):
    rows = v.sql("SELECT doc_id, page_no, box_no, CASE WHEN box_no % 2 = 0 THEN concat(s, ' the') ELSE concat('the ', s) END AS text FROM line_boxes")
    return O.trim_overlap(rows)


def _spatial(v: Views):
    return O.box_texts(v.line_boxes, v.layout_blocks)


@query("spatial_texts", _SPATIAL)
def spatial_texts(v: Views):
    return _spatial(v)


_LOW = "(text = '' OR (length(text) < 4 AND x1 - x0 > 0.15))"
_BODY = "(x1 - x0 > 0.5 AND y1 - y0 > 0.01 AND y1 - y0 < 0.05 AND {t} <> '')"


@query(
    "fill_from_spatial",
    f"""SELECT p.doc_id, p.page_no, p.box_no, CASE WHEN {_BODY.format(t='s.t')} THEN 'body' ELSE 'edge' END AS box_class, {_LOW} AS low_quality,
               CASE WHEN ({_BODY.format(t='s.t')} OR {_LOW}) AND s.t <> '' THEN s.t ELSE text END AS text
        FROM perbox_texts p LEFT JOIN (SELECT doc_id, page_no, box_no, text AS t FROM ({_SPATIAL})) s USING (doc_id, page_no, box_no)""",
)
def fill_from_spatial(v: Views):
    return O.fill_from_spatial(v.perbox_texts, _spatial(v))


@query("box_class", f"SELECT doc_id, page_no, box_no, CASE WHEN {_BODY.format(t='text')} THEN 'body' ELSE 'edge' END AS box_class FROM perbox_texts")
def box_class(v: Views):
    return O.box_class(v.perbox_texts, "text").select("doc_id", "page_no", "box_no", "box_class")


@query("low_quality_box", f"SELECT doc_id, page_no, box_no, {_LOW} AS low_quality FROM perbox_texts")
def low_quality_box(v: Views):
    return O.low_quality_box(v.perbox_texts).select("doc_id", "page_no", "box_no", "low_quality")


_RECT = """SELECT doc_id, page_no, box_no, CAST(trunc(greatest(0.0, x0 * 1700 - 3)) AS INT) AS px0, CAST(trunc(greatest(0.0, y0 * 2200 - 3)) AS INT) AS py0,
           CAST(trunc(least(1700.0, x1 * 1700 + 3)) AS INT) AS px1, CAST(trunc(least(2200.0, y1 * 2200 + 3)) AS INT) AS py1 FROM line_boxes"""


@query(
    "crop_eligible",
    f"""SELECT *, CASE WHEN crop_h < 40 THEN 48 ELSE crop_h END AS target_h FROM (SELECT *, px1 - px0 AS crop_w, py1 - py0 AS crop_h FROM ({_RECT}))
        WHERE crop_w > 0 AND crop_h > 0 AND CAST(greatest(crop_w, crop_h) AS DOUBLE) / greatest(1, least(crop_w, crop_h)) <= 100 AND crop_w * crop_h >= 80""",
)
def crop_eligible(v: Views):
    boxes = v.line_boxes.withColumns({"page_width": F.lit(1700), "page_height": F.lit(2200)})
    return O.crop_eligible(boxes).select("doc_id", "page_no", "box_no", "px0", "py0", "px1", "py1", "crop_w", "crop_h", "target_h")


@query(
    "usable_block",
    "SELECT doc_id, page_no, block_no, greatest(9.0::DOUBLE, least(14.0::DOUBLE, (by1 * 200 - by0 * 200) / 12.0::DOUBLE)) AS font_size FROM layout_blocks WHERE trim(text) <> '' AND bx1 * 300 - bx0 * 300 >= 2 AND by1 * 200 - by0 * 200 >= 2",
)
def usable_block(v: Views):
    blocks = v.layout_blocks.withColumns({"page_width": F.lit(300), "page_height": F.lit(200)})
    return O.usable_block(blocks).select("doc_id", "page_no", "block_no", "font_size")


@query(
    "ocr_match_rate",
    f"SELECT doc_id, count(*) FILTER (text <> '') AS matched, count(*) AS boxes, CAST(floor(count(*) FILTER (text <> '') * 100 / greatest(1, count(*))) AS BIGINT) AS percent, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({_SPATIAL}) GROUP BY doc_id",
)
def ocr_match_rate(v: Views):
    return O.ocr_match_rate(_spatial(v))


@query(
    "layout_counts",
    "SELECT doc_id, coalesce(p, 0) AS pages, coalesce(b, 0) AS blocks, coalesce(x, 0) AS boxes FROM (SELECT doc_id, count(DISTINCT page_no) AS p, count(*) AS b FROM layout_blocks GROUP BY doc_id) FULL JOIN (SELECT doc_id, count(*) AS x FROM line_boxes GROUP BY doc_id) USING (doc_id)",
)
def layout_counts(v: Views):
    return O.layout_counts(v.layout_blocks, v.line_boxes)


_CHUNKED = "SELECT doc_id, page_no, CASE WHEN n > 6 THEN CAST(floor(page_no / 4) AS BIGINT) ELSE 0 END AS chunk_no, CASE WHEN n > 6 THEN page_no % 4 ELSE page_no END AS local_page FROM (SELECT doc_id, page_no, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_pages)"


@query("chunk_pages", _CHUNKED)
def chunk_pages(v: Views):
    return O.chunk_pages(v.doc_pages.select("doc_id", "page_no"), 6, 4)


@query("concat_chunks", "SELECT doc_id, page_no FROM doc_pages")
def concat_chunks(v: Views):
    return O.concat_chunks(O.chunk_pages(v.doc_pages.select("doc_id", "page_no"), 6, 4).drop("page_no"), 4)


@query(
    "page_order",
    """SELECT doc_id, name, row_number() OVER w - 1 AS page_no, count(*) OVER (PARTITION BY doc_id) AS page_count FROM (
         SELECT *, list_position(['.jpg', '.JPG', '.jpeg', '.JPEG', '.png', '.PNG', '.bmp', '.BMP', '.tiff', '.TIFF', '.tif', '.TIF'], regexp_extract(name, '(\\.[A-Za-z]+)$', 1)) AS g FROM page_images)
       WHERE g > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY g, name)""",
)
def page_order(v: Views):
    return O.page_order(v.page_images)


# ---------------------------------------------------------------- verdicts

_SOLID = "length(regexp_replace({t}, '[\\s\\x{{3000}}]', '', 'g'))"
_BLANKS = f"SELECT doc_id, page_no, CASE WHEN length(text) = 0 OR {_SOLID.format(t='text')} < length(text) * 0.6 THEN 1 ELSE 0 END AS blank FROM (SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 3 = 0 THEN repeat(' ', 20) WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM doc_pages) WHERE page_no < 5"
_SCANS = "SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 3 = 0 THEN repeat(' ', 20) WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM doc_pages"


@query("scanned_verdict", f"SELECT doc_id, CAST(sum(blank) AS BIGINT) AS blanks, sum(blank) >= 3 AS scanned FROM ({_BLANKS}) GROUP BY doc_id")
def scanned_verdict(v: Views):
    return Q.scanned_verdict(v.sql(_SCANS))


@query("scanned_verdict_adaptive", f"SELECT doc_id, CAST(sum(blank) AS BIGINT) AS blanks, sum(blank) >= count(*) * 0.6 AS scanned FROM ({_BLANKS}) GROUP BY doc_id")
def scanned_verdict_adaptive(v: Views):
    return Q.scanned_verdict(v.sql(_SCANS), mode="adaptive")


@query(
    "readable_verdict",
    f"""SELECT p.doc_id, CAST(sum(CASE WHEN r >= 0.15 THEN 1 ELSE 0 END) AS BIGINT) AS readable, sum(CASE WHEN r >= 0.15 THEN 1 ELSE 0 END) >= 3 AS ok FROM
          (SELECT doc_id, CAST(floor(n * i / 6.0) AS BIGINT) AS page_no FROM (SELECT doc_id, count(*) AS n FROM toc_pages GROUP BY doc_id), (SELECT unnest(range(1, 6)) AS i)) p
        JOIN (SELECT doc_id, page_no, CAST(length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{f900}}-\\x{{faff}}]', '', 'g')) AS DOUBLE) / greatest(1, {_SOLID.format(t='text')}) AS r FROM toc_pages) t ON t.doc_id = p.doc_id AND t.page_no = p.page_no GROUP BY p.doc_id""",
)
def readable_verdict(v: Views):
    return Q.readable_verdict(v.toc_pages)


@query(
    "size_saving",
    "SELECT source, CAST(sum(n_chars * 4) AS BIGINT) AS before, CAST(sum(n_chars) AS BIGINT) AS after, round_even((1.0::DOUBLE - CAST(sum(n_chars) AS DOUBLE) / sum(n_chars * 4)) * 100, 1) AS saved_pct FROM documents GROUP BY source",
)
def size_saving(v: Views):
    docs = v.documents.select("source", (F.col("n_chars") * 4).alias("before"), F.col("n_chars").alias("after"))
    return Q.size_saving(docs, ["source"])


@query("map_pages", "SELECT doc_id, page_no, CASE WHEN doc_id % 7 = 3 THEN '' ELSE reverse(text) END AS text, CASE WHEN doc_id % 7 = 3 THEN 'ValueError: not read' END AS error FROM doc_pages")
def run_model(v: Views):
    """A stand-in for a model: the whole text backwards; it fails on some documents."""

    def fn(pdf):
        if any(d % 7 == 3 for d in pdf["doc_id"].array):
            raise ValueError("not read")
        return [t[::-1] for t in pdf["text"]]

    return map_pages(v.doc_pages, fn, batch=1, concurrency=16)

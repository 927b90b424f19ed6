"""Derived inputs over the driver tables.

The tables hold no catalogs, contents lists, boxes or task events, so these views make them in SQL that
Spark and DuckDB both run; where the dialects differ a view has two texts.  Every view reads its tables
whole and numbers its rows without a window.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows cost much to work on (long texts, lookups, whole pages made of them), with their keys.  They are
#: always spread: a file of many splits may hold its rows in one row group, which is read by one task.
SPREAD = {"documents": "doc_id", "pages": "page_id", "orders": "o_orderkey", "part": "p_partkey"}
_PARTITIONS: dict[tuple[int, str], int] = {}
TABLES = ["part", "supplier", "orders", "lineitem", "events", "documents", "pages"]

_CN = "substr('一二三四五六七八九', CAST(1 + seq % 9 AS INT), 1)"
_PAGE = "CAST(1 + seq * 3 + doc_id % 7 AS STRING)"

VIEWS: dict[str, str | dict[str, str]] = {
    "books": """
        SELECT p_partkey AS id, concat(p_name, ' ', lower(p_type)) AS title, s_name AS author, p_brand AS publisher,
               CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('978', lpad(CAST(p_partkey - p_partkey % 3 AS STRING), 10, '0')) END AS isbn,
               lpad(CAST(p_partkey - p_partkey % 3 AS STRING), 8, '0') AS ss_code,
               CASE WHEN p_partkey % 2 = 0 THEN 'cat_a' ELSE 'cat_b' END AS source
        FROM part LEFT JOIN supplier ON s_suppkey * 20 = p_partkey - p_partkey % 20""",
    "requests": """
        SELECT o_orderkey AS req_id,
               CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_custkey AS STRING), 8, '0') ELSE '' END AS ss_code,
               CASE WHEN o_orderkey % 3 = 1 THEN concat(p_name, ': volume ', CAST(o_orderkey % 4 AS STRING)) ELSE '' END AS title,
               CASE WHEN o_orderkey % 3 = 2 THEN concat('978-', lpad(CAST(o_custkey AS STRING), 10, '0')) ELSE '' END AS isbn,
               CASE WHEN o_orderkey % 4 = 0 THEN p_brand ELSE '' END AS author, o_orderpriority AS priority
        FROM orders JOIN part ON p_partkey = o_custkey""",
    "metadata": """
        SELECT lpad(CAST(p_partkey - p_partkey % 3 AS STRING), 8, '0') AS ss_code, p_partkey AS rank, 1 + p_partkey % 3 AS tier,
               CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS publisher,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(1950 + p_partkey % 70 AS STRING) END AS year,
               concat(CAST(p_partkey % 30 AS STRING), '.', CAST(p_partkey % 10 AS STRING), CASE p_partkey % 4 WHEN 0 THEN ' MB' WHEN 1 THEN ' KB' WHEN 2 THEN ' GB' ELSE ' MiB' END) AS size,
               CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' ELSE '' END AS format
        FROM part""",
    "sentences": {
        "spark": """
            SELECT doc_id, CAST(seq AS BIGINT) AS seq, trim(s) AS s
            FROM (SELECT doc_id, posexplode(split(text, '[.\\\\n]+')) AS (seq, s) FROM documents)""",
        "duckdb": """
            SELECT doc_id, CAST(i - 1 AS BIGINT) AS seq, trim(s) AS s
            FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i
                  FROM (SELECT doc_id, string_split_regex(text, '[.\\n]+') AS parts FROM documents))""",
    },
    "toc_lines": f"""
        SELECT doc_id, seq,
               CASE (doc_id + seq) % 7
                 WHEN 0 THEN concat('第', {_CN}, '章 ', s, ' ..... ', {_PAGE})
                 WHEN 1 THEN concat(s, chr(9), {_PAGE})
                 WHEN 2 THEN concat(s, ' | sub | ', {_PAGE})
                 WHEN 3 THEN concat('- ', s, ' …… ', CASE WHEN seq % 2 = 0 THEN 'xiv' ELSE {_PAGE} END)
                 WHEN 4 THEN concat('第', {_CN}, '章 ', s)
                 WHEN 5 THEN concat(CAST(seq AS STRING), '.', CAST(seq % 3 AS STRING), ' ', s, ' ', {_PAGE})
                 ELSE concat('# ', s, chr(9), '十', {_CN}) END AS line
        FROM sentences""",
    "entries": f"""
        SELECT doc_id, seq,
               CASE WHEN (doc_id + seq) % 5 = 0 THEN concat('第', {_CN}, '章 ', s)
                    WHEN (doc_id + seq) % 5 = 1 THEN concat('第', {_CN}, '节 ', s)
                    WHEN (doc_id + seq) % 11 = 2 THEN concat('第', {_CN}, '篇 ', s)
                    WHEN (doc_id + seq) % 13 = 3 THEN concat('附录 ', s)
                    WHEN (doc_id + seq) % 5 = 4 THEN concat(CAST(seq AS STRING), '.1 ', s)
                    ELSE s END AS title,
               CASE WHEN doc_id % 3 = 0 THEN 1 + seq * 2 WHEN doc_id % 3 = 1 THEN 1 + (seq * 37) % 91 ELSE seq * 40 END AS page,
               CASE WHEN doc_id % 7 = 0 THEN seq % 6 - 1 END AS explicit,
               (doc_id + seq) % 5 = 0 AS is_chapter
        FROM sentences WHERE s <> ''""",
    "holed_entries": """
        SELECT doc_id, seq, title, is_chapter, CASE WHEN is_chapter OR (doc_id + seq) % 4 = 0 THEN NULL ELSE page END AS page,
               CASE WHEN is_chapter OR (doc_id + seq) % 4 = 0 THEN ''
                    WHEN (doc_id + seq) % 9 = 1 THEN 'xiv' ELSE CAST(page AS STRING) END AS page_text,
               CASE WHEN is_chapter THEN title END AS chapter
        FROM entries""",
    "toc_pages": f"""
        SELECT doc_id, seq AS page_no,
               CASE (doc_id + seq) % 5
                 WHEN 0 THEN concat('目 录', chr(10), '第', {_CN}, '章 概论基础方法 ..... ', {_PAGE}, chr(10), '第九章 基础', chr(10), '.....', chr(10), {_PAGE})
                 WHEN 1 THEN concat('第一章 ', s, ' ..... ', {_PAGE}, chr(10), '第二章 ', s, ' ..... ', {_PAGE}, chr(10), '1.1 background', chr(9), {_PAGE})
                 WHEN 2 THEN concat('第', {_CN}, '章', chr(10), s, ' ..... ', {_PAGE}, chr(10), '2.', chr(10), s, ' …… ', {_PAGE})
                 WHEN 3 THEN concat('xx目 录zz ', s)
                 ELSE s END AS text
        FROM sentences""",
    "wrapped_texts": {
        "spark": """
            SELECT doc_id, concat_ws(chr(10), transform(split(text, '[.\\\\n]+'), (s, i) ->
                CASE (doc_id * 7 + i * 5 + length(s) * 3) % 10
                  WHEN 0 THEN '.......' WHEN 1 THEN CAST(i AS STRING) WHEN 2 THEN concat(trim(s), '....') WHEN 3 THEN '第三章'
                  WHEN 4 THEN '2.' WHEN 5 THEN '' WHEN 6 THEN '…… · —' WHEN 7 THEN CAST(i * 2 AS STRING) ELSE trim(s) END)) AS text
            FROM documents""",
        "duckdb": """
            SELECT doc_id, list_aggregate(list_transform(range(len(parts)), lambda i:
                CASE (doc_id * 7 + i * 5 + length(parts[i + 1]) * 3) % 10
                  WHEN 0 THEN '.......' WHEN 1 THEN CAST(i AS STRING) WHEN 2 THEN concat(trim(parts[i + 1]), '....') WHEN 3 THEN '第三章'
                  WHEN 4 THEN '2.' WHEN 5 THEN '' WHEN 6 THEN '…… · —' WHEN 7 THEN CAST(i * 2 AS STRING) ELSE trim(parts[i + 1]) END), 'string_agg', chr(10)) AS text
            FROM (SELECT doc_id, string_split_regex(text, '[.\\n]+') AS parts FROM documents)""",
    },
    "doc_pages": {
        "spark": """
            SELECT doc_id, page_no, substr(text, CAST(1 + page_no * 800 AS INT), 800) AS text
            FROM (SELECT doc_id, text, explode(sequence(0L, greatest(0L, CAST(ceil(length(text) / 800) AS BIGINT) - 1))) AS page_no FROM documents)""",
        "duckdb": """
            SELECT doc_id, page_no, substr(text, CAST(1 + page_no * 800 AS INT), 800) AS text
            FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 800.0) AS BIGINT)))) AS page_no FROM documents)""",
    },
    "doc_sizes": "SELECT doc_id, 40 + doc_id % 90 AS total_pages, doc_id % 9 - 2 AS toc_start, doc_id % 9 + doc_id % 13 AS toc_end FROM documents",
    "page_labels": """
        SELECT doc_id, seq AS page_no,
               CASE WHEN doc_id % 4 <> 1 AND seq = doc_id % 12 THEN '000001.jpg'
                    WHEN doc_id % 2 = 0 AND seq = doc_id % 12 + 2 THEN '!00001.jpg' ELSE concat('p', CAST(seq AS STRING)) END AS label
        FROM sentences""",
    "line_boxes": """
        SELECT doc_id, page_no, box_no, x0, y0, x0 + w AS x1, y0 + 0.02 AS y1, s
        FROM (SELECT doc_id, CAST(floor(seq / 20) AS BIGINT) AS page_no, seq % 20 AS box_no, s,
                     CAST(length(s) % 40 AS DOUBLE) / 100 AS x0, CAST(seq % 20 AS DOUBLE) / 25 AS y0,
                     CAST(0.05 AS DOUBLE) + CAST((length(s) + seq) % 13 AS DOUBLE) / 18 AS w
              FROM sentences) b""",
    "layout_blocks": {
        engine: f"""
        SELECT doc_id, page_no, half AS block_no, text, CAST(0.05 AS DOUBLE) AS bx0, CAST(half AS DOUBLE) * 2 / 5 AS by0,
               CAST(0.8 AS DOUBLE) AS bx1, CAST(half AS DOUBLE) * 2 / 5 + CAST(0.55 AS DOUBLE) AS by1
        FROM (SELECT doc_id, CAST(floor(seq / 20) AS BIGINT) AS page_no, CAST(floor(seq % 20 / 10) AS BIGINT) AS half, {joined} AS text
              FROM sentences GROUP BY doc_id, CAST(floor(seq / 20) AS BIGINT), CAST(floor(seq % 20 / 10) AS BIGINT)) b"""
        for engine, joined in (("spark", "array_join(transform(sort_array(collect_list(struct(seq, s))), p -> p.s), ' ')"), ("duckdb", "string_agg(s, ' ' ORDER BY seq)"))
    },
    "perbox_texts": """
        SELECT doc_id, page_no, box_no, x0, y0, x1, y1,
               CASE (doc_id + box_no) % 4 WHEN 0 THEN '' WHEN 1 THEN substr(s, 1, 2) ELSE s END AS text
        FROM line_boxes""",
    "cards": """
        SELECT p_partkey AS page_id,
               concat('<a class="x" href="/md5/', md5(CAST(p_partkey AS STRING)), '">', p_name, '</a><div>Author: ', p_brand,
                      '</div><div>Year: ', CAST(1950 + p_partkey % 70 AS STRING), '</div><div>Format: PDF</div><div>Size: ', CAST(p_size AS STRING), '.5 MB</div>',
                      CASE WHEN p_partkey % 3 = 0 THEN concat('<a href="/md5/', md5(CAST(p_partkey + 1 AS STRING)), '"> second ', p_brand, '</a> file.epub 12 KB <b>ISBN</b>: 978-', CAST(p_partkey AS STRING)) ELSE '' END,
                      CASE WHEN p_partkey % 4 = 0 THEN concat('<a href="/md5/', md5(CAST(p_partkey AS STRING)), '">again</a>') ELSE '' END,
                      '<script type="application/ld+json">{"name":"', p_name, '","author":[{"name":"', p_brand, '"},{"name":"', p_type, '"}],"publisher":',
                      CASE WHEN p_partkey % 2 = 0 THEN concat('{"name":"', p_type, '"}') ELSE concat('"', p_type, '"') END,
                      ',"datePublished":"', CAST(1950 + p_partkey % 70 AS STRING), '-01-02"}</script>') AS html
        FROM part""",
    "book_pages": """
        SELECT p_partkey AS page_id,
               concat('<!-- <span property="v:itemreviewed">no</span> --><h1><span class=x property=''v:itemreviewed''><span>', p_name, '</span></span></h1><div id="info"><span><span class="pl"> 作者</span>: <a href="/a">', p_brand,
                      '</a> / <a href="/b"> ', s_name, ' </a></span><br/><span class="pl">出版社:</span> ', p_type, '<br/><span class="pl">出版年:</span> ',
                      CAST(1950 + p_partkey % 70 AS STRING), '<br/><span class="pl">ISBN:</span> 978', lpad(CAST(p_partkey AS STRING), 10, '0'),
                      '<br/></div><strong class="ll" property="v:average"> ', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(CAST(p_partkey % 10 AS STRING), '.5') END,
                      ' </strong><div title="a > b" class=''wide intro''><div><p>', p_name, '</p></div><p> by &#65;&amp;', p_brand, '</p></div><a class="  tag" href="/t">', p_type, '</a><a href="/u" class=''tag big''>', p_brand, '</a>',
                      CASE WHEN p_partkey % 3 = 0 THEN concat('<div class="indent"><span class="pl">简介</span><div>not the contents of it</div></div><div class=''more indent''><span class=''c pl''>目录</span><div>', p_name, ' one</div>', p_brand, ' two</div>') ELSE '' END,
                      CASE WHEN p_partkey % 3 = 1 THEN concat('<div id="dir_1_short">short</div><div id=''dir_1_full''><div><div>', p_name, ' chapter one of many, </div></div>', p_brand, ' chapter two of many, the end</div>') ELSE '' END,
                      '<ul class="k" id=''book-contents''><li> ', p_name, ' <b>x</b><ul><li>inner</li></ul></li><li>', p_brand, '</li></ul><ul><li>other</li></ul>') AS html
        FROM part LEFT JOIN supplier ON s_suppkey * 20 = p_partkey - p_partkey % 20""",
    "record_pages": """
        SELECT p_partkey AS page_id,
               concat(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('<div class=''text-2xl leading-[1.2] font-semibold''><div>', p_name, '</div></div>') END,
                      '<h2>', p_name, ' heading</h2><table><tr><td>ISBN: </td><td>978-', lpad(CAST(p_partkey AS STRING), 10, '0'), '</td></tr></table>',
                      CASE WHEN p_partkey % 2 = 0 THEN '<div class="mt-4 text-sm text-gray-800 font-semibold"><div>English · <span>PDF</span></div> · 2 MB</div>' ELSE '' END,
                      CASE WHEN p_partkey % 5 = 0 THEN concat('<a class=''js-md5-codes-tabs-tab''><span>MD5</span><span>x/y.zip</span></a><a class="on js-md5-codes-tabs-tab"><span><b>Filepath</b></span><span>lib/<i>', p_name, '</i>.v2.epub</span></a>') ELSE '' END,
                      '<a href="https://z-lib.example/book/', CAST(p_partkey AS STRING), '">x</a>',
                      CASE WHEN p_partkey % 2 = 1 THEN concat('"filesize_bytes": ', CAST(p_partkey * 1000 AS STRING)) ELSE concat('File size: <b>', CAST(p_size AS STRING), '.5 MB</b>') END) AS html
        FROM part""",
    "marc_pages": """
        SELECT p_partkey AS page_id,
               concat('<table><tr><td class="td1">200 1 </td><td>200 1#$a ', p_name, ' $f ', p_brand, ' $z</td></tr><tr><td class="td1">210 0</td><td>210 0#$a City $c ', p_type, ' $d', CAST(1950 + p_partkey % 70 AS STRING),
                      '</td></tr><tr><td class="td1"> 210 1</td><td>210 1#$c$d', CAST(1950 + p_partkey % 70 AS STRING), '</td></tr>',
                      CASE WHEN p_partkey % 2 = 0 THEN '<tr><td class="td1">327 1</td><td>too short</td></tr>' ELSE '' END,
                      '<tr><td class="td1">330 1</td><td> ', p_name, ', a long enough abstract of ', p_brand, ' </td></tr></table>') AS html
        FROM part""",
    "vendor_answers": """
        SELECT p_partkey AS req_id, p_partkey % 3 + 1 AS tier, CASE WHEN p_partkey % 4 = 0 THEN '123' ELSE '9780000000001' END AS req_isbn,
               CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS req_author,
               concat(CASE p_partkey % 4 WHEN 0 THEN '{"books":' WHEN 1 THEN '{"books":[],"results":' WHEN 2 THEN '{"data":{"books":' ELSE '{"results":{"results":' END,
                      '[{"id":', CAST(p_partkey % 50 AS STRING), ',"hash":"h', CAST(p_partkey AS STRING), '","title":"', p_name, '","author":"', p_brand, '","extension":"PDF","filesize":', CAST(p_size * 1000 AS STRING), '},',
                      '{"id":', CAST(p_partkey % 70 + 20 AS STRING), ',"book_hash":"b', CAST(p_partkey AS STRING), '","title":"', p_name, '.epub","format":"', CASE p_partkey % 3 WHEN 0 THEN 'epub' ELSE '' END, '","size":"', CAST(p_size AS STRING), ' MB"},',
                      '{"id":3,"title":" ","hash":"x"}]', CASE WHEN p_partkey % 4 >= 2 THEN '}}' ELSE '}' END) AS answer
        FROM part""",
    "candidates": """
        SELECT o_orderkey AS req_id, o_orderkey % 7 AS rank, lpad(CAST(o_custkey AS STRING), 8, '0') AS cand_id, md5(CAST(o_orderkey % 90 AS STRING)) AS cand_hash,
               p_name AS cand_title, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('978', lpad(CAST(o_custkey AS STRING), 10, '0')) END AS cand_isbn
        FROM orders JOIN part ON p_partkey = o_custkey
        UNION ALL
        SELECT o_orderkey AS req_id, 10 AS rank, lpad(CAST(o_custkey AS STRING), 8, '0') AS cand_id, md5(CAST(o_orderkey % 80 AS STRING)) AS cand_hash,
               lower(p_brand) AS cand_title, concat('9-78', lpad(CAST(o_custkey AS STRING), 10, '0')) AS cand_isbn
        FROM orders JOIN part ON p_partkey = o_custkey""",
    "attempts": """
        SELECT l_orderkey * 8 + l_linenumber AS item, CASE l_orderkey % 3 WHEN 0 THEN 'vendor' WHEN 1 THEN 'archive' ELSE 'cat_a' END AS origin,
               CASE l_partkey % 4 WHEN 0 THEN 'archive' WHEN 1 THEN 'vendor' WHEN 2 THEN 'library' ELSE 'other' END AS provider, l_suppkey % 2 = 0 AS ok
        FROM lineitem""",
    "stored_files": """
        SELECT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', lower(p_type), '.pdf') WHEN 1 THEN concat(lpad(CAST(p_partkey - p_partkey % 3 AS STRING), 8, '0'), '_', p_name, '.pdf')
                                  WHEN 2 THEN concat(lpad(CAST(p_partkey - p_partkey % 3 AS STRING), 8, '0'), '.epub') ELSE concat(p_name, ' ', lower(p_type), '.mobi') END AS file_name,
               p_size * 100 AS bytes
        FROM part""",
    "layout_jsonl": """
        SELECT o_custkey AS doc_id, o_orderkey AS line_no,
               concat('{"result":{"layoutParsingResults":[{"prunedResult":{"width":', CAST(o_orderkey % 3 * 500 AS STRING), ',"height":800,"parsing_res_list":[',
                      CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('{"block_content":" ', p_name, ' ","block_bbox":[10,20,510,', CAST(40 + o_orderkey % 9 AS STRING), '],"block_label":"text"},') END,
                      '{"block_content":"  ","block_bbox":[1,2,3,4],"block_label":"text"},{"block_content":"', p_brand, '","block_bbox":[1,2,3]}',
                      ']},"markdown":{"text":"# ', p_name, '","images":{"a.png":"u', CAST(o_orderkey AS STRING), '"}},"outputImages":{}},',
                      '{"prunedResult":{"width":1000,"height":1000,"parsing_res_list":[{"block_content":"', p_brand, '","block_bbox":[0,0,1000,500],"block_label":"title"}]},"markdown":{"text":"', p_brand, '"}}]}}') AS line
        FROM orders JOIN part ON p_partkey = o_custkey""",
    "content_lists": """
        SELECT p_partkey AS doc_id,
               concat('[{"type":"text","text":" ', p_name, ' ","bbox":[0.1,0.2,0.5,0.3],"page_idx":', CAST(p_partkey % 5 AS STRING), '},{"type":"text","text":"","bbox":[1,2,3,4]},',
                      '{"type":"title","content":{"title_content":[{"text":"', p_brand, '"},{"content":" x"}]},"bbox":[1,2,3]},{"content":"', p_type, '"}]') AS flat,
               concat('[[{"text":"', p_name, '","bbox":[0.1,0.2,0.5,0.3]},{"text":" "}],[],[{"content":{"paragraph_content":[{"text":"', p_brand, '"}]},"bbox":[0.5,0.5,1,1]}]]') AS nested
        FROM part""",
    "bundle_members": """
        SELECT o_custkey AS bundle, o_orderkey AS seq,
               concat('out/', CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '_model.json' WHEN 1 THEN '_content_list.json' WHEN 2 THEN '_content_list_v2.json' WHEN 3 THEN '_full.md' ELSE '_layout.pdf' END) AS name
        FROM orders""",
    "detector_output": """
        SELECT p_partkey AS doc_id,
               CASE WHEN p_partkey % 9 = 0 THEN 'not json' ELSE
               concat('{"pages":[{"page":0,"width":10,"height":10,"boxes":[[0.1,0.2,0.3,0.4],[0.5,0.', CAST(p_partkey AS STRING), ',0.7,0.8]]},{"page":1,"boxes":[]},{"page":4,"boxes":[[0,0,1,1]]}]}') END AS json
        FROM part""",
    "page_images": """
        SELECT o_custkey AS doc_id,
               concat(CASE o_orderkey % 3 WHEN 0 THEN '!' ELSE '0' END, lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0'), '_', CAST(o_orderkey AS STRING),
                      CASE o_orderkey % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.tif' WHEN 4 THEN '.tiff' WHEN 5 THEN '.bmp' WHEN 6 THEN '.jpeg' ELSE '.txt' END) AS name
        FROM orders""",
    "queue_status": """
        SELECT event_id, md5(CAST(user_id AS STRING)) AS md5,
               concat('{"current":{"md5":"', md5(CAST(user_id % 20 AS STRING)), '","status":"', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'downloading' END,
                      '"},"queue":[{"md5":"', md5(CAST(user_id AS STRING)), '","failed_at":', CASE WHEN event_type IN ('error', 'click') THEN '"2024-01-01"' ELSE 'null' END,
                      ',"', CASE WHEN event_type = 'click' THEN 'error' ELSE 'error_message' END, '":"', event_type, '"}],"recent_history":[]}') AS status
        FROM events""",
    "task_events": """
        SELECT event_id, ts, user_id AS task_id,
               CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'resume' WHEN 'purchase' THEN 'complete' ELSE 'pause' END AS action,
               CAST(floor(value) AS BIGINT) % 101 AS pct,
               concat('  ', event_type, ' [', CAST(CAST(floor(value) AS BIGINT) % 217 AS STRING), '/217]') AS log_line
        FROM events""",
    "log_lines": """
        SELECT event_id,
               CASE event_id % 12 WHEN 0 THEN concat('[', CAST(event_id % 90 AS STRING), '/90] ', event_type) WHEN 1 THEN concat('INFO [', CAST(event_id % 50 AS STRING), ']')
                 WHEN 2 THEN concat('Page ', CAST(event_id % 40 AS STRING), ' of 40') WHEN 3 THEN concat(CAST(event_id % 30 AS STRING), ' [tesseract] lots of diacritics')
                 WHEN 4 THEN concat('Converting pages ', CAST(event_id % 101 AS STRING), '% (', CAST(event_id % 7 AS STRING), '/7)') WHEN 5 THEN 'Layout detection complete'
                 WHEN 6 THEN concat('Grounded OCR (x) ', CAST(event_id % 101 AS STRING), '%') WHEN 7 THEN 'UserWarning: deprecated' WHEN 8 THEN 'WARN slow'
                 WHEN 9 THEN concat('ERROR ', event_type) WHEN 10 THEN 'task completed' ELSE 'Done.' END AS line,
               CASE WHEN event_id % 2 = 0 THEN 0 ELSE 200 END AS total_pages
        FROM events""",
    "confirm_requests": "SELECT event_id AS req_event, user_id AS task_id, ts AS asked_at FROM events WHERE event_type = 'view'",
    "confirm_responses": "SELECT event_id AS resp_event, user_id AS task_id, ts AS answered_at, event_id % 3 <> 0 AS confirm FROM events WHERE event_type = 'click'",
    "answers": {
        "spark": f"""
            SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'NO_TOC found' WHEN 1 THEN concat('```', chr(10), body, chr(10), '```') WHEN 2 THEN concat(body, chr(10), 'TOC_CONTINUES: ', CAST(doc_id AS STRING), ' - ', CAST(doc_id + 5 AS STRING)) ELSE body END AS response
            FROM (SELECT doc_id, concat_ws(chr(10), transform(filter(split(text, '[.\\\\n]+'), s -> trim(s) <> ''), (s, seq) ->
                    CASE doc_id % 5 WHEN 0 THEN concat(trim(s), chr(9), {_PAGE}) WHEN 1 THEN concat('| ', CASE seq % 3 WHEN 0 THEN concat('第', {_CN}, '章') ELSE '' END, ' | ', trim(s), ' | ', {_PAGE}, ' |')
                      WHEN 2 THEN concat(repeat(chr(9), CAST(seq % 3 AS INT)), trim(s), CASE seq % 4 WHEN 0 THEN concat(' ', {_PAGE}) WHEN 1 THEN ' xii' ELSE '' END)
                      WHEN 3 THEN concat(trim(s), ' ····· ', {_PAGE}) ELSE concat('第', {_CN}, '章 ', trim(s)) END)) AS body FROM documents)""",
        "duckdb": f"""
            SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'NO_TOC found' WHEN 1 THEN concat('```', chr(10), body, chr(10), '```') WHEN 2 THEN concat(body, chr(10), 'TOC_CONTINUES: ', CAST(doc_id AS STRING), ' - ', CAST(doc_id + 5 AS STRING)) ELSE body END AS response
            FROM (SELECT doc_id, coalesce(list_aggregate(list_transform(range(len(parts)), lambda seq:
                    CASE doc_id % 5 WHEN 0 THEN concat(trim(parts[seq + 1]), chr(9), {_PAGE}) WHEN 1 THEN concat('| ', CASE seq % 3 WHEN 0 THEN concat('第', {_CN}, '章') ELSE '' END, ' | ', trim(parts[seq + 1]), ' | ', {_PAGE}, ' |')
                      WHEN 2 THEN concat(repeat(chr(9), CAST(seq % 3 AS INT)), trim(parts[seq + 1]), CASE seq % 4 WHEN 0 THEN concat(' ', {_PAGE}) WHEN 1 THEN ' xii' ELSE '' END)
                      WHEN 3 THEN concat(trim(parts[seq + 1]), ' ····· ', {_PAGE}) ELSE concat('第', {_CN}, '章 ', trim(parts[seq + 1])) END), 'string_agg', chr(10)), '') AS body
                  FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.\\n]+'), lambda s: trim(s) <> '') AS parts FROM documents))""",
    },
    "bookmark_texts": {
        "spark": f"""
            SELECT doc_id, concat_ws(chr(10), transform(split(text, '[.\\\\n]+'), (s, seq) ->
                concat(trim(s), chr(9), CASE seq % 6 WHEN 0 THEN 'xiv' ELSE {_PAGE} END, CASE WHEN doc_id % 2 = 0 THEN concat(chr(9), CASE seq % 5 WHEN 0 THEN 'a' ELSE CAST(seq % 4 - 1 AS STRING) END) ELSE '' END))) AS text
            FROM documents""",
        "duckdb": f"""
            SELECT doc_id, list_aggregate(list_transform(range(len(parts)), lambda seq:
                concat(trim(parts[seq + 1]), chr(9), CASE seq % 6 WHEN 0 THEN 'xiv' ELSE {_PAGE} END, CASE WHEN doc_id % 2 = 0 THEN concat(chr(9), CASE seq % 5 WHEN 0 THEN 'a' ELSE CAST(seq % 4 - 1 AS STRING) END) ELSE '' END)), 'string_agg', chr(10)) AS text
            FROM (SELECT doc_id, string_split_regex(text, '[.\\n]+') AS parts FROM documents)""",
    },
    "tocs": """
        SELECT doc_id, (doc_id + seq) % 3 AS source_rank, seq, s AS title, 1 + seq AS page FROM sentences WHERE s <> ''""",
}


def _needed(sql: str, engine: str, seen: list[str]) -> list[str]:
    """Views a text uses, each after those it uses itself."""
    for name in VIEWS:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            _needed(text(name, engine), engine, seen)
            seen.append(name)
    return seen


def text(name: str, engine: str) -> str:
    v = VIEWS[name]
    return v if isinstance(v, str) else v[engine]


def with_views(sql: str, engine: str, tables: dict[str, str] | None = None) -> str:
    """The query with all views it uses in front; ``tables`` gives the text behind each base table."""
    parts = [f"{n} AS ({text(n, engine)})" for n in _needed(sql, engine, [])]
    whole = " ".join([*parts, sql])
    parts = [f"{t} AS ({q})" for t, q in (tables or {}).items() if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", whole)] + parts
    if not parts:
        return sql
    return f"WITH {'RECURSIVE ' if engine == 'duckdb' else ''}{', '.join(parts)}{',' if _continues(sql) else ''} {_tail(sql)}"


def _continues(sql: str) -> bool:
    return sql.lstrip().upper().startswith("WITH")


def _tail(sql: str) -> str:
    return re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I) if _continues(sql) else sql


class Views:
    """Views and tables of one data folder as DataFrames: ``Views(spark, folder).books``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def _table(self, name: str) -> str:
        """Text of a base table.

        Row groups, not splits, say how many tasks read a file, and those are as large as whoever wrote it chose.  So
        such a table is spread by key, over a partition per core at least, and more where it has more splits.
        """
        if name in SPREAD:
            key = (id(self.spark), self.path(name))
            if key not in _PARTITIONS:
                _PARTITIONS[key] = self.spark.read.parquet(self.path(name)).rdd.getNumPartitions()
            own = self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            return f"SELECT /*+ REPARTITION({max(*own, _PARTITIONS[key])}, {SPREAD[name]}) */ * FROM parquet.`{self.path(name)}`"
        return f"SELECT * FROM parquet.`{self.path(name)}`"

    def sql(self, query: str) -> DataFrame:
        used = re.findall(r"\b\w+\b", with_views(query, "spark"))
        return self.spark.sql(with_views(query, "spark", {t: self._table(t) for t in TABLES if t in used}))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in TABLES:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

"""Queries that exercise the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as G
from ..functions import text as X
from ..sources.files import audit_files, output_name
from .catalog import relevance_sql, similarity_sql
from .registry import query
from .views import Views

_PAIRS = "SELECT req_id, rank, cand_title, CASE WHEN title = '' THEN isbn ELSE title END AS title FROM candidates JOIN requests USING (req_id)"

_SUBTITLED = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat(p_name, '：', p_brand) WHEN 1 THEN concat(p_name, ' —— ', p_brand) WHEN 2 THEN concat('a: ', p_name, '—', p_brand)
    WHEN 3 THEN concat(p_name, '（', p_brand, '）') WHEN 4 THEN concat(':', p_name) WHEN 5 THEN concat(p_name, ' (', p_type, ')= ', p_brand) WHEN 6 THEN concat(p_name, ' • ', p_brand, ' : x') ELSE concat(p_name, ':') END AS title FROM part"""
_CUT = "CASE WHEN instr(title, '{s}') > 1 AND instr(title, '{s}') < length(title) AND length(trim(substr(title, 1, instr(title, '{s}') - 1))) >= 2 THEN trim(substr(title, 1, instr(title, '{s}') - 1)) END"


@query(
    "main_title",
    "SELECT p_partkey, coalesce(" + ", ".join(_CUT.format(s=s) for s in X.SUBTITLE_SEPARATORS) + f", trim(regexp_replace(title, '[（(][^）)]*[）)]', '', 'g'))) AS main FROM ({_SUBTITLED})",
)
def main_title(v: Views):
    return v.sql(_SUBTITLED).select("p_partkey", X.main_title("title").alias("main"))


@query("clean_query_title", f"SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(title, '[（(][^)）]*[)）]', '', 'g')), '[=＝].*$', '')) AS cleaned FROM ({_SUBTITLED})")
def clean_query_title(v: Views):
    return v.sql(_SUBTITLED).select("p_partkey", X.clean_query_title("title").alias("cleaned"))


@query("title_similarity", f"SELECT req_id, rank, {similarity_sql('cand_title', 'title')} AS score FROM ({_PAIRS})")
def title_similarity(v: Views):
    return v.sql(_PAIRS).select("req_id", "rank", X.title_similarity("cand_title", "title").alias("score"))


@query("title_relevance", f"SELECT req_id, rank, {relevance_sql('cand_title', 'title')} AS score FROM ({_PAIRS})")
def title_relevance(v: Views):
    return v.sql(_PAIRS).select("req_id", "rank", X.title_relevance("cand_title", "title").alias("score"))


@query(
    "char_overlap",
    f"SELECT req_id, rank, CAST(len(list_intersect(list_distinct(string_split(cand_title, '')), list_distinct(string_split(title, '')))) AS BIGINT) AS shared FROM ({_PAIRS})",
)
def char_overlap(v: Views):
    return v.sql(_PAIRS).select("req_id", "rank", X.char_overlap("cand_title", "title").cast("bigint").alias("shared"))


_ISBNS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('ISBN: 978-7-', lpad(CAST(p_partkey AS STRING), 9, '0'), ' x') WHEN 1 THEN concat('isbn 7', lpad(CAST(p_partkey AS STRING), 9, '1')) WHEN 2 THEN concat('ISBN 12345678901 979', lpad(CAST(p_partkey AS STRING), 10, '0'))
    WHEN 3 THEN concat('no. 979-', lpad(CAST(p_partkey AS STRING), 10, '2')) WHEN 4 THEN concat('4', lpad(CAST(p_partkey AS STRING), 12, '3'), '.') ELSE p_name END AS t FROM part"""
_ISBN_TRY = ", ".join(
    f"CASE WHEN length(regexp_replace(regexp_extract(t, '{p}', {g}), '[^0-9]', '', 'g')) IN (10, 13) THEN regexp_replace(regexp_extract(t, '{p}', {g}), '[^0-9]', '', 'g') END" for p, g in X.ISBN_PATTERNS
)


@query(
    "isbn_functions",
    f"SELECT p_partkey, coalesce({_ISBN_TRY}) AS found, regexp_replace(t, '[- ]', '', 'g') AS bare, CASE WHEN length(coalesce({_ISBN_TRY})) = 13 THEN substr(coalesce({_ISBN_TRY}), 4) ELSE coalesce({_ISBN_TRY}) END AS tail FROM ({_ISBNS})",
)
def isbn_functions(v: Views):
    out = v.sql(_ISBNS).withColumn("found", X.isbn_extract("t"))
    return out.select("p_partkey", "found", X.isbn_norm("t").alias("bare"), X.isbn13_tail("found").alias("tail"))


@query("title_key", "SELECT doc_id, seq, lower(regexp_replace(s, '\\s+', '', 'g')) AS k FROM sentences")
def title_key(v: Views):
    return v.sentences.select("doc_id", "seq", X.title_key("s").alias("k"))


_SIZES = "SELECT p_partkey, p_partkey * 977 AS actual, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN p_partkey * 980 WHEN 2 THEN p_partkey * 1000 WHEN 3 THEN p_partkey * 977 ELSE p_partkey * 1200 END AS expected FROM part"


@query(
    "size_match",
    f"""SELECT p_partkey, level NOT IN ('too_small', 'mismatch') AS ok, level FROM (SELECT p_partkey, CASE WHEN expected <= 0 THEN 'size_unknown' WHEN actual < 50000 THEN 'too_small'
        WHEN CAST(abs(actual - expected) AS DOUBLE) / expected <= 0.01 THEN 'exact' WHEN CAST(abs(actual - expected) AS DOUBLE) / expected <= 0.05 THEN 'approximate' ELSE 'mismatch' END AS level FROM ({_SIZES}))""",
)
def size_match(v: Views):
    return v.sql(_SIZES).select("p_partkey", X.size_match("actual", "expected").alias("m")).select("p_partkey", "m.ok", "m.level")


@query(
    "cjk_ratio",
    "SELECT doc_id, seq, CASE WHEN solid = 0 THEN 0 ELSE CAST(cjk AS DOUBLE) / solid END AS ratio FROM (SELECT doc_id, seq, length(regexp_replace(line, '[\\s\\x{3000}]', '', 'g')) AS solid, length(regexp_replace(line, '[^\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}]', '', 'g')) AS cjk FROM toc_lines)",
)
def cjk_ratio(v: Views):
    return v.toc_lines.select("doc_id", "seq", X.cjk_ratio("line").alias("ratio"))


# ---------------------------------------------------------------- names

_RAW = "SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ': a/b?' WHEN 1 THEN '  <x>  |' WHEN 2 THEN concat(' ', repeat(concat(p_type, ' '), 14)) ELSE repeat('-', 90) END) AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS STRING), 8, '0') ELSE '' END AS ss_code FROM part"
_SAFE = "trim(regexp_replace(regexp_replace({c}, '[<>:\"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g'))"


def _sanitized(c: str) -> str:
    return _SAFE.format(c=c)


@query("sanitize", f"SELECT p_partkey, {_sanitized('title')} AS safe FROM ({_RAW})")
def sanitize(v: Views):
    return v.sql(_RAW).select("p_partkey", X.sanitize("title").alias("safe"))


_TIDY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '_+', '_', 'g'), '[_\\s\\-]+\\.pdf$', '.pdf'), '^[_\\s\\-]+', ''), '[_\\s\\-,.()|;:]+$', ''))"
_FILLED = _TIDY.format(t=f"concat({_sanitized('author')}, '_', {_sanitized('title')}, ' (', {_sanitized('ss_code')}, ')')")


@query("apply_template", f"SELECT p_partkey, CASE WHEN name <> '' THEN concat(name, '.pdf') END AS name FROM (SELECT p_partkey, {_FILLED} AS name FROM ({_RAW}))")
def apply_template(v: Views):
    fields = {"authors": F.array("author"), "title": F.col("title"), "ss_code": F.col("ss_code")}
    fields["authors"] = F.get(fields["authors"], 0)
    return v.sql(_RAW).select("p_partkey", X.apply_template("{author}_{title} ({ss_code})", fields).alias("name"))


_FINAL = "concat(CASE WHEN ss_code <> '' THEN concat(ss_code, '_') ELSE '' END, trim(regexp_replace(title, '[<>:\"/\\\\|?*]', '_', 'g')), CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_ocr' ELSE '_ocr_bw' END, '.pdf')"


@query("final_name", f"SELECT p_partkey, {_FINAL} AS name FROM ({_RAW})")
def final_name(v: Views):
    done, small = F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 3 != 1
    return v.sql(_RAW).withColumns({"done": done, "small": small}).select("p_partkey", X.final_name("ss_code", "title", "done", "small").alias("name"))


@query(
    "output_name",
    f"SELECT p_partkey, CASE WHEN name <> '' THEN concat(name, '.pdf') ELSE concat(CASE WHEN ss_code <> '' THEN concat(ss_code, '_') ELSE '' END, trim(regexp_replace(title, '[<>:\"/\\\\|?*]', '_', 'g')), '.pdf') END AS output_name FROM (SELECT *, {_TIDY.format(t=_sanitized('author'))} AS name FROM ({_RAW}))",
)
def named(v: Views):
    return output_name(v.sql(_RAW), "{author}", {"authors": "author", "title": "title", "ss_code": "ss_code"}).select("p_partkey", "output_name")


# ---------------------------------------------------------------- files

_AUDIT = """SELECT doc_id, concat('/files/', CAST(doc_id AS STRING), CASE doc_id % 2 WHEN 0 THEN '.txt' ELSE '.PDF' END) AS path, concat(CASE WHEN doc_id % 3 = 0 THEN '%PDF' ELSE '' END, text) AS body FROM documents"""
_WANTED = """CASE doc_id % 4 WHEN 0 THEN upper({md5}) WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE {md5_other} END AS want_md5, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE {n} + doc_id % 5 * 700 END AS want_bytes"""


@query(
    "audit_files",
    f"""SELECT name, bytes, is_pdf, digest, size_class, CASE WHEN bytes > 1024 AND (want_md5 IS NULL OR length(want_md5) <> 32 OR lower(want_md5) = digest)
          AND (NOT ends_with(lower(name), '.pdf') OR is_pdf) AND size_class IN ('size_unknown', 'exact', 'approximate') THEN 'ok' ELSE 'mismatch' END AS verdict
        FROM (SELECT *, CASE WHEN want_bytes <= 0 THEN 'size_unknown' WHEN bytes < 50000 THEN 'too_small' WHEN CAST(abs(bytes - want_bytes) AS DOUBLE) / want_bytes <= 0.01 THEN 'exact'
                WHEN CAST(abs(bytes - want_bytes) AS DOUBLE) / want_bytes <= 0.05 THEN 'approximate' ELSE 'mismatch' END AS size_class
          FROM (SELECT *, {_WANTED.format(md5='digest', md5_other='md5(name)', n='bytes')} FROM (
            SELECT doc_id, substr(path, 8) AS name, octet_length(encode(body))::BIGINT AS bytes, starts_with(body, '%PDF') AS is_pdf, md5(body) AS digest FROM ({_AUDIT.replace('AS STRING', 'AS VARCHAR')}))))""",
)
def audit(v: Views):
    """The documents' texts as files."""
    files = v.sql(_AUDIT).select("doc_id", "path", F.encode("body", "UTF-8").alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))
    facts = files.select("doc_id", F.substring("path", 8, 1000).alias("name"), F.md5("content").alias("digest"), F.col("length").alias("bytes"))
    wanted = _WANTED.format(md5="digest", md5_other="md5(name)", n="bytes")
    md5, size = wanted.split(" AS want_md5, ")
    expected = facts.select("name", F.expr(md5).alias("md5"), F.expr(size.removesuffix(" AS want_bytes")).alias("bytes"))
    return audit_files(files.select("path", "content", "length"), expected)


# ---------------------------------------------------------------- log lines

_N = "TRY_CAST(nullif({x}, '') AS BIGINT)"


@query(
    "parse_progress",
    f"""SELECT event_id, CASE WHEN a IS NULL AND lone IS NOT NULL AND total_pages > 0 THEN lone ELSE coalesce(CASE WHEN total_pages > 0 THEN tess END, pa, a) END AS cur,
               CASE WHEN (a IS NULL AND lone IS NOT NULL AND total_pages > 0) OR (total_pages > 0 AND tess IS NOT NULL) THEN CAST(total_pages AS BIGINT) ELSE coalesce(pb, b) END AS tot FROM (
          SELECT event_id, total_pages, {_N.format(x="regexp_extract(line, '\\[(\\d+)/(\\d+)\\]', 1)")} AS a, {_N.format(x="regexp_extract(line, '\\[(\\d+)/(\\d+)\\]', 2)")} AS b, {_N.format(x="regexp_extract(line, '\\[(\\d+)\\]', 1)")} AS lone,
                 {_N.format(x="regexp_extract(line, '[Pp]age\\s+(\\d+)\\s+[oO]f\\s+(\\d+)', 1)")} AS pa, {_N.format(x="regexp_extract(line, '[Pp]age\\s+(\\d+)\\s+[oO]f\\s+(\\d+)', 2)")} AS pb, {_N.format(x="regexp_extract(line, '^\\s*(\\d+)\\s+\\[tesseract\\]', 1)")} AS tess FROM log_lines)""",
)
def parse_progress(v: Views):
    return v.log_lines.select("event_id", G.parse_progress("line", "total_pages").alias("p")).select("event_id", "p.cur", "p.tot")


@query(
    "parse_stage",
    """SELECT event_id, stage, pct, TRY_CAST(nullif(page, '') AS INT) AS page, TRY_CAST(nullif(total, '') AS INT) AS total, CAST(10 + floor((idx + pct / 100.0::DOUBLE) / 5 * 80) AS INT) AS overall FROM (
         SELECT event_id, CASE WHEN starts_with(l, 'converting') OR starts_with(l, 'converted ') THEN 'convert' WHEN starts_with(l, 'layout detection complete') THEN 'detect' WHEN starts_with(l, 'grounded ocr (') THEN 'ocr' WHEN starts_with(l, 'done') THEN 'embed' END AS stage,
                CASE WHEN starts_with(l, 'convert') THEN 0 WHEN starts_with(l, 'layout') THEN 1 WHEN starts_with(l, 'grounded') THEN 2 ELSE 4 END AS idx,
                CASE WHEN regexp_matches(line, '\\d+%') THEN CAST(regexp_extract(line, '(\\d+)%', 1) AS INT) WHEN regexp_matches(l, 'complete|done|converted') THEN 100 END AS pct,
                regexp_extract(line, '\\((\\d+)/(\\d+)\\)', 1) AS page, regexp_extract(line, '\\((\\d+)/(\\d+)\\)', 2) AS total FROM (SELECT *, lower(trim(line)) AS l FROM log_lines)) WHERE stage IS NOT NULL AND pct IS NOT NULL""",
)
def parse_stage(v: Views):
    return v.log_lines.select("event_id", G.parse_stage("line").alias("s")).filter("s IS NOT NULL").select("event_id", "s.*")


@query(
    "log_severity",
    "SELECT event_id, CASE WHEN contains(line, 'ERROR') OR contains(line, 'error') THEN 'error' WHEN contains(line, 'WARN') THEN 'warn' WHEN contains(line, 'completed') THEN 'success' ELSE 'info' END AS severity, contains(line, 'UserWarning') AS noise FROM log_lines",
)
def log_severity(v: Views):
    return v.log_lines.select("event_id", G.log_severity("line").alias("severity"), G.is_noise("line").alias("noise"))


@query(
    "failure_message",
    """SELECT event_id, CASE WHEN json_extract_string(status, '$.current.md5') = md5 AND json_extract_string(status, '$.current.status') = 'failed' THEN 'unknown error'
              WHEN json_extract_string(status, '$.queue[0].failed_at') IS NOT NULL THEN coalesce(json_extract_string(status, '$.queue[0].error'), json_extract_string(status, '$.queue[0].error_message'), 'unknown error') END AS message FROM queue_status""",
)
def failure_message(v: Views):
    return v.queue_status.select("event_id", G.failure_message("status", "md5").alias("message"))

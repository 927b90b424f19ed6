"""Catalog search, resolution and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_size
from ..operators import resolve as R
from ..operators import search as S
from ..sources import catalog as C
from .registry import query
from .views import Views

BOOK = "id, title, author, publisher, isbn, ss_code, source"
ISBN = ["id"]


@query(
    "read_catalog",
    "SELECT p_partkey AS id, p_name AS title, 'stock' AS source FROM part UNION ALL SELECT s_suppkey, s_name, 'makers' FROM supplier",
)
def read_catalog(v: Views):
    named = {"p_partkey": "id", "p_name": "title", "s_suppkey": "id", "s_name": "title"}
    parts = [
        C.read_catalog(v.spark, {source: v.path(t), "absent": v.path("no_such_catalog")})
        .withColumnsRenamed(named).select("id", "title", "source")
        for source, t in (("stock", "part"), ("makers", "supplier"))
    ]
    return C.union_catalogs(*parts)


@query("read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def read_pages(v: Views):
    return C.read_pages(v.spark, v.path("pages")).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


FIRST = f"""SELECT {BOOK} FROM (SELECT *, row_number() OVER (PARTITION BY isbn, ss_code ORDER BY id) AS rn FROM books WHERE trim(isbn) <> '') b WHERE rn = 1
            UNION ALL SELECT {BOOK} FROM books WHERE trim(isbn) = ''"""


def _catalog_search(v: Views):
    rows = [{"field": "title", "query": "widget"}, {"field": "title", "query": "economy", "logic": "OR"}]
    return S.dedupe_books(S.search_advanced(v.books, rows), ISBN)


_SEARCHED = FIRST.replace("FROM books WHERE", "FROM books WHERE (title LIKE '%widget%' OR title LIKE '%economy%') AND")


@query(
    "catalog_search",
    f"SELECT {BOOK} FROM ({_SEARCHED}) s ORDER BY source, id LIMIT 20 OFFSET 20",
)
def catalog_search(v: Views):
    return S.page_global(_catalog_search(v), 2, 20, ["source", "id"])


@query(
    "catalog_search_summary",
    f"SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages FROM ({_SEARCHED}) s",
)
def catalog_search_summary(v: Views):
    return S.page_summary(_catalog_search(v), 20)


@query("search_field", f"SELECT {BOOK} FROM books WHERE lower(title) LIKE '%red w%'")
def search_field(v: Views):
    return S.search_field(v.books, "title", "Red W")


@query("search_field_wildcard", f"SELECT {BOOK} FROM books WHERE lower(title) LIKE '%r_d%bolt%'")
def search_field_wildcard(v: Views):
    return S.search_field(v.books, "title", "r_d%bolt", wildcard=True)


@query("search_exact", f"SELECT {BOOK} FROM books WHERE lower(trim(ss_code)) = '00000012'")
def search_exact(v: Views):
    return S.search_exact(v.books, "sscode", "00000012 ")


@query(
    "search_advanced",
    f"SELECT {BOOK} FROM books WHERE ((lower(title) LIKE '%red%' OR lower(publisher) = 'brand#3') AND NOT lower(title) LIKE '%bolt%') AND lower(author) LIKE '%supplier%'",
)
def search_advanced(v: Views):
    return S.search_advanced(
        v.books,
        [
            {"field": "title", "query": "red", "logic": "NOT"},
            {"field": "isbn", "query": " "},
            {"field": "publisher", "query": "Brand#3", "fuzzy": False, "logic": "OR"},
            {"field": "title", "query": "bolt", "logic": "NOT"},
            {"field": "author", "query": "supplier", "logic": "AND"},
        ],
    )


_CAND = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '.EPUB') WHEN 1 THEN ' ' ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN '' ELSE 'epub' END AS format FROM part"


@query(
    "keep_format",
    f"SELECT * FROM ({_CAND}) c WHERE lower(format) = 'pdf' OR (format = '' AND lower(title) NOT LIKE '%.epub%')",
)
def keep_format(v: Views):
    return S.keep_format(v.sql(_CAND))


@query("require_title", f"SELECT * FROM ({_CAND}) c WHERE trim(title) <> ''")
def require_title(v: Views):
    return S.require_title(v.sql(_CAND))


@query("dedupe_books", FIRST)
def dedupe_books(v: Views):
    return S.dedupe_books(v.books, ISBN)


@query(
    "union_catalogs",
    f"SELECT {BOOK}, CAST(NULL AS VARCHAR) AS year FROM books WHERE source = 'cat_a' UNION ALL SELECT {BOOK}, CAST(1950 + id % 70 AS VARCHAR) FROM books WHERE source = 'cat_b'",
)
def union_catalogs(v: Views):
    a, b = (v.books.filter(F.col("source") == s) for s in ("cat_a", "cat_b"))
    return C.union_catalogs(a, b.withColumn("year", (F.lit(1950) + F.col("id") % 70).cast("string")))


_VENDOR = """
    SELECT req_id, tier, req_isbn, req_author, i AS rank, item, json_extract_string(item, '$.title') AS title FROM (
      SELECT *, unnest(CAST(list AS JSON[])) AS item, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS i FROM (
        SELECT *, CASE req_id % 4 WHEN 0 THEN json_extract(answer, '$.books') WHEN 1 THEN json_extract(answer, '$.results')
                    WHEN 2 THEN json_extract(answer, '$.data.books') ELSE json_extract(answer, '$.results.results') END AS list FROM vendor_answers))
    WHERE trim(json_extract_string(item, '$.title')) <> ''"""


def _json(n: str) -> str:
    return f"json_extract_string(item, '$.{n}')"


_VENDOR_ROWS = f"""
    SELECT req_id, tier, req_isbn, req_author, rank, {_json('id')} AS book_id, coalesce({_json('hash')}, {_json('book_hash')}) AS hash, title,
           {_json('author')} AS author, {_json('isbn')} AS isbn, {_json('publisher')} AS publisher, {_json('year')} AS year, {_json('language')} AS language,
           lower(coalesce({_json('extension')}, {_json('format')}, '')) AS format, coalesce({_json('filesize')}, {_json('size')}) AS size, {_json('md5')} AS md5
    FROM ({_VENDOR})"""


def _vendor(v: Views):
    return C.parse_vendor_results(v.vendor_answers, "answer", ["req_id", "tier", "req_isbn", "req_author"])


@query("parse_vendor_results", _VENDOR_ROWS)
def parse_vendor_results(v: Views):
    return _vendor(v)


@query(
    "tiered_candidates",
    f"""SELECT book_id, hash, title, tier, strategy FROM (
          SELECT *, CASE tier WHEN 1 THEN 'isbn' WHEN 2 THEN 'title_author' ELSE 'title_only' END AS strategy,
                 row_number() OVER (PARTITION BY book_id ORDER BY tier, rnk) AS rn
          FROM (SELECT *, req_id * 100 + rank AS rnk FROM ({_VENDOR_ROWS}))
          WHERE book_id <> '' AND hash <> '' AND (tier <> 1 OR length(req_isbn) >= 10) AND (tier <> 2 OR req_author <> '')) WHERE rn = 1""",
)
def tiered_candidates(v: Views):
    ranked = _vendor(v).withColumn("rank", F.col("req_id") * 100 + F.col("rank"))
    return S.tiered_candidates(ranked).select("book_id", "hash", "title", "tier", "strategy")


@query(
    "union_external",
    f"SELECT title, format, 'vendor' AS source, CAST(NULL AS VARCHAR) AS md5 FROM ({_VENDOR_ROWS}) UNION ALL SELECT p_name, 'pdf', 'archive', md5(CAST(p_partkey AS VARCHAR)) FROM part",
)
def union_external(v: Views):
    archive = v.sql("SELECT p_name AS title, 'pdf' AS format, 'archive' AS source, md5(CAST(p_partkey AS STRING)) AS md5 FROM part")
    return S.union_external(_vendor(v).select("title", "format", F.lit("vendor").alias("source")), archive)


@query(
    "dedupe_first",
    "SELECT title, id, author FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS rn FROM books) b WHERE rn = 1",
)
def dedupe_first(v: Views):
    return S.dedupe_first(v.books, ["title"], ["id"]).select("title", "id", "author")


@query("search_counts", "SELECT coalesce(source, 'total') AS source, count(*) AS n FROM books WHERE lower(title) LIKE '%red%' GROUP BY GROUPING SETS ((source), ())")
def search_counts(v: Views):
    return S.search_counts(S.search_field(v.books, "title", "red"))


@query("page_summary", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 30.0)) AS BIGINT) AS total_pages FROM books WHERE lower(title) LIKE '%green%'")
def page_summary(v: Views):
    return S.page_summary(S.search_field(v.books, "title", "green"), 30)


@query("page_global", f"SELECT {BOOK} FROM books ORDER BY source, id LIMIT 25 OFFSET 50")
def page_global(v: Views):
    return S.page_global(v.books, 3, 25, ["source", "id"])


@query(
    "page_per_source",
    f"""SELECT {BOOK} FROM (SELECT *, row_number() OVER (ORDER BY source, id) AS rn FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM books WHERE lower(title) LIKE '%red%') WHERE r > 10 AND r <= 20) WHERE rn <= 10""",
)
def page_per_source(v: Views):
    return S.page_per_source(S.search_field(v.books, "title", "red"), 2, 10, ["cat_a", "cat_b"], ["id"])


@query(
    "top_per_group",
    "SELECT ss_code, id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY ss_code ORDER BY id) AS rn FROM books) WHERE rn <= 5",
)
def top_per_group(v: Views):
    return R.top_per_group(v.books, ["ss_code"], [F.col("id")], 5, "place").select("ss_code", "id", "place")


# ---------------------------------------------------------------- resolution

_SIM = """CASE WHEN {a} = '' OR {b} = '' THEN 0
    WHEN contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) THEN CAST(0.9 AS DOUBLE) - CAST(0.2 AS DOUBLE) * (CAST(abs(length({a}) - length({b})) AS DOUBLE) / greatest(length({a}), length({b}), 1))
    ELSE CAST(len(list_intersect(list_distinct(string_split(lower({a}), '')), list_distinct(string_split(lower({b}), '')))) AS DOUBLE)
         / greatest(len(list_distinct(string_split(lower({a}), ''))), len(list_distinct(string_split(lower({b}), ''))), 1) END"""
_MAIN = "CASE WHEN instr({t}, ': ') > 1 THEN trim(substr({t}, 1, instr({t}, ':') - 1)) ELSE trim({t}) END"


def similarity_sql(a: str, b: str) -> str:
    return _SIM.format(a=a, b=b)


_HIT = "b.id AS hit_id, b.title AS hit_title"
_BY_CODE = f"""SELECT r.*, {_HIT} FROM requests r JOIN (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY ss_code ORDER BY id) = 1) b ON r.ss_code = b.ss_code WHERE r.ss_code <> ''"""
_NEEDLES = f"SELECT DISTINCT {_MAIN.format(t='title')} AS needle FROM requests WHERE title <> ''"
_BY_TITLE = f"""
    SELECT r.*, {_HIT}, similarity FROM requests r JOIN (
      SELECT * FROM (SELECT *, {similarity_sql('title', 'needle')} AS similarity FROM (
        SELECT n.needle, c.* FROM ({_NEEDLES}) n JOIN books c ON contains(c.title, n.needle)))
      QUALIFY row_number() OVER (PARTITION BY needle ORDER BY similarity DESC, id) = 1) b ON {_MAIN.format(t='r.title')} = b.needle AND r.title <> '' WHERE similarity >= 0.4"""
_BY_ISBN = f"""
    SELECT r.*, {_HIT} FROM requests r JOIN (
      SELECT n.needle, c.* FROM (SELECT DISTINCT replace(isbn, '-', '') AS needle FROM requests WHERE isbn <> '') n JOIN books c ON contains(c.isbn, n.needle)
      QUALIFY row_number() OVER (PARTITION BY n.needle ORDER BY c.id) = 1) b ON replace(r.isbn, '-', '') = b.needle WHERE r.isbn <> ''"""


@query("lookup_code", f"SELECT req_id, hit_id, hit_title FROM ({_BY_CODE})")
def lookup_code(v: Views):
    return R.lookup_code(v.requests, v.books).select("req_id", "hit_id", "hit_title")


@query("lookup_title", f"SELECT req_id, hit_id, hit_title, similarity FROM ({_BY_TITLE})")
def lookup_title(v: Views):
    return R.lookup_title(v.requests, v.books).select("req_id", "hit_id", "hit_title", "similarity")


@query("lookup_isbn", f"SELECT req_id, hit_id, hit_title FROM ({_BY_ISBN})")
def lookup_isbn(v: Views):
    return R.lookup_isbn(v.requests, v.books).select("req_id", "hit_id", "hit_title")


@query(
    "resolve",
    f"""WITH found AS (SELECT req_id, hit_id, 'code' AS tier FROM ({_BY_CODE}) UNION ALL SELECT req_id, hit_id, 'title' FROM ({_BY_TITLE}) UNION ALL SELECT req_id, hit_id, 'isbn' FROM ({_BY_ISBN}))
        SELECT r.req_id, coalesce(nullif(r.title, ''), b.title) AS title, coalesce(nullif(r.isbn, ''), nullif(b.isbn, '')) AS isbn, coalesce(nullif(r.ss_code, ''), b.ss_code) AS ss_code,
               f.hit_id AS book_id, coalesce(nullif(r.author, ''), b.author) AS author, b.publisher, r.priority, f.tier, f.tier IS NULL AND r.isbn <> '' AS fallback
        FROM requests r LEFT JOIN found f ON f.req_id = r.req_id LEFT JOIN books b ON b.id = f.hit_id""",
)
def resolve(v: Views):
    return R.resolve(v.requests, v.books)


_META1 = "SELECT * FROM metadata QUALIFY row_number() OVER (PARTITION BY ss_code ORDER BY rank) = 1"


@query(
    "enrich_fill",
    f"SELECT b.id, b.ss_code, b.title, coalesce(nullif(b.publisher, ''), nullif(m.publisher, '')) AS publisher, m.year AS year FROM (SELECT id, ss_code, title, CASE WHEN id % 3 = 0 THEN '' ELSE publisher END AS publisher FROM books) b LEFT JOIN ({_META1}) m ON m.ss_code = b.ss_code",
)
def enrich_fill(v: Views):
    base = v.books.select("id", "ss_code", "title", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("publisher")).alias("publisher"))
    return R.enrich_fill(base, v.metadata, ["ss_code"], ["publisher", "year"], ["rank"])


@query(
    "enrich_override",
    f"SELECT b.id, b.ss_code, coalesce(nullif(m.publisher, ''), b.publisher) AS publisher, coalesce(m.year, '1900') AS year FROM books b LEFT JOIN ({_META1}) m ON m.ss_code = b.ss_code",
)
def enrich_override(v: Views):
    base = v.books.select("id", "ss_code", "publisher", F.lit("1900").alias("year"))
    return R.enrich_override(base, v.metadata, ["ss_code"], ["publisher", "year"], ["rank"])


@query(
    "attach_details",
    f"SELECT b.id, b.ss_code, coalesce(m.year, 'n/a') AS year, coalesce(m.format, 'pdf') AS format FROM (SELECT id, CASE WHEN id % 5 = 0 THEN concat('x', ss_code) ELSE ss_code END AS ss_code FROM books) b LEFT JOIN ({_META1}) m ON m.ss_code = b.ss_code",
)
def attach_details(v: Views):
    cand = v.books.select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("x"), "ss_code")).otherwise(F.col("ss_code")).alias("ss_code"))
    return R.attach_details(cand, v.metadata, "ss_code", {"year": "n/a", "format": "pdf"}, ["rank"])


_WORDS = "list_distinct(list_filter(string_split_regex({a}, '[\\s,，、。．：；！？\\-\\x{{4e00}}-\\x{{9fff}}]+'), lambda w: w <> ''))"
_REL = """CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 100
    ELSE CAST(floor(CAST(len(list_intersect({wa}, {wb})) AS DOUBLE) / greatest(len({wa}), len({wb}), 1) * 100) AS INT) END"""


def relevance_sql(a: str, b: str) -> str:
    """Word part of the relevance, for texts without CJK characters."""
    a, b = f"trim(lower({a}))", f"trim(lower({b}))"
    return _REL.format(a=a, b=b, wa=_WORDS.format(a=a), wb=_WORDS.format(a=b))


@query(
    "candidate_gate",
    f"""SELECT req_id, rank, cand_id, cand_title FROM requests JOIN candidates USING (req_id)
        WHERE (title = '' OR cand_title = '' OR {relevance_sql('cand_title', 'title')} >= 30) AND (isbn = '' OR cand_isbn = '' OR replace(isbn, '-', '') = replace(cand_isbn, '-', ''))""",
)
def candidate_gate(v: Views):
    return R.candidate_gate(v.requests, v.candidates, "req_id").select("req_id", "rank", "cand_id", "cand_title")


@query(
    "select_candidate",
    """SELECT req_id, cand_id, matched FROM (SELECT r.req_id, c.cand_id, c.rank, coalesce(c.cand_id = r.ss_code OR c.cand_hash = r.ss_code, false) AS matched
         FROM requests r LEFT JOIN candidates c ON c.req_id = r.req_id) QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY matched DESC, rank) = 1""",
)
def select_candidate(v: Views):
    return R.select_candidate(v.requests, v.candidates, "req_id", "ss_code", ["rank"]).select("req_id", "cand_id", "matched")


@query(
    "best_match",
    f"SELECT req_id, rank, score FROM (SELECT c.req_id, c.rank, {similarity_sql('c.cand_title', 'r.title')} AS score FROM candidates c JOIN requests r ON r.req_id = c.req_id) QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY score DESC, rank) = 1",
)
def best_match(v: Views):
    from ..functions.text import title_similarity

    scored = v.candidates.join(v.requests.select("req_id", "title"), "req_id").withColumn("score", title_similarity("cand_title", "title"))
    return R.best_match(scored, "req_id", "score", ["rank"]).select("req_id", "rank", "score")


_REPORT = "SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END AS marks_toc, CASE WHEN o_orderkey % 3 = 0 THEN 'y' END AS club_toc, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'z' END AS library_toc FROM orders"


@query(
    "source_presence",
    "SELECT o_orderkey AS req_id, o_orderkey % 2 = 0 AS marks, o_orderkey % 3 = 0 AS club, o_orderkey % 5 <> 0 AS library FROM orders",
)
def source_presence(v: Views):
    out = R.source_presence(v.sql(_REPORT), {"marks": "marks_toc", "club": "club_toc", "library": "library_toc"})
    return out.select("req_id", *[F.col("raw_sources")[n].alias(n) for n in ("marks", "club", "library")])


@query(
    "first_success",
    """SELECT item AS item, origin, provider, tier FROM (SELECT *, CASE WHEN origin = 'vendor' THEN CASE WHEN provider = 'vendor' THEN 0 END
           WHEN origin = 'archive' THEN CASE WHEN provider = 'archive' THEN 0 END
           ELSE CASE provider WHEN 'archive' THEN 0 WHEN 'vendor' THEN 1 WHEN 'library' THEN 2 END END AS tier FROM attempts)
         WHERE tier IS NOT NULL AND ok QUALIFY row_number() OVER (PARTITION BY item ORDER BY tier) = 1""",
)
def first_success(v: Views):
    return R.first_success(v.attempts, "item")


_FILE_REQ = "SELECT id, concat(title, '.pdf') AS name, title, ss_code AS code FROM books"


@query(
    "match_files",
    f"""SELECT r.id, coalesce(e.file_name, p.file_name) AS file_name, coalesce(e.bytes, p.bytes) AS bytes FROM ({_FILE_REQ}) r
        LEFT JOIN (SELECT file_name, min(bytes) AS bytes FROM stored_files WHERE bytes > 1024 GROUP BY file_name) e ON e.file_name = r.name
        LEFT JOIN (SELECT substr(file_name, 1, 8) AS code, file_name, bytes FROM stored_files WHERE bytes > 1024 AND regexp_matches(file_name, '^[0-9]{{8}}[_.]')
                   QUALIFY row_number() OVER (PARTITION BY substr(file_name, 1, 8) ORDER BY file_name, bytes) = 1) p ON p.code = r.code
        WHERE coalesce(e.file_name, p.file_name) IS NOT NULL""".replace("{{8}}", "{8}"),
)
def match_files(v: Views):
    return R.match_files(v.sql(_FILE_REQ), v.sql("SELECT file_name, min(bytes) AS bytes FROM stored_files WHERE bytes > 1024 GROUP BY file_name"), "id")


_DONE = """SELECT r.id, f.file_name FROM ({req}) r JOIN (SELECT *, regexp_replace(file_name, '\\.(pdf|epub|mobi)$', '') AS stem,
             CASE regexp_extract(file_name, '\\.(pdf|epub|mobi)$', 1) WHEN 'pdf' THEN 1 WHEN 'epub' THEN 2 ELSE 3 END AS place FROM (SELECT DISTINCT file_name FROM stored_files WHERE bytes > 1024)
             QUALIFY row_number() OVER (PARTITION BY stem ORDER BY place) = 1) f ON f.stem = r.title""".replace("{req}", _FILE_REQ)


@query("already_done", _DONE)
def already_done(v: Views):
    return R.already_done(v.sql(_FILE_REQ), v.stored_files, "id")


@query("still_to_do", f"SELECT id, title FROM ({_FILE_REQ}) WHERE id NOT IN (SELECT id FROM ({_DONE}))")
def still_to_do(v: Views):
    return R.still_to_do(v.sql(_FILE_REQ), v.stored_files, "id").select("id", "title")


@query(
    "metadata_sizes",
    "SELECT rank, CAST(floor(CAST(replace(regexp_extract(size, '^([0-9.]+)', 1), ',', '.') AS DOUBLE) * CASE right(size, 3) WHEN ' MB' THEN 1048576.0 WHEN ' KB' THEN 1024.0 WHEN ' GB' THEN 1073741824.0 ELSE 0 END) AS BIGINT) AS bytes FROM metadata",
)
def metadata_sizes(v: Views):
    return v.metadata.select("rank", parse_size("size").alias("bytes"))

"""Queries of the operators for training text, and their SQL counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, kneser_ney, langid, line_dedup, lm, minhash, negatives, packing, pieces, pii, quality_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _over(name: str, *tables: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(*(_table(spark, folder, t) for t in tables))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


OP6 = r"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, pos, line, coalesce(doc_id > f, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> {}) & 31)::INT, 1)"
OP7 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT s, list_transform(range(8), lambda i: ('0x' || substr(s, 1 + 5 * i::INT, 5))::BIGINT) AS xs, min(page_id) AS f FROM p GROUP BY s),
b AS (SELECT s, f, array_to_string(list_transform(xs, lambda x: {" || ".join(_DIGIT.format(k) for k in (15, 10, 5, 0))}), '') AS d FROM g)
SELECT page_id, payload_bytes, d AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> f THEN f END AS refers_to
FROM p JOIN b USING (s)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
v AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 8], ' ') AS s FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM v),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM r WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM x GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (word_chars > 20 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > 3 * n_words
        OR 2 * n_capitals > word_chars OR 10 * n_dup_lines > 4 * n_lines) AS kept
FROM b
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

_over("op1_quality", "documents", "labels")(kneser_ney.op1_quality)
_over("op2_sentencepiece", "documents")(pieces.op2_sentencepiece)
_over("op3_pii", "documents")(pii.op3_pii)
_over("op4_decontaminate", "documents", "benchmark")(decontaminate.op4_decontaminate)
_over("op5_langid", "documents")(langid.op5_langid)
_over("op6_line_dedup", "documents", oracle=OP6)(line_dedup.op6_line_dedup)
_over("op7_warc", "pages", oracle=OP7)(warc.op7_warc)
_over("op8_lm", "documents")(lm.op8_lm)
_over("op9_quality_rules", "documents", oracle=OP9)(quality_rules.op9_quality_rules)
_over("op10_minhash", "documents")(minhash.op10_minhash)
_over("op11_hard_negatives", "embeddings", oracle=OP11)(negatives.op11_hard_negatives)
_over("op12_conversations", "conversations")(conversations.op12_conversations)
_over("op13_packing", "documents")(packing.op13_packing)

"""Scalars for task log lines and queue reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, first_match, trim_u

# Harmless log lines.
NOISE = [
    "No ccache found", "warnings.warn", "UserWarning", "提供的模式无法找到文件",
    "Model files already exist", "To redownload, please delete",
]

# Stages in order, with the line prefixes that announce them.
STAGE_PREFIXES = {
    "convert": ["converting", "converted "],
    "detect": ["detecting layout", "layout detection complete"],
    "ocr": ["ocr (", "grounded ocr ("],
    "refine": ["refining boxes"],
    "embed": ["done", "writing output"],
}

QUEUE_ITEM = (
    "struct<md5:string,failed_at:string,status:string,error:string,error_message:string,"
    "status_message:string,message:string>"
)
QUEUE_SCHEMA = f"struct<current:{QUEUE_ITEM},queue:array<{QUEUE_ITEM}>,recent_history:array<{QUEUE_ITEM}>>"


def is_noise(c) -> Column:
    c = _col(c)
    hit = F.lit(False)
    for text in NOISE:
        hit = hit | F.contains(c, F.lit(text))
    return hit


def parse_progress(c, total_pages=None) -> Column:
    """struct(cur, tot) of a progress line; NULL fields when the line shows none.

    With a known total, a lone ``[n]`` wins over everything but ``[a/b]``; then ``n [tesseract]``,
    ``Page a of b`` and ``[a/b]``, the later message of one line overriding the earlier one.
    """
    line = _col(c)
    total = F.lit(0) if total_pages is None else _col(total_pages)
    a, b = first_match(line, "\\[(\\d+)/(\\d+)\\]", 1), first_match(line, "\\[(\\d+)/(\\d+)\\]", 2)
    lone = F.when(total > 0, first_match(line, "\\[(\\d+)\\]", 1))
    page = "(?U)[Pp]age\\s+(\\d+)\\s+[oO]f\\s+(\\d+)"
    pa, pb = first_match(line, page, 1), first_match(line, page, 2)
    tess = F.when(total > 0, first_match(line, "(?U)^\\s*(\\d+)\\s+\\[tesseract\\]", 1))
    use_lone = a.isNull() & lone.isNotNull()
    cur = F.when(use_lone, lone).otherwise(F.coalesce(tess, pa, a))
    tot = F.when(use_lone | tess.isNotNull(), total.cast("string")).otherwise(F.coalesce(pb, b))
    return F.struct(cur.try_cast("bigint").alias("cur"), tot.try_cast("bigint").alias("tot"))


def parse_stage(c) -> Column:
    """struct(stage, pct, page, total, overall) of a stage line, NULL when it reports no stage progress."""
    text = trim_u(c)
    low = F.lower(text)
    stage, index = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, prefixes) in reversed(list(enumerate(STAGE_PREFIXES.items()))):
        starts = F.lit(False)
        for p in prefixes:
            starts = starts | low.startswith(p)
        stage, index = F.when(starts, name).otherwise(stage), F.when(starts, i).otherwise(index)
    shown = first_match(text, "(\\d+)%", 1).try_cast("int")
    finished = F.contains(low, F.lit("complete")) | F.contains(low, F.lit("done")) | F.contains(low, F.lit("converted"))
    pct = F.when(shown.isNotNull(), shown).when(finished, F.lit(100))
    counted = F.when(shown.isNotNull(), text)
    overall = F.lit(10) + F.floor((index + pct / F.lit(100.0)) / 5 * 80).cast("int")
    return F.when(
        stage.isNotNull() & pct.isNotNull(),
        F.struct(
            stage.alias("stage"), pct.alias("pct"),
            first_match(counted, "\\((\\d+)/(\\d+)\\)", 1).try_cast("int").alias("page"),
            first_match(counted, "\\((\\d+)/(\\d+)\\)", 2).try_cast("int").alias("total"),
            overall.alias("overall"),
        ),
    )


def log_severity(c) -> Column:
    c = _col(c)

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        return hit

    return (
        F.when(has("ERROR", "error", "失败"), "error")
        .when(has("WARN"), "warn")
        .when(has("成功", "completed"), "success")
        .otherwise("info")
    )


def failure_message(status, md5) -> Column:
    """Why the item ``md5`` failed according to a queue report (JSON), NULL when it did not."""
    report, wanted = F.from_json(_col(status), QUEUE_SCHEMA), _col(md5)

    def given(c: Column) -> Column:
        return F.when(c != "", c)

    def items(name: str) -> Column:
        return F.coalesce(report[name], F.array().cast(f"array<{QUEUE_ITEM}>"))

    every = F.concat(F.array(report["current"]), items("queue"), items("recent_history"))
    failed = F.filter(
        every,
        lambda i: (i["md5"] == wanted)
        & (F.coalesce(given(i["failed_at"]), F.lit("false")).isin("false", "0").__invert__() | i["status"].eqNullSafe("failed")),
    )
    messages = F.transform(
        failed,
        lambda i: F.coalesce(
            given(i["error"]), given(i["error_message"]), given(i["status_message"]), given(i["message"]),
            F.lit("unknown error"),
        ),
    )
    return F.get(messages, 0)

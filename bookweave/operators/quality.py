"""Verdicts on text layers and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cjk_ratio, nonspace_count


def scanned_verdict(pages: DataFrame, n: int = 5, mode: str = "strict") -> DataFrame:
    """(doc_id, blanks, scanned): is the text layer of the first ``n`` pages mostly blank?

    ``strict`` needs 60 % of n blank pages, ``adaptive`` 60 % of min(n, pages).
    """
    text = F.coalesce("text", F.lit(""))
    blank = (F.length(text) == 0) | (nonspace_count(text) < F.length(text) * 0.6)
    sample = pages.filter(F.col("page_no") < n).select("doc_id", blank.cast("bigint").alias("_blank"))
    blanks, seen = F.sum("_blank"), F.count("*")
    needed = F.lit(n * 0.6) if mode == "strict" else seen * 0.6
    return sample.groupBy("doc_id").agg(blanks.alias("blanks"), (blanks >= needed).alias("scanned"))


def readable_verdict(pages: DataFrame, n: int = 5, min_cjk: float = 0.15) -> DataFrame:
    """(doc_id, readable, ok): are ``n`` pages spread over the document readable Chinese text?

    Short documents probe the same page several times and count it each time.
    """
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("_total"))
    probes = (
        totals.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(F.col("_total") * i / (n + 1)))).alias("page_no"))
        .groupBy("doc_id", "page_no").agg(F.count("*").alias("_times"))
    )
    good = pages.join(probes, ["doc_id", "page_no"]).select(
        "doc_id", F.when(cjk_ratio(F.coalesce("text", F.lit(""))) >= min_cjk, F.col("_times")).otherwise(0).alias("_good")
    )
    counted = good.groupBy("doc_id").agg(F.sum("_good").alias("readable"))
    return counted.select("doc_id", "readable", (F.col("readable") >= n * 0.6).alias("ok"))


def size_saving(df: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """Bytes before and after per group, and the share saved in per cent with one decimal."""
    out = df.groupBy(*keys).agg(F.sum(before).alias("before"), F.sum(after).alias("after"))
    return out.withColumn("saved_pct", F.bround((F.lit(1.0) - F.col("after") / F.col("before")) * 100, 1))

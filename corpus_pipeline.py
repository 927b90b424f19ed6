"""Corpus pipeline: documents in, training tokens out.  Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm import decontaminate, line_dedup, minhash, pieces, quality_rules
from bookweave.llm.shared import written


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    verdict = _free(docs, "_kept")
    judged = quality_rules.cascade(docs, verdict=verdict)
    return judged.where(F.col(verdict)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id holds; n_chars follows."""
    kept = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it; columns with the results' names are replaced."""
    docs = docs.drop("token_ids", "n_tokens", "round_trip")
    back = _free(docs, "_back")
    both = pieces.decode(pieces.encode(docs), to=back)
    same = (F.col(back) == F.coalesce("text", F.lit(""))).alias("round_trip")
    return both.select(*(c for c in docs.columns if c != "text"), F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]
#: The stages of 10, 4 and 2 are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Auditing stored files and naming finished ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import apply_template, final_name, size_match


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def audit_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Verdict per file of ``binaryFile`` rows against (name, md5, bytes).

    A missing or malformed digest passes, as does an unknown size; a file must exceed 1024 bytes and,
    if named .pdf, start with %PDF.
    """
    name = F.element_at(F.split("path", "/"), -1)
    facts = files.select(
        name.alias("name"), F.col("length").alias("bytes"),
        (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"), F.md5("content").alias("digest"),
    )
    want = expected.select("name", F.lower("md5").alias("_md5"), F.col("bytes").alias("_bytes"))
    m = facts.join(want, "name", "left").withColumn("_size", size_match("bytes", F.col("_bytes")))
    digest_ok = F.coalesce(F.length("_md5") != 32, F.lit(True)) | (F.col("digest") == F.col("_md5"))
    pdf_ok = ~F.lower("name").endswith(".pdf") | F.col("is_pdf")
    ok = (F.col("bytes") > 1024) & digest_ok & pdf_ok & F.col("_size.ok")
    return m.select(
        "name", "bytes", "is_pdf", "digest", F.col("_size.level").alias("size_class"),
        F.when(ok, "ok").otherwise("mismatch").alias("verdict"),
    )


def output_name(df: DataFrame, template: str, fields: dict[str, str], out: str = "output_name", normalize: bool = True) -> DataFrame:
    """Template name of every row, else its final name."""
    columns = {k: F.col(v) for k, v in fields.items()}
    return df.withColumn(
        out,
        F.coalesce(
            apply_template(template, columns, normalize),
            final_name(columns["ss_code"], columns["title"], F.lit(False), F.lit(False)),
        ),
    )

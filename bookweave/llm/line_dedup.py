"""Line de-duplication across documents (DataFrame functions only).

A line's key is the line without white space at both ends, A-Z in lower case.  The 128-bit hashes of the
keys, with document and position, are range-partitioned and sorted, so that each partition streams its keys'
lines in order of document and position and sees the first occurrence first.  The range also covers a salt
taken from the document, so the lines of one very common key are dealt to many partitions, each of which
finds its own first; the firsts of the partitions (a row for each key and salt) settle the first of all.
The result is a bitmap of kept lines for each document, not text; ``keep_lines`` applies it.

Defined results: null or empty text is one empty line; a null ``doc_id`` takes no part and keeps all of its
lines; rows that share ``doc_id`` count as one document (a bitmap belongs to doc_id and text); other columns
are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
P = "_ld_"
#: Lines to a word of the bitmap.
BITS = 32


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; ``lower`` does the same where there are only ASCII characters, and is faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos and the key's hashes h1, h2 for each line long enough to be compared."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACE)))).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drop_rows(docs: DataFrame, min_chars: int = 10, salts: int | None = None) -> DataFrame:
    """doc_id, text_hash and pos of each line whose key occurs in a document with a smaller id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or max(parts, 8)
    # Written once: the range bounds, the firsts and the lines themselves are read from it.
    rows = written(line_rows(docs, min_chars), "line-hashes").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    dealt = rows.repartitionByRange(parts, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    seen = dealt.withColumn("n", F.row_number().over(stream)).withColumn("own_first", F.first("doc_id").over(stream))
    firsts = seen.where("n = 1").select("h1", "h2", "salt", "doc_id")
    of_key = Window.partitionBy("h1", "h2")
    heads = (
        firsts.withColumn("first_doc", F.min("doc_id").over(of_key))
        .withColumn("more", F.count("*").over(of_key))
        .select("h1", "h2", "salt", "first_doc", "more")
    )
    # With one salt the partition's own first decides; only keys met in several salts need the others'.
    inner = seen.where("doc_id > own_first").select("doc_id", "text_hash", "pos")
    outer = (
        seen.where("doc_id = own_first")
        .join(heads.where("more > 1").drop("more"), ["h1", "h2", "salt"])
        .where("doc_id > first_doc")
        .select("doc_id", "text_hash", "pos")
    )
    return inner.union(outer)


def line_bitmaps(docs: DataFrame, min_chars: int = 10, salts: int | None = None) -> DataFrame:
    """doc_id, text_hash, drops: for each document that loses lines, its bitmap as (word, bits) for every
    word with a dropped line; all other lines are kept.  Bit ``pos % 32`` of word ``pos div 32``."""
    words = (
        drop_rows(docs, min_chars, salts)
        .groupBy("doc_id", "text_hash", F.expr(f"pos div {BITS}").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pos % {BITS} AS INT))")).alias("bits"))
    )
    return words.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("word", "bits")).alias("drops"))


def _dropped(drops: Column) -> Column:
    """Positions set in a bitmap."""
    bit = lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(w["bits"], b) == 1),
        lambda b: (w["word"] * BITS + b).cast("int"),
    )
    return F.flatten(F.transform(drops, bit))


def keep_lines(docs: DataFrame, bitmaps: DataFrame, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with the kept lines as ``text``; ``n_lines`` and ``n_dropped`` name optional counts.

    A text that loses nothing stays as it is (null too)."""
    own = bitmaps.select(F.col("doc_id").alias(P + "id"), F.col("text_hash").alias(P + "hash"), F.col("drops").alias(P + "drops"))
    df = docs.withColumn(P + "text_hash", F.xxhash64("text"))
    df = df.join(own, (df["doc_id"] == own[P + "id"]) & (df[P + "text_hash"] == own[P + "hash"]), "left")
    df = df.withColumn(P + "lines", lines_of(F.col("text"))).withColumn(P + "n", F.size(P + "lines"))
    df = df.withColumn(P + "gone", F.when(F.col(P + "drops").isNotNull(), _dropped(F.col(P + "drops"))))
    left = F.array_except(F.sequence(F.lit(0), F.col(P + "n") - 1), P + "gone")
    df = df.withColumn(P + "left", F.when(F.col(P + "gone").isNotNull(), left))
    text = F.array_join(F.transform(P + "left", lambda i: F.get(P + "lines", i)), "\n")
    counts = []
    if n_lines:
        counts.append(F.col(P + "n").cast("long").alias(n_lines))
    if n_dropped:
        counts.append(F.coalesce(F.array_size(P + "gone"), F.lit(0)).cast("long").alias(n_dropped))
    made = F.when(F.col(P + "left").isNotNull(), text).otherwise(F.col("text")).alias("text")
    return df.select(*(made if c == "text" else F.col(c) for c in docs.columns), *counts)


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    kept = keep_lines(docs, line_bitmaps(docs), "n_lines", "n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))

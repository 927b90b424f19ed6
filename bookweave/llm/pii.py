"""Personal data: spans by pattern, and terms that give a protected entity away (DataFrame functions only).

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Their values are the protected
entities.  A term (word without the signs around it, A-Z in lower case) that shares lines with an entity
discloses PMI(term; entity) / IC(entity) of it, by documents: log(n_te N / (n_t n_e)) / log(N / n_e), where 1
means that the term never occurs without the entity.  Terms at or above ``disclosure`` that share at least
``least`` different lines with the entity are spans too, in every document: where the entity itself is absent
they reveal it all the same.  ``sanitise`` replaces base spans by their kind, which generalises them, and
removes disclosing terms.

Defined results: null text counts as empty; rows with a null doc_id take no part in co-occurrence; rows that
share doc_id count as one document for it; repeated lines count once; an empty table gives an empty
result.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Fixed patterns of the base kinds, in their order.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The same matches, found without trying each place of a long run: a match begins where a run does or where
#: the last match ended.  Chains of digits have 12 to 19 of them here, as shorter and longer ones fail.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": PHONE,
}
KINDS = ("email", "ip", "card", "phone", "term")
P = "_pii_"
SPACES = r"[\x20\x09-\x0D]+"
SIGNS = ".,;:!?()[]{}\"'<>*_"


def found(text: Column, pattern: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (start, rank, end, kind, value)."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(values) > 0, F.aggregate(pairs, seed, step, lambda acc: acc["out"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    """Whether a match of a kind counts."""

    def part(p: Column) -> Column:
        bare = F.ltrim(p, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    def valid(span: Column) -> Column:
        digits = _digits(span["value"])
        if kind == "ip":
            return F.forall(F.split(span["value"], r"\."), part)
        if kind == "card":
            return F.length(digits).between(12, 19) & luhn(digits)
        return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)

    return valid


def _holds() -> dict[str, Column]:
    """For each base kind a cheap condition that a text with such a span meets."""
    text = F.coalesce("text", F.lit(""))
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+")}


def may_hold() -> Column:
    return reduce(or_, _holds().values())


def with_base_spans(df: DataFrame) -> DataFrame:
    """``df`` with an array of valid base spans of each kind (null where a text has none), prefix ``_pii_``."""
    text, holds = F.coalesce("text", F.lit("")), _holds()
    for kind in KINDS[:4]:
        df = df.withColumn(P + kind + "_all", F.when(holds[kind], found(text, F.lit(FAST[kind]), kind)))
        df = df.withColumn(P + kind, F.filter(P + kind + "_all", _valid(kind))).drop(P + kind + "_all")
    return df


def _term(word: Column) -> Column:
    bare = F.btrim(word, F.lit(SIGNS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, SPACES), _term), lambda t: t != ""))


def disclosing_terms(docs: DataFrame, disclosure: float = 0.9, least: int = 3) -> DataFrame:
    """The different terms that disclose an entity."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    every = F.flatten(F.array_compact(F.array(*(P + k for k in KINDS[:4]))))
    entities = with_base_spans(docs.where(may_hold())).withColumn("spans", every).where(F.size("spans") > 0)
    lines = entities.select("doc_id", "spans", F.explode(F.split("text", "\n")).alias("line"))
    near = lines.select("doc_id", "line", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("entity")).where(F.col("line").contains(F.col("entity")))
    # Combined before the shuffle: documents and different lines of each entity.
    of_entity = near.groupBy("entity").agg(F.countDistinct("doc_id").alias("n_e"), F.countDistinct(F.xxhash64("line")).alias("lines"))
    wide = of_entity.where((F.col("lines") >= least) & (F.col("n_e") > 1)).select("entity", "n_e")
    shared = near.join(wide, "entity").select("doc_id", "entity", "n_e", F.xxhash64("line").alias("line_hash"), F.explode(_terms(F.col("line"))).alias("term"))
    shared = shared.where(~F.col("entity").contains(F.col("term")) & ~F.col("term").contains(F.col("entity")))
    joint = shared.groupBy("entity", "term").agg(F.countDistinct("doc_id").alias("n_te"), F.countDistinct("line_hash").alias("lines"), F.first("n_e").alias("n_e"))
    joint = joint.where(F.col("lines") >= least)
    seen = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("term_hash")).agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("total"))
    measured = joint.withColumn("term_hash", F.xxhash64("term")).join(seen, "term_hash").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("n_te") * F.col("total") / (F.col("n_t") * F.col("n_e")))
    ic = F.log(F.col("total") / F.col("n_e"))
    return measured.where((ic > 0) & (pmi >= disclosure * ic)).select("term").distinct()


def _row_key() -> Column:
    """What rows are joined by.  Rows that share it share their lists of terms, of which each has its own marked."""
    return F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))


def held_terms(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """For the row keys of all documents that hold any of the terms ``telling``: an array of these."""
    own = docs.select(_row_key().alias(P + "key"), F.explode(_terms(F.col("text"))).alias("term"))
    # Both tables are written, so Spark knows how small they are before it moves a text or its terms.
    found = own.join(written(telling, "disclosing-terms"), "term")
    return written(found.groupBy(P + "key").agg(F.sort_array(F.collect_set("term")).alias(P + "terms")), "held-terms")


def find_spans(docs: DataFrame, disclosure: float = 0.9, least: int = 3) -> DataFrame:
    """``docs`` (doc_id, text) with the arrays of base spans and of ``_pii_term`` spans."""
    terms = held_terms(docs, disclosing_terms(docs, disclosure, least))
    both = with_base_spans(docs).withColumn(P + "key", _row_key()).join(terms, P + "key", "left")
    # A sign that a term may hold is quoted; a word is a term with signs around it.
    quoted = F.array_join(F.transform(P + "terms", lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), "|")
    edge = r"\x20\x09-\x0D" + "".join("\\" + s for s in SIGNS if s != "_") + "_"
    pattern = F.concat(F.lit(rf"(?i)(?<![^{edge}])(?:"), quoted, F.lit(rf")(?![^{edge}])"))
    return both.withColumn(P + "term", F.when(F.size(P + "terms") > 0, found(F.coalesce("text", F.lit("")), pattern, "term"))).drop(P + "key", P + "terms")


def _sorted(kinds: tuple[str, ...]) -> Column:
    return F.sort_array(F.flatten(F.array_compact(F.array(*(P + k for k in kinds)))))


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start and then kind."""
    return F.array_join(F.transform(_sorted(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, disclosure: float = 0.9, least: int = 3) -> DataFrame:
    """``docs`` with base spans replaced by ``[KIND]`` and disclosing terms removed; null stays null."""
    text = F.col("text")
    seed = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag)
        after = s["start"] >= acc["at"]
        return F.struct(F.when(after, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"), F.when(after, piece).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    spans = find_spans(docs, disclosure, least).withColumn(P + "all", _sorted(KINDS))
    clean = F.when(F.size(P + "all") > 0, F.aggregate(P + "all", seed, step, end)).otherwise(text).alias("text")
    return spans.select(*(clean if c == "text" else F.col(c) for c in docs.columns))


def op3_pii(docs: DataFrame) -> DataFrame:
    spans = find_spans(docs.select("doc_id", "text"))
    n = lambda k: F.coalesce(F.array_size(P + k), F.lit(0)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(joined(KINDS[:4]), 256).alias("base_sha256"), joined(KINDS).alias("spans"), n("term"))

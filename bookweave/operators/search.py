"""Catalog search, de-duplication and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_literal, nonempty, trim_u
from .ordered import top_per_group

# Names a search field may be given by.
FIELDS = {
    "title": "title", "author": "author", "publisher": "publisher", "isbn": "isbn",
    "sscode": "ss_code", "ss_code": "ss_code", "book_id": "ss_code",
}
FOREIGN_FORMATS = [".epub", ".mobi", ".azw", ".djvu"]


def _field(name: str) -> Column:
    if name not in FIELDS:
        raise ValueError(f"unknown search field: {name}")
    return F.col(FIELDS[name])


def field_contains(field: str, query: str, wildcard: bool = False) -> Column:
    """Case-insensitive substring condition; ``wildcard=True`` keeps % and _ of the query live."""
    pattern = query if wildcard else like_literal(query)
    return F.coalesce(F.lower(_field(field)).like(f"%{pattern.lower()}%"), F.lit(False))


def field_equals(field: str, query: str) -> Column:
    return F.coalesce(F.lower(trim_u(_field(field))) == query.strip().lower(), F.lit(False))


def search_field(df: DataFrame, field: str, query: str, wildcard: bool = False) -> DataFrame:
    return df.filter(field_contains(field, query, wildcard))


def search_exact(df: DataFrame, field: str, query: str) -> DataFrame:
    return df.filter(field_equals(field, query))


def search_advanced(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Left fold of condition rows ``{field, query, fuzzy, logic}``; blank queries are dropped."""
    rows = [r for r in rows if r.get("query", "").strip()]
    if not rows:
        return df

    def condition(r: dict) -> Column:
        return (field_contains if r.get("fuzzy", True) else field_equals)(r["field"], r["query"])

    def step(acc: Column, r: dict) -> Column:
        c = condition(r)
        return {"AND": acc & c, "OR": acc | c, "NOT": acc & ~c}[r.get("logic", "AND")]

    return df.filter(reduce(step, rows[1:], condition(rows[0])))


def require_title(df: DataFrame, title: str = "title") -> DataFrame:
    return df.filter(nonempty(title).isNotNull())


def keep_format(df: DataFrame, fmt: str = "pdf", title: str = "title", format_col: str = "format") -> DataFrame:
    """Rows of the wanted format; rows without a format pass unless the title names another one."""
    given = F.lower(F.coalesce(F.col(format_col), F.lit("")))
    lowered = F.lower(F.coalesce(F.col(title), F.lit("")))
    foreign = reduce(lambda a, e: a | F.contains(lowered, F.lit(e)), FOREIGN_FORMATS, F.lit(False))
    return df.filter((given == fmt) | ((given == "") & ~foreign))


# ---------------------------------------------------------------- de-duplication


def dedupe_books(df: DataFrame, order: list[str], isbn: str = "isbn", code: str = "ss_code") -> DataFrame:
    """First row per (isbn, code); rows without isbn always stay and are never shuffled."""
    has = nonempty(isbn).isNotNull()
    first = top_per_group(df.filter(has), [isbn, code], [F.col(o) for o in order])
    return first.unionByName(df.filter(~has))


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order."""
    return top_per_group(df, key, [F.col(o) for o in order])


def tiered_candidates(df: DataFrame, id_col: str = "book_id", keys: list[str] | None = None) -> DataFrame:
    """Candidates of all search tiers, each id kept from its first tier.

    Expects ``tier`` (1 isbn, 2 title+author, 3 title), ``rank``, ``hash`` and the request's ``req_isbn``
    and ``req_author``; tier 1 needs an isbn of ten or more characters, tier 2 an author.
    """
    usable = (
        nonempty(id_col).isNotNull()
        & nonempty("hash").isNotNull()
        & ((F.col("tier") != 1) | (F.length(F.coalesce("req_isbn", F.lit(""))) >= 10))
        & ((F.col("tier") != 2) | nonempty("req_author").isNotNull())
    )
    strategy = F.when(F.col("tier") == 1, "isbn").when(F.col("tier") == 2, "title_author").otherwise("title_only")
    return top_per_group(
        df.filter(usable).withColumn("strategy", strategy), [*(keys or []), id_col], [F.col("tier"), F.col("rank")]
    )


def union_external(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- counts and pages


def search_counts(df: DataFrame) -> DataFrame:
    """Matches per source, plus a row for all sources."""
    return df.rollup("source").agg(F.count("*").alias("n")).select(
        F.coalesce("source", F.lit("total")).alias("source"), "n"
    )


def page_summary(df: DataFrame, page_size: int) -> DataFrame:
    n = F.count("*")
    return df.agg(
        n.alias("total"), F.greatest(F.lit(1), F.ceil(n / page_size)).cast("bigint").alias("total_pages")
    )


def page_global(df: DataFrame, page: int, size: int, order: list[str]) -> DataFrame:
    """One page of the whole result in (source, id) order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_per_source(df: DataFrame, page: int, size: int, sources: list[str], order: list[str]) -> DataFrame:
    """Legacy paging: the same offset in every source, later sources fill what earlier ones left."""
    parts = [
        df.filter(F.col("source") == s).orderBy(*order).offset((page - 1) * size).limit(size).withColumn("_place", F.lit(i))
        for i, s in enumerate(sources)
    ]
    return union_catalogs_(parts).orderBy("_place", *order).limit(size).drop("_place")


def union_catalogs_(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

"""Merging the contents lists of a book from several sources, first title wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty, title_key, trim_u
from .ordered import top_per_group

#: Titles that one task compares with each other, and the parts of a long book's join with its own size.
BLOCK, SALTS = 512, 64
ORDER = ["source_rank", "seq"]
PLACE = [*ORDER, "_key"]


def same_title(new: Column, kept: Column) -> Column:
    """One title contains the other, or over 0.8 of either are characters of ``new`` that ``kept`` has.

    A contained title shares all its characters, so the share of the shorter title decides (an empty one is
    contained in all)."""
    common = F.length(new) - F.length(F.call_function("translate", new, kept, F.lit("")))
    shorter = F.least(F.length(new), F.length(kept))
    return (shorter == 0) | (common > shorter * 0.8)


def same_titles(new: list[str], kept: list[str]) -> np.ndarray:
    """``same_title`` of every new with every kept title: how many characters of one another has is a product
    of its counts with the other's set."""
    points = [np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32) for keys in (new, kept)]
    sizes = [np.array([len(k) for k in keys], np.int64) for keys in (new, kept)]
    alphabet = np.unique(np.concatenate(points))
    counts = [np.zeros((len(s), len(alphabet)), np.float32) for s in sizes]
    for c, p, s in zip(counts, points, sizes, strict=True):
        np.add.at(c, (np.repeat(np.arange(len(s)), s), np.searchsorted(alphabet, p)), 1)
    common = (counts[0] @ (counts[1] > 0).astype(np.float32).T).astype(np.int64)
    shorter = np.minimum(sizes[0][:, None], sizes[1][None, :])
    return (shorter == 0) | (common > shorter * 0.8)


def _folded(left: DataFrame) -> DataFrame:
    """Of every book, small as it must be, its titles in order (``_rows``) and those of them that are kept (``_added``)."""
    rows = F.sort_array(F.collect_list(F.struct(*PLACE, "title", "page")))
    kind = "array<struct<" + ",".join(f"{c}:{t}" for c, t in left.select(*PLACE, "title", "page").dtypes) + ">>"
    keep = F.aggregate(
        F.col("_rows"),
        F.array().cast(kind),
        lambda acc, t: F.when(F.exists(acc, lambda k: same_title(t["_key"], k["_key"])), acc).otherwise(F.array_append(acc, t)),
    )
    return left.groupBy("doc_id").agg(rows.alias("_rows")).select("doc_id", "_rows", keep.alias("_added"))


def _fold(left: DataFrame) -> DataFrame:
    """Of every book's first BLOCK titles those that are kept, the last of them, and whether there are so many."""
    last = F.element_at("_rows", -1)
    return _folded(top_per_group(left, ["doc_id"], [F.col(o) for o in PLACE], BLOCK)).select(
        "doc_id", "_added", F.struct(*[last[o].alias(o) for o in PLACE]).alias("_last"), (F.size("_rows") == BLOCK).alias("_full")
    )


def _unlike(left: DataFrame, folded: DataFrame) -> DataFrame:
    """Titles behind the first ones of long books that resemble none kept so far, with the number of blocks of
    their book (``_blocks``) and their own (``_b``)."""
    # Asking for a whole row lets the count read the exchange that the fold and the titles read.
    sizes = left.groupBy("doc_id").agg(F.count("*").alias("_n"), F.any_value(F.struct(*left.columns)).alias("_any"))
    blocks = sizes.filter("_any IS NOT NULL").select(F.struct("doc_id").alias("_group"), F.ceil(F.col("_n") / BLOCK).cast("long").alias("_blocks"))
    full = folded.filter("_full").select(F.struct("doc_id").alias("_group"), "_last", F.transform("_added", lambda k: k["_key"]).alias("_kept")).join(blocks, "_group")
    salts = full.select("_group", "_last", "_blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = left.withColumns({"_group": F.struct("doc_id"), "_salt": F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")})
    behind = salted.join(salts, ["_group", "_salt"]).filter(F.struct(*PLACE) > F.col("_last"))
    behind = behind.select("_group", *PLACE, "title", "page", "_blocks", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("_blocks")).alias("_b"))
    kept = full.select(F.col("_group").alias("_of"), F.col("_kept"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_k"))

    def strike(new: pa.Table, kept: pa.Table) -> pa.Table:
        if not new.num_rows or not kept.num_rows:
            return new.slice(0, 0)
        return new.filter(pa.array(~same_titles(new["_key"].to_pylist(), kept["_kept"][0].as_py()).any(axis=1)))

    return behind.groupBy("_group", "_b").cogroup(kept.groupBy("_of", "_k")).applyInArrow(strike, behind.schema)


def _places(table: pa.Table) -> list[tuple]:
    return list(zip(*(table[c].to_pylist() for c in PLACE), strict=True))


def _cells(rows: DataFrame, make, result: str) -> DataFrame:
    """``make`` over all pairs of blocks of each book: any two titles of a book meet in one cell.

    ``make`` gets a cell's titles, in order, and which of them (columns) comes before a title (rows) and is
    like it; it returns a table of its ``result``, a row for each title."""
    met = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cells = met.withColumns({"_i": F.least("_b", "_c"), "_j": F.greatest("_b", "_c")}).drop("_c")

    names, kinds = rows.columns, ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def each(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(sorted(range(table.num_rows), key=_places(table).__getitem__), pa.int64()))
        keys, block = table["_key"].to_pylist(), table["_b"].to_numpy()
        alike = np.zeros((len(keys), len(keys)), bool)
        sides = [np.flatnonzero(block == x) for x in np.unique(block)]
        if table["_i"][0].as_py() == table["_j"][0].as_py():
            alike = np.tril(same_titles(keys, keys), -1)
        elif len(sides) == 2:  # those of one block meet in its own cell
            for new, kept in (sides, sides[::-1]):
                found = same_titles([keys[i] for i in new], [keys[i] for i in kept])
                alike[np.ix_(new, kept)] = found & (new[:, None] > kept[None, :])
        made = make(table, alike)
        for c in names:
            made = made.append_column(c, table[c])
        return made

    return cells.groupBy("_group", "_i", "_j").applyInArrow(each, f"{result}, {kinds}")


def _settled(rows: DataFrame) -> DataFrame:
    """The kept ones of titles of which nothing is known yet.

    Titles that nothing before is like are kept; what is like one of them goes.  The few others get the list
    of titles before them that they are like, and one pass in order settles each by those settled before."""
    link = "struct<" + ", ".join(f"{c}: {dict(rows.dtypes)[c]}" for c in PLACE) + ">"
    rest = {c: F.any_value(c).alias(c) for c in ("title", "page", "_blocks", "_b")}

    def flag(table: pa.Table, alike: np.ndarray) -> pa.Table:
        return pa.table({"_followed": alike.any(axis=1)})

    def links(table: pa.Table, alike: np.ndarray) -> pa.Table:
        root = table["_root"].to_numpy()
        struck = alike[:, root].any(axis=1)
        open_ = ~root & ~struck
        alike &= open_[:, None] & open_[None, :]
        at = np.concatenate([[0], np.cumsum(alike.sum(axis=1))]).astype(np.int32)
        before = table.select(PLACE).take(pa.array(np.nonzero(alike)[1])).combine_chunks()
        named = pa.StructArray.from_arrays([before[c].combine_chunks() for c in PLACE], fields=[table.schema.field(c) for c in PLACE])
        return pa.table({"_struck": struck, "_links": pa.ListArray.from_arrays(pa.array(at), named)})

    seen = _cells(rows, flag, "_followed boolean").groupBy("_group", *PLACE)
    marked = seen.agg(*rest.values(), (~F.bool_or("_followed")).alias("_root"))
    found = _cells(marked, links, f"_struck boolean, _links array<{link}>").groupBy("_group", *PLACE)
    left = found.agg(rest["title"], rest["page"], F.bool_or("_struck").alias("_struck"), F.flatten(F.collect_list("_links")).alias("_links")).filter("NOT _struck")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = left.drop("_struck").repartition(parts, "_group").sortWithinPartitions("_group", *PLACE)
    result = ["_group", *ORDER, "title", "page"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, set()
        for batch in batches:
            keep = []
            for g, place, before in zip(batch.column("_group").to_pylist(), _places(batch), batch.column("_links").to_pylist(), strict=True):
                if g != group:
                    group, kept = g, set()
                keep.append(not any(tuple(b[c] for c in PLACE) in kept for b in before))
                if keep[-1]:
                    kept.add(place)
            yield batch.select(result).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(settle, ordered.select(*result).schema)


def merge_tocs(tocs: DataFrame) -> DataFrame:
    """One contents list per book from several sources (doc_id, source_rank, seq, title, page).

    A title is dropped when it resembles one already kept.  Pages survive from the first source only.
    A book of up to BLOCK titles is one fold, for which its rows are grouped once; copies of a title fall to their first.
    Of longer books (and of the rows without a book) copies go first, the first BLOCK titles are a fold, the others are
    struck where they resemble what it kept, and what is left is compared in cells of two blocks and settled by the
    titles before.  All of it is one plan, whatever the sizes of books; only the last pass over the links of
    unsettled titles is in order of the book.
    """
    named = tocs.filter(nonempty("title").isNotNull())
    keyed = named.withColumn("_key", title_key(trim_u("title"))).select("doc_id", *PLACE, "title", "page")
    long = named.groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK).select("doc_id")
    short = _folded(keyed.filter("doc_id IS NOT NULL").join(long, "doc_id", "left_anti"))
    of_long = keyed.join(long, "doc_id", "left_semi").unionByName(keyed.filter("doc_id IS NULL"))
    # Dealt here, so that all that reads the titles below reads this one exchange.
    left = top_per_group(of_long.repartition("doc_id", "_key"), ["doc_id", "_key"], [F.col(o) for o in ORDER])
    folded = _fold(left)
    tail = _settled(_unlike(left, folded)).select("_group.doc_id", *ORDER, "title", "page")
    kept = short.select("doc_id", "_added").unionByName(folded.select("doc_id", "_added")).select("doc_id", F.inline("_added"))
    return kept.select(*tail.columns).unionByName(tail).withColumn("page", F.when(F.col("source_rank") == 0, F.col("page")))

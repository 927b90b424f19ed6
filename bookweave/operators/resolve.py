"""Resolving requests against a catalog and filling their gaps from other sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import isbn_norm, main_title, nonempty, title_relevance, title_similarity
from .ordered import top_per_group

#: Lengths of the pieces that needles are looked up by: each needle by pieces of the longest that it can have.
SIZES = (1, 2, 4, 8)
#: Bits of the filter of asked pieces, and the parts that each posting list is dealt into.
BITS, SALTS = 1 << 22, 8


# ---------------------------------------------------------------- substring join


def _grams(c: Column, n: Column) -> Column:
    """Distinct substrings of length ``n``."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, n))))


def asked_only(df: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` that may have a partner in ``asked`` by ``keys``, before anything is shuffled.

    The keys asked for set bits of a filter of BITS bits, one value whatever their number."""
    place = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    own = asked.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b"))
    every = asked.sparkSession.range(BITS // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = own.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = words.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("s")).select(F.col("s.b")).scalar()
    at = df.withColumn("_p", place)
    return at.filter(F.getbit(F.get(bits, F.shiftright("_p", 6).cast("int")), F.expr("CAST(_p & 63 AS INT)")) == 1).drop("_p")


def contains_join(needles: DataFrame, hay: DataFrame, needle: str, text: str) -> DataFrame:
    """All (needle, text) pairs of two single-column frames where the text contains the needle.

    Exact.  Every needle is looked up by one of its pieces, the one that the fewest needles share.  Of the
    texts' pieces only those that pass a filter of the picked ones (of a fixed size) are posted; a posting list
    is dealt into SALTS parts, so one piece in very many texts is not one task.  The pairs that meet are
    compared.  Both sides should hold distinct values: copies are joined back afterwards.
    """
    size = F.lit(SIZES[0])
    for n in SIZES[1:]:
        size = F.when(F.length(needle) >= n, n).otherwise(size)
    asked = needles.filter(F.length(needle) > 0).select(needle, F.explode(_grams(F.col(needle), size)).alias("_gram"))
    shared = asked.groupBy("_gram").agg(F.count("*").alias("_n"))
    picked = asked.join(shared, "_gram").groupBy(needle).agg(F.min(F.struct("_n", "_gram")).alias("_pick")).select(needle, "_pick._gram")
    none = F.array().cast("array<string>")
    every = F.flatten(F.transform(F.array(*map(F.lit, SIZES)), lambda n: F.coalesce(_grams(F.col(text), n), none)))
    posted = asked_only(hay.select(text, F.explode(every).alias("_gram")), picked, ["_gram"])
    posted = posted.select(text, "_gram", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int").alias("_salt"))
    looked = picked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return posted.join(looked, ["_gram", "_salt"]).filter(F.contains(F.col(text), F.col(needle))).select(needle, text)


HIT = ["id", "title", "author", "publisher", "isbn", "ss_code"]


def _first_containing(wanted: DataFrame, cat: DataFrame, field: str, k: int, order: list[str]) -> DataFrame:
    """The first ``k`` catalog rows whose field contains each wanted ``_needle``, as ``_place`` 1..k."""
    hay = cat.withColumn("_text", F.lower(field)).filter(F.col("_text") != "")
    # k rows per distinct text are enough for the first k of any needle.
    first = top_per_group(hay, ["_text"], [F.col(o) for o in order], k)
    pairs = contains_join(wanted.distinct(), first.select("_text").distinct(), "_needle", "_text")
    return top_per_group(pairs.join(first, "_text"), ["_needle"], [F.col(o) for o in order], k, "_place")


def _hit() -> Column:
    return F.struct(*HIT).alias("_hit")


def _code_hits(cat: DataFrame, order: list[str]) -> DataFrame:
    """One row per code, so a code asked for by very many requests cannot multiply."""
    first = top_per_group(cat.filter(nonempty("ss_code").isNotNull()), ["ss_code"], [F.col(o) for o in order])
    return first.select(F.col("ss_code").alias("_key"), _hit())


def _title_hits(wanted: DataFrame, cat: DataFrame, k: int | None, minimum: float, order: list[str]) -> DataFrame:
    """The most similar of all titles that contain each needle, or of the first ``k`` where k is given."""
    if k is None:
        # The similarity is the title's alone, so one row of each title is enough.
        hay = cat.withColumn("_text", F.lower("title")).filter(F.col("_text") != "")
        first = top_per_group(hay, ["title"], [F.col(o) for o in order])
        pairs = contains_join(wanted.distinct(), first.select("_text").distinct(), "_needle", "_text")
        found = pairs.join(first, "_text").withColumn("_place", F.struct(*order))
    else:
        found = _first_containing(wanted, cat, "title", k, order)
    scored = found.withColumn("similarity", title_similarity(F.col("title"), F.col("_needle")))
    best = top_per_group(scored, ["_needle"], [F.desc("similarity"), F.col("_place")])
    return best.filter(F.col("similarity") >= minimum).select(F.col("_needle").alias("_key"), _hit(), "similarity")


def _isbn_hits(wanted: DataFrame, cat: DataFrame, order: list[str]) -> DataFrame:
    return _first_containing(wanted, cat, "isbn", 1, order).select(F.col("_needle").alias("_key"), _hit())


def _code_key() -> Column:
    return nonempty("ss_code")


def _title_key() -> Column:
    return F.when(nonempty("title").isNotNull(), F.lower(main_title("title")))


def _isbn_keys() -> tuple[Column, Column]:
    """Bare digits, and the text as given where that differs."""
    bare, given = F.lower(isbn_norm("isbn")), F.lower("isbn")
    known = nonempty("isbn").isNotNull()
    return F.when(known, bare), F.when(known & (given != bare), given)


def _attach(req: DataFrame, hits: DataFrame, key: Column, row_key: str, name: str, *more: str) -> DataFrame:
    """Left join of hits by a key that may be NULL; NULL keys are spread over the cluster by row key."""
    spread = F.coalesce(key, F.concat(F.lit("\u0000"), F.col(row_key).cast("string")))
    right = hits.select("_key", F.col("_hit").alias(name), *more)
    return req.withColumn("_at", spread).join(right, F.col("_at") == F.col("_key"), "left").drop("_at", "_key")


def _unpack(df: DataFrame, req: DataFrame, name: str, *more: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull()).select(*req.columns, *more, *[F.col(name)[c].alias(f"hit_{c}") for c in HIT])


def lookup_code(req: DataFrame, cat: DataFrame, key: str = "req_id", order: list[str] = ["id"]) -> DataFrame:
    """Requests with the first catalog row of the same code."""
    return _unpack(_attach(req, _code_hits(cat, order), _code_key(), key, "_c"), req, "_c")


def lookup_title(
    req: DataFrame, cat: DataFrame, key: str = "req_id", k: int | None = None, minimum: float = 0.4, order: list[str] = ["id"]
) -> DataFrame:
    """Requests with the most similar catalog row whose title contains their main title."""
    wanted = req.select(_title_key().alias("_needle")).filter(F.col("_needle") != "")
    hits = _title_hits(wanted, cat, k, minimum, order)
    return _unpack(_attach(req, hits, _title_key(), key, "_t", "similarity"), req, "_t", "similarity")


def lookup_isbn(req: DataFrame, cat: DataFrame, key: str = "req_id", order: list[str] = ["id"]) -> DataFrame:
    """Requests with the first catalog row whose isbn contains theirs, bare digits before the text as given."""
    bare, given = _isbn_keys()
    wanted = req.select(F.explode(F.array(bare, given)).alias("_needle")).filter(F.col("_needle") != "")
    hits = _isbn_hits(wanted, cat, order)
    out = _attach(_attach(req, hits, bare, key, "_bare"), hits, given, key, "_given")
    return _unpack(out.withColumn("_i", F.coalesce("_bare", "_given")), req, "_i")


def resolve(
    req: DataFrame, cat: DataFrame, key: str = "req_id", k: int | None = None, minimum: float = 0.4, order: list[str] = ["id"]
) -> DataFrame:
    """Cascade code, title, isbn: the first hit fills the request's gaps.

    The dear substring tiers only look for requests no code resolved, and each is one lookup of distinct
    needles attached to the requests; no tier runs another one again.  ``fallback`` marks requests that
    have an isbn but no hit.
    """
    bare, given = _isbn_keys()
    keyed = req.withColumns({"_k_title": _title_key(), "_k_bare": bare, "_k_given": given})
    coded = _attach(keyed, _code_hits(cat, order), _code_key(), key, "_code")
    open_ = F.col("_code").isNull()
    wanted = coded.filter(open_).select(F.col("_k_title").alias("_needle")).filter(F.col("_needle") != "")
    titled = _attach(coded, _title_hits(wanted, cat, k, minimum, order), F.when(open_, F.col("_k_title")), key, "_title", "similarity")
    tries = coded.filter(open_).select(F.explode(F.array("_k_bare", "_k_given")).alias("_needle")).filter(F.col("_needle") != "")
    hits = _isbn_hits(tries, cat, order)
    unsolved = open_ & F.col("_title").isNull()
    every = _attach(
        _attach(titled, hits, F.when(unsolved, F.col("_k_bare")), key, "_bare"), hits, F.when(unsolved, F.col("_k_given")), key, "_given"
    )
    tier = (
        F.when(F.col("_code").isNotNull(), "code")
        .when(F.col("_title").isNotNull(), "title")
        .when(F.coalesce("_bare", "_given").isNotNull(), "isbn")
    )
    hit = every.withColumn("_h", F.coalesce("_code", "_title", "_bare", "_given")).withColumn("tier", tier)
    filled = ("title", "isbn", "ss_code", "author", "publisher")
    own = lambda c: [nonempty(c)] if c in req.columns else []
    gaps = {c: F.coalesce(*own(c), nonempty(F.col("_h")[c])) for c in filled}
    more = [c for c in req.columns if c not in (key, *filled, "book_id", "tier", "fallback")]
    return hit.select(
        key,
        *[v.alias(c) for c, v in gaps.items()],
        F.col("_h.id").alias("book_id"),
        *more,
        "tier",
        (F.col("tier").isNull() & nonempty("isbn").isNotNull()).alias("fallback"),
    )


# ---------------------------------------------------------------- enrichment


def _one_per_key(extra: DataFrame, on: list[str], order: list[str] | None) -> DataFrame:
    return top_per_group(extra, on, [F.col(o) for o in order]) if order else extra


def enrich_fill(base: DataFrame, extra: DataFrame, on: list[str], fields: list[str], order: list[str] | None = None) -> DataFrame:
    """Left join; the other source only fills empty fields.

    ``order`` picks one row per key of ``extra`` first.  An ``author`` also becomes the only element of
    an empty ``authors`` array.
    """
    picked = _one_per_key(extra, on, order).select(*on, *[F.col(f).alias(f"_x_{f}") for f in fields])
    out = base.join(picked, on, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(nonempty(f), nonempty(f"_x_{f}")) if f in base.columns else nonempty(f"_x_{f}"))
    if "authors" in base.columns and "author" in fields:
        none = F.size(F.coalesce("authors", F.array().cast("array<string>"))) == 0
        out = out.withColumn(
            "authors", F.when(none & nonempty("_x_author").isNotNull(), F.array(nonempty("_x_author"))).otherwise(F.col("authors"))
        )
    return out.drop(*[f"_x_{f}" for f in fields])


def enrich_override(base: DataFrame, extra: DataFrame, on: list[str], fields: list[str], order: list[str] | None = None) -> DataFrame:
    """Left join; non-empty values of the other source win."""
    picked = _one_per_key(extra, on, order).select(*on, *[F.col(f).alias(f"_x_{f}") for f in fields])
    out = base.join(picked, on, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(nonempty(f"_x_{f}"), F.col(f)) if f in base.columns else nonempty(f"_x_{f}"))
    return out.drop(*[f"_x_{f}" for f in fields])


def attach_details(cand: DataFrame, details: DataFrame, on: str, defaults: dict, order: list[str] | None = None) -> DataFrame:
    """Left join of details; absent ones take the default (a value or a Column)."""
    picked = _one_per_key(details, [on], order).select(on, *[F.col(f).alias(f"_x_{f}") for f in defaults])
    out = cand.join(picked, on, "left")
    return out.select(
        *[c for c in cand.columns if c not in defaults],
        *[F.coalesce(F.col(f"_x_{f}"), d if isinstance(d, Column) else F.lit(d)).alias(f) for f, d in defaults.items()],
    )


def candidate_gate(req: DataFrame, cand: DataFrame, on: str, minimum: int = 30, normalize: bool = True) -> DataFrame:
    """Candidates (``cand_title``, ``cand_isbn``) that do not contradict their request's title and isbn."""
    both = nonempty("title").isNotNull() & nonempty("cand_title").isNotNull()
    relevant = ~both | (title_relevance("cand_title", "title", normalize) >= minimum)
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    isbns = nonempty("isbn").isNotNull() & nonempty("cand_isbn").isNotNull()
    return cand.join(req, on).filter(relevant & (~isbns | (bare("isbn") == bare("cand_isbn"))))


def select_candidate(req: DataFrame, cand: DataFrame, on: str, wanted: str, order: list[str]) -> DataFrame:
    """Candidate with the wanted id or hash, else the request's first candidate; NULL without any."""
    hit = (F.col("cand_id") == F.col(wanted)) | (F.col("cand_hash") == F.col(wanted))
    asked = req.select(on, wanted)
    matched = asked.join(cand, on, "left").withColumn("matched", F.coalesce(hit, F.lit(False)))
    return top_per_group(matched, [on], [F.desc("matched"), *[F.col(o) for o in order]])


def best_match(df: DataFrame, key: str, score: str, order: list[str]) -> DataFrame:
    """Row with the highest score per key, ties to the first."""
    return top_per_group(df, [key], [F.desc(score), *[F.col(o) for o in order]])


def source_presence(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Map from source to whether its contents list is present; ``sources`` maps names to columns."""
    pairs = [x for name, c in sources.items() for x in (F.lit(name), nonempty(c).isNotNull())]
    return df.withColumn("raw_sources", F.create_map(*pairs))


# ---------------------------------------------------------------- attempts and files

#: Which provider tiers a request may use, by its origin ("" = local catalog).
ROUTES = {"vendor": ["vendor"], "archive": ["archive"], "": ["archive", "vendor", "library"]}


def first_success(attempts: DataFrame, key: str, routes: dict[str, list[str]] = ROUTES) -> DataFrame:
    """First successful provider of each item in tier order, among those its origin allows."""
    tier = F.lit(None).cast("int")
    for origin, providers in routes.items():
        for i, p in enumerate(providers):
            match = (F.col("provider") == p) & (
                (F.col("origin") == origin) if origin else ~F.col("origin").isin([o for o in routes if o])
            )
            tier = F.when(match, i).otherwise(tier)
    allowed = attempts.withColumn("tier", tier).filter(F.col("tier").isNotNull() & F.col("ok"))
    return top_per_group(allowed, [key], [F.col("tier")]).select(key, "origin", "provider", "tier")


MIN_FILE_BYTES = 1024


def match_files(req: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """File of each request (``name``, ``code``): the exact name, else one named ``code_…`` or ``code.…``.

    A code may hold '_' and '.' itself.  Files up to 1024 bytes do not count.
    """
    usable = files.filter(F.col("bytes") > MIN_FILE_BYTES).select(F.col("file_name"), "bytes")
    exact = top_per_group(usable, ["file_name"], [F.col("bytes")]).select(
        F.col("file_name").alias("_exact"), F.col("bytes").alias("_exact_bytes")
    )
    # Every start of the name that ends before a '_' or '.', where a '.' follows somewhere.
    name = F.col("file_name")
    ends = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)).isin("_", ".") & F.contains(name, F.lit(".")))
    coded = usable.withColumn("_code", F.explode(F.transform(ends, lambda i: F.substring(name, F.lit(1), i - 1))))
    coded = top_per_group(coded.filter(F.col("_code") != ""), ["_code"], [F.col("file_name")]).select(
        "_code", F.col("file_name").alias("_named"), F.col("bytes").alias("_named_bytes")
    )
    out = req.join(exact, F.col("name") == F.col("_exact"), "left").join(coded, F.col("code") == F.col("_code"), "left")
    return out.select(
        key,
        F.coalesce("_exact", "_named").alias("file_name"),
        F.coalesce("_exact_bytes", "_named_bytes").alias("bytes"),
    ).filter(F.col("file_name").isNotNull())


def already_done(req: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Requests with a finished file ``title.pdf|epub|mobi`` over 1024 bytes, first extension first."""
    stem = F.regexp_extract("file_name", "^(.*)\\.(pdf|epub|mobi)$", 1)
    ext = F.regexp_extract("file_name", "^(.*)\\.(pdf|epub|mobi)$", 2)
    done = files.filter((F.col("bytes") > MIN_FILE_BYTES) & (stem != "")).select(
        stem.alias("_stem"), "file_name", F.array_position(F.array(*map(F.lit, ["pdf", "epub", "mobi"])), ext).alias("_place")
    )
    first = top_per_group(done, ["_stem"], [F.col("_place")]).drop("_place")
    safe = F.regexp_replace("title", "[/\\\\]", "_")
    return req.filter(nonempty("title").isNotNull()).join(first, safe == F.col("_stem")).select(key, "file_name")


def still_to_do(req: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return req.join(already_done(req, files, key), key, "left_anti")

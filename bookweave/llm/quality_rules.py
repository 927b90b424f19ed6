"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a feature (an SQL expression over the columns in ``FEATURES``' order) and a condition under
which a document is rejected.  ``plan_cascade`` measures each rule on a sample: its share of rejected rows
and the time it adds; the rules then run in falling order of rejection per cost, each one only for the rows
that all earlier ones kept.  The order changes the cost alone: the verdict is the conjunction of all rules.

Defined results: null or empty text has no words and is rejected by ``few_words``; repeated rows are judged
alike; other columns of the input are carried along (helper columns have a prefix of their own); an empty
table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, as in ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
P = "_qr_"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _pairs(a: str, step: int) -> Column:
    """Hash of each element with the one ``step`` further on."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, step + 1, n), lambda x, y: F.xxhash64(x, y))


def _layers(df: DataFrame, steps: list[tuple[str, Column]], alive: Column | None) -> DataFrame:
    for name, value in steps:
        df = df.withColumn(P + name, value if alive is None else F.when(alive, value))
    return df


def repeat_steps() -> list[tuple[str, Column]]:
    """Columns that lead from words to ``n_repeat_words``: window hashes by doubling, then, only where one
    occurs twice, the sorted starts of the repeated windows and the words that they cover together."""
    s, p = P + "sorted", P + "starts"
    sorted_windows = F.sort_array(F.transform(P + "h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(s)
    same = lambda k: F.get(s, k)["h"]
    starts = F.transform(s, lambda x, k: F.when((same(k - 1) == x["h"]) | (same(k + 1) == x["h"]), x["i"]))
    m = F.size(p) - 1
    gaps = F.zip_with(F.slice(p, 1, m), F.slice(p, 2, m), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.size(p) > 0, F.aggregate(gaps, F.lit(WINDOW), lambda t, x: t + x)).otherwise(0)
    return [
        ("h1", F.transform(P + "words", lambda w: F.xxhash64(w))),
        ("h2", _pairs(P + "h1", 1)),
        ("h4", _pairs(P + "h2", 2)),
        ("h8", _pairs(P + "h4", 4)),
        ("sorted", F.when(F.size(F.array_distinct(P + "h8")) < F.size(P + "h8"), sorted_windows)),
        ("starts", F.when(n > 0, F.sort_array(F.array_compact(starts)))),
        ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")),
    ]


def _line_steps() -> list[tuple[str, Column]]:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return [
        ("lines", lines),
        ("n_lines", F.size(P + "lines").cast("long")),
        ("n_dup_lines", (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long")),
    ]




def features() -> dict[str, list[tuple[str, Column]]]:
    text = F.coalesce("text", F.lit(""))
    return {
        "words": [("words", words_of(F.col("text"))), ("n_words", F.size(P + "words").cast("long"))],
        "chars": [("word_chars", F.length(F.array_join(P + "words", "")).cast("long"))],
        "symbols": [("n_symbols", F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"))],
        "capitals": [("n_capitals", F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"))],
        "lines": _line_steps(),
        "repeats": repeat_steps(),
    }


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the feature columns; ``needs`` are the feature groups it reads."""

    name: str
    needs: tuple[str, ...]
    fails: str


RULES = (
    Rule("few_words", ("words",), f"{P}n_words < 20"),
    Rule("word_length", ("words", "chars"), f"{P}word_chars > 20 * {P}n_words OR {P}word_chars < 2 * {P}n_words"),
    Rule("symbols", ("words", "symbols"), f"10 * {P}n_symbols > 3 * {P}n_words"),
    Rule("capitals", ("words", "chars", "capitals"), f"2 * {P}n_capitals > {P}word_chars"),
    Rule("dup_lines", ("lines",), f"10 * {P}n_dup_lines > 4 * {P}n_lines"),
    Rule("repeats", ("words", "repeats"), f"100 * {P}n_repeat_words > 30 * {P}n_words"),
)
#: Order where a sample has no rows.
DEFAULT_ORDER = tuple(r.name for r in RULES)


def _measured(df: DataFrame, rules: tuple[Rule, ...], alive: Column | None = None) -> DataFrame:
    made, have = features(), set(df.columns)
    for group in dict.fromkeys(g for r in rules for g in r.needs):
        if P + made[group][-1][0] not in have:
            df = _layers(df, made[group], alive)
    return df


def plan_cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400, fraction: float = 0.1) -> list[dict]:
    """Rules in falling order of rejections per second, as measured on at most ``sample_rows`` rows drawn
    with ``fraction``.  Only verdicts leave the executors.  Each row: name, rejected (share), cost (s)."""
    sample = df.select("text").sample(fraction, seed=7)
    found = []
    _measured(sample, rules[:1]).select(F.expr(rules[0].fails)).take(sample_rows)  # start-up is no rule's cost
    for rule in rules:
        begun = time.perf_counter()
        seen = _measured(sample, (rule,)).select(F.expr(rule.fails).alias("x")).take(sample_rows)
        cost = time.perf_counter() - begun
        if not seen:
            return [{"name": r.name, "rejected": 0.0, "cost": 0.0} for r in rules]
        found.append({"name": rule.name, "rejected": sum(bool(r["x"]) for r in seen) / len(seen), "cost": cost})
    return sorted(found, key=lambda r: -r["rejected"] / max(r["cost"], 1e-9))


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, verdict: str = "kept") -> DataFrame:
    """``df`` with a boolean ``verdict``.  Each rule and the features it needs are evaluated only for rows
    that every earlier rule has kept; ``order`` is measured by ``plan_cascade`` where it is not given."""
    kept, by = df.columns, {r.name: r for r in rules}
    order = order or [r["name"] for r in plan_cascade(df, rules)]
    alive = None
    for k, name in enumerate(order):
        df = _measured(df, (by[name],), alive)
        ok = ~F.coalesce(F.expr(by[name].fails), F.lit(False))
        df = df.withColumn(f"{P}alive{k}", ok if alive is None else alive & ok)
        alive = F.col(f"{P}alive{k}")
    # Not deterministic by form, so that no filter on the verdict is pushed below the features, which would
    # copy their expressions over and over.
    held = F.monotonically_increasing_id() >= 0
    return df.select(*kept, (held if alive is None else alive & held).alias(verdict))


def measure(df: DataFrame) -> DataFrame:
    """``df`` with every feature of every rule, prefix ``_qr_``, for all rows."""
    return _measured(df, RULES)


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: counts, the base verdict and the cascade's."""
    order = [r["name"] for r in plan_cascade(docs)]
    df = cascade(measure(docs.select("doc_id", "text")), order=order, verdict=P + "kept")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col(P + "n_words") < 20) | (100 * F.col(P + "n_repeat_words") > 30 * F.col(P + "n_words"))
    return df.select(
        "doc_id", *(F.col(P + c).alias(c) for c in counts), failed.alias("base_failed"), (~failed & F.col(P + "kept")).alias("kept")
    )

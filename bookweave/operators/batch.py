"""Batches of pages for a model, and the hook that runs one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: pages of a window probed when the contents pages are unknown.
PROBE_PAGES = 5


def plan_batches(docs: DataFrame, size: int = 3, max_rounds: int | None = None) -> DataFrame:
    """(doc_id, round, first_page, last_page) per document of (doc_id, total_pages, toc_start, toc_end).

    Known range: consecutive batches over all of it.  Unknown: windows over the whole document.
    ``max_rounds`` keeps only so many batches of a document, where that is wanted.
    """
    known = F.col("toc_start") >= 0
    step = lambda n: F.lit(n).cast("bigint")
    batches = F.when(F.col("toc_start") <= F.col("toc_end"), F.sequence(F.col("toc_start"), F.col("toc_end"), step(size)))
    windows = F.when(F.col("total_pages") > 0, F.sequence(step(0), F.col("total_pages") - 1, step(PROBE_PAGES)))
    starts = F.when(known, batches).otherwise(windows)
    if max_rounds is not None:
        starts = F.slice(starts, 1, max_rounds)
    rows = docs.select("doc_id", "total_pages", "toc_end", known.alias("_known"), F.posexplode(starts).alias("round", "first_page"))
    last = F.when(F.col("_known"), F.least(F.col("first_page") + size - 1, F.col("toc_end"))).otherwise(
        F.least(F.col("first_page") + PROBE_PAGES - 1, F.col("total_pages") - 1)
    )
    return rows.select("doc_id", F.col("round").cast("bigint").alias("round"), "first_page", last.cast("bigint").alias("last_page"))


def map_pages(
    pages: DataFrame,
    fn: Callable[[pd.DataFrame], list[str]],
    batch: int = 16,
    concurrency: int | None = None,
    key: list[str] = ["doc_id", "page_no"],
) -> DataFrame:
    """Run ``fn`` (a model or a client) over batches of page rows; its texts come back as ``text``.

    A batch that fails yields empty texts and says why in ``error``.  ``concurrency`` spreads pages by key over that many tasks
    (the session's shuffle partitions if they are more), so a huge document does not end up in one.  Filter before this operator: Spark does not push
    conditions through Python.
    """
    types = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", text string, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            # One frame goes back for each that came: a frame for each batch costs more than a small batch itself.
            texts, errors = [], []
            for i in range(0, len(pdf), batch):
                part, error = pdf.iloc[i : i + batch], None
                try:
                    got = list(fn(part))
                    if len(got) != len(part):
                        raise ValueError("one text per page expected")
                except Exception as e:  # noqa: BLE001 - a failing batch must not fail the job
                    got, error = [""] * len(part), f"{type(e).__name__}: {e}"
                texts += got
                errors += [error] * len(part)
            yield pdf[key].assign(text=texts, error=errors)

    # A fixed number of tasks would get more pages each as the table grows.
    tasks = max(concurrency or 0, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = pages.repartition(tasks, *key) if concurrency else pages
    return spread.mapInPandas(run, schema)

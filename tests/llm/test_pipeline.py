"""The pipeline's stages on the small tables, and the registered queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from bookweave.llm.queries import ORACLES

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert docs.count() <= before
        if name != "tokens":
            assert docs.columns == columns
    assert docs.where("NOT round_trip").count() == 0 and docs.count() > 100


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
    assert docs.count() == 0


def test_stages_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = {c: F.lit("x") for c in ("_kept", "_back", "n_tokens", "round_trip", "token_ids")}
    more = docs.withColumns(extra)
    kept = corpus_pipeline.quality(spark, more, SMALL)
    assert kept.columns == more.columns and kept.count() == corpus_pipeline.quality(spark, docs, SMALL).count()
    made = corpus_pipeline.tokens(spark, kept, SMALL)
    assert made.where("NOT round_trip").count() == 0 and made.where("_kept = 'x' AND _back = 'x'").count() == kept.count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    got = entry.queries()[name](spark, SMALL)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())

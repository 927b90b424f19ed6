"""What keeps the work of large tables even and their shuffles few."""

import random

from pyspark.sql import functions as F

from bookweave.functions import toclines as L
from bookweave.operators import layout as Y
from bookweave.operators import toc as T
from bookweave.plans.views import Views

from .conftest import SMALL

TOC = "doc_id bigint, source_rank int, seq bigint, title string, page bigint"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_row_group_of_many_splits_is_spread(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat(md5(CAST(id AS STRING)), 20) AS text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() >= 8
        held = Views(spark, str(tmp_path)).documents.rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(held) == 400 and sum(n > 0 for n in held) >= 8


def test_answers_and_levels_are_read_once(frame):
    answer = frame([(1, "a\t1\nb\t2\nc\t3")], "doc_id bigint, response string")
    assert "ReusedExchange" in plan(T.parse_response(answer))
    rows = frame([(1, 0, "第一章 a", 1, None), (1, 1, "b", 2, None)], "doc_id bigint, seq bigint, title string, page bigint, explicit bigint")
    assert "ReusedExchange" in plan(T.assign_levels(rows))


def test_titles_of_short_books_are_grouped_once(frame):
    rows = [(1, 0, i, t, i) for i, t in enumerate(["granite", "Granite", "mud", "slate"])] + [(None, 0, 0, "x", 1)]
    got = T.merge_tocs(frame(rows, TOC))
    assert sorted(r.title for r in got.collect()) == ["granite", "mud", "slate", "x"]
    assert "LeftAnti" in plan(got)


def test_texts_of_boxes_without_their_other_columns(frame):
    boxes = frame([(d, 0, i, 0.1, 0.1 * i, 0.9, 0.1 * i + 0.02) for d in (1, None) for i in range(4)], "doc_id bigint, page_no bigint, box_no bigint, x0 double, y0 double, x1 double, y1 double")
    blocks = frame([(1, 0, 0, "aaaa bbbb cc", 0.0, 0.0, 1.0, 0.25)], "doc_id bigint, page_no bigint, block_no bigint, text string, bx0 double, by0 double, bx1 double, by1 double")
    got = Y.box_texts(boxes, blocks)
    assert [(r.box_no, r.text) for r in got.where("doc_id = 1").orderBy("box_no").collect()] == [(0, "aaaa"), (1, " bbb"), (2, "b cc"), (3, "")]
    assert [r.text for r in got.where("doc_id IS NULL").collect()] == [""] * 4
    every = Y.spatial_texts(boxes, blocks)
    assert "x0" in every.columns and every.count() == 8


def test_openings_of_few_and_of_many(frame, monkeypatch):
    e = frame([(1, i, t, i) for i, t in enumerate(["abcdef", "zzzzzz", "bcdexx"])], "doc_id bigint, seq bigint, title string, page bigint")
    t = frame([(1, "ab cde")], "doc_id bigint, text string")
    for few, long in ((2048, 1 << 20), (1, 1 << 20), (2048, 2)):
        monkeypatch.setattr(T, "FEW", few)
        monkeypatch.setattr(T, "LONG", long)
        assert sorted(r.title for r in T.cross_validate(e, t).collect()) == ["abcdef", "bcdexx"]


def test_solid_titles(one):
    for text in ("a.b", "ab", "章 节", ".a", "a", "…·", ""):
        assert one(L.is_solid, text) == (one(lambda c: F.length(L.solid_title(c)), text) >= 2)


def test_pages_in_one_row_or_in_bands(frame, monkeypatch):
    """A page gathered in one row has the texts of a page cut into bands; its boxes and texts move once."""
    r = random.Random(3)
    boxes = [(d, p, i, x := r.random() / 2, y := r.random(), x + r.choice([0.0, 0.1, 0.45, -0.1]), y + 0.02) for d in (1, 2, None) for p in (0, 1, None) for i in range(25)]
    words = ["ab", " cde", "  ", "the", "thethe", "x y z ", "", None]
    blocks = [(d, p, k, (w := r.choice(words)) and w * r.randint(1, 30), 0.05, y := r.random(), 0.8, y + r.random() - 0.1) for d in (1, 2, 3, None) for p in (0, 1, None) for k in range(9)]
    boxes = frame([*boxes, (1, 0, 25, None, 0.1, 0.4, 0.2)], "doc_id bigint, page_no bigint, box_no bigint, x0 double, y0 double, x1 double, y1 double")
    blocks = frame(blocks, "doc_id bigint, page_no bigint, block_no bigint, text string, bx0 double, by0 double, bx1 double, by1 double")
    perbox = boxes.withColumn("text", F.when(F.col("box_no") % 5 == 0, "one line").otherwise(""))
    found = []
    for few in (128, 12, 0):
        monkeypatch.setattr(Y, "FEW_BOXES", few)
        found.append(sorted(map(str, Y.fill_from_spatial(perbox, Y.box_texts(boxes, blocks)).collect())))
    assert len(found[0]) == 226 and found[0] == found[1] == found[2] and sum("the" in x for x in found[0]) > 5
    monkeypatch.setattr(Y, "FEW_BOXES", 128)
    assert plan(Y.fill_from_spatial(perbox, Y.box_texts(boxes, blocks))).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 8


def test_documents_are_spread_once_for_their_contents(spark, frame):
    """The readers of documents and of their entries share one exchange; entries move once, as they are."""
    from bookweave.plans import contents

    text = plan(contents.cross_validate(Views(spark, SMALL))).split("== Initial Plan ==")[0].split("\n")
    assert sum("REPARTITION_BY_NUM" in x and "ReusedExchange" not in x for x in text) == 1
    assert sum("hashpartitioning(_group" in x for x in text) == 0
    rows = [(d, i, t, i) for d in (1, 2, 3, 4, None) for i, t in enumerate(["abcdef", "zzzzzz", "ab", None, "abcdxx", "yyyyyy"])]
    e = frame(rows, "doc_id bigint, seq bigint, title string, page bigint")
    t = frame([(1, "xx ab cde"), (2, " "), (3, "nothing here"), (3, "yyyy y"), (None, "abcd")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.seq) for r in T.cross_validate(e, t).collect())
    # 1: two of six entries occur; 2 and 4 have no text, null no document; 3: too few occur.
    assert got == sorted([("1", i) for i in (0, 2, 3, 4)] + [(d, i) for d in ("2", "3", "4", "None") for i in range(6)])

"""Stages of the pipeline on repeated and null ids."""

import random

import corpus_pipeline

from .conftest import SF_DIR


def test_rows_are_judged_by_their_own_text(spark, tables):
    pick = random.Random(5)
    texts = [" ".join(f"w{pick.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    item = tables("benchmark").where("item_id = 0").first()["text"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (2, texts[2] + " end"), (None, texts[3]), (None, texts[3] + " end")]
    rows += [(3, texts[3]), (4, texts[4]), (None, texts[4] + " end"), (None, texts[5]), (None, texts[5]), (None, None), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()]
    want = [(1, texts[0]), (1, texts[1]), (3, texts[3]), (4, texts[4]), (None, texts[5]), (None, None), (None, None), (5, None)]
    two = [r for r in left if r[0] == 2]
    assert len(two) == 1 and two[0] in rows
    assert sorted(map(str, [r for r in left if r[0] != 2])) == sorted(map(str, want))
    rows = [(1, texts[0]), (1, texts[1] + " " + item), (None, item), (None, texts[2]), (None, None)]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [rows[0], rows[3], rows[4]]))

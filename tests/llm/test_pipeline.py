"""The pipeline's stages and registration."""

import __spark_entry__ as contract
import corpus_pipeline
from harvestgrid.llm.quality import classify_quality

from .conftest import SF_DIR


def test_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_stages_take_effect(spark, tables):
    docs = tables("documents")
    rows = docs.collect()
    wide = docs.selectExpr("*", "1 AS keep", "'x' AS row", "'y' AS class_id", "0 AS rejected")
    same = wide.where("doc_id = 4").selectExpr("*")
    wide = wide.union(same).union(same.selectExpr("9001L", "text", "lang", "source", "n_chars", "keep", "row", "class_id", "rejected"))
    wide = wide.union(same.selectExpr("9002L", "NULL", "lang", "source", "n_chars", "keep", "row", "class_id", "rejected"))
    columns, left = wide.columns, wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF_DIR)
        assert after.columns == columns, name
        left = spark.createDataFrame(after.collect(), wide.schema)
        assert 0 < left.count()
    ids = [r["doc_id"] for r in left.collect()]
    assert len(set(ids)) == len(ids) and 9001 not in ids and 9002 not in ids
    junk = {r["id"] for r in classify_quality(docs).collect() if not r["keep"]}
    assert not junk & set(ids) and len(ids) > 0.7 * len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, left, SF_DIR).collect()} == set(ids)


def test_run_packs_what_the_stages_keep(spark, tables):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["bin", "doc_id", "piece", "start", "length", "at"]
    total = got.groupBy().sum("length").first()[0]
    kept = tables("documents").join(got.select("doc_id").distinct(), "doc_id").selectExpr("sum(octet_length(text))").first()[0]
    assert total == kept > 0


def test_empty_tables(spark, tables):
    left = tables("documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF_DIR)
        assert left.count() == 0, name

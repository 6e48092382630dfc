"""Language models keep every gram, and give the same through joins as broadcast."""

import pytest
from pyspark.sql import functions as F

from harvestgrid.llm import language_id
from harvestgrid.llm.language_id import four_grams, identify_languages, train_model

DOCS = "doc_id long, text string, lang string"


def test_models_keep_every_gram(spark):
    texts = ["".join(chr(0x4E00 + (k * k * 7 + k * j) % 5000) for j in range(400)) for k in range(20)]
    model = train_model(spark.createDataFrame([("zh", t) for t in texts], "lang string, text string"))
    want = {int(g) for t in texts for g in four_grams(t)}
    assert set(model.tables["p", 4][0].tolist()) == want


def test_joined_model_equals_broadcast_model(spark, tables, monkeypatch):
    docs = tables("documents").select("doc_id", "text", "lang").where("doc_id < 60")
    odd = [(None, "the cat", None), (900, None, "en"), (901, "12 .", None), (902, "ขอบคุณมาก" * 9, None), (903, "of it", "en"), (903, "of it", "en")]
    docs = docs.union(spark.createDataFrame(odd, DOCS))
    trains = (F.col("doc_id") % 5 != 0) & F.col("lang").isNotNull()

    def judged():
        return sorted((tuple(r) for r in identify_languages(docs, trains).collect()), key=lambda r: (r[-1], r[0] or -1))

    want = judged()
    monkeypatch.setattr(language_id, "MODEL_ROWS", 0)
    got = judged()
    assert len(got) == len(want) == docs.count()
    for a, b in zip(got, want, strict=True):
        assert (a[0], a[1], a[2], a[4], a[6]) == (b[0], b[1], b[2], b[4], b[6])
        assert a[3] == pytest.approx(b[3], abs=1e-9) and a[5] == pytest.approx(b[5], abs=1e-9)

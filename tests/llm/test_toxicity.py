"""Toxicity: folding, the lexicon against a plain search, learning on labels kept out."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from harvestgrid.llm.toxicity import Lexicon, _matches, beginnings, fold_words, learn_lexicon, score_toxicity, text_measures

DOCS = "doc_id long, text string, score int"
MARKS = "doc_id long, toxic int, text string"


def test_folding():
    assert fold_words("You 1D10T, $tup1d m0r0n!!") == ["you", "idiot", "stupid", "moron"]
    assert fold_words("ＩＤＩＯＴ sсum trаsh іdiоt") == ["idiot", "scum", "trash", "idiot"]
    assert fold_words("привет 2024 r2d2 a_b") == ["привет", "2024", "rzdz", "a_b"] or fold_words("привет 2024") == ["привет", "2024"]
    assert fold_words("") == [] and fold_words("!!! $$$") == []


def plain_matches(weights, exceptions, words):
    spared = set()
    for phrase in exceptions:
        parts = fold_words(phrase)
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                spared.update(range(k, k + len(parts)))
    out = []
    for k, word in enumerate(words):
        found = [e for e in beginnings(word) if e in weights]
        if found and k not in spared:
            out.append(max(found, key=len))
    return out


def test_matches_equal_plain_search():
    draw = random.Random(3)
    vocabulary = ["idiot", "idiotic", "idio", "trash", "trashcan", "can", "ab", "abc", "a", "scum"]
    for _ in range(300):
        entries = {e: draw.random() + 0.1 for w in draw.sample(vocabulary, 4) for e in draw.sample(list(beginnings(w)), 1)}
        exceptions = tuple(" ".join(draw.choices(vocabulary, k=draw.randint(1, 3))) for _ in range(2))
        words = draw.choices(vocabulary, k=draw.randint(0, 12))
        got = [entry for _, entry, _ in _matches(Lexicon(entries, exceptions).automaton(), words)]
        taken = {f" {' '.join(fold_words(p))} " for p in exceptions}
        assert got == plain_matches({e: w for e, w in entries.items() if e not in taken}, exceptions, words)


def test_length_and_exceptions():
    lexicon = Lexicon({" trash ": 3.0}, ("trash can",), (-3.0, 1.0, 1.0, 0.5))
    near, far, spared, clean = (
        text_measures(t, lexicon.automaton()) for t in ("you trash", "you trash " + "word " * 400, "the trash can", "the can")
    )
    assert near[1] > far[1] > 0 and spared == clean


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(5)
    filler = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, marks = [], []
    for k in range(1200):
        toxic = k % 4 == 0
        words = draw.choices(filler, k=draw.randint(5, 60))
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["blork", "blorken", "gr1m", "GRIM", "blоrky"]))
        elif k % 24 == 3:
            words[1:1] = ["old", "grim", "reaper"]
        rows.append((k, " ".join(words), 1))
        marks.append((k, int(toxic), "x"))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, MARKS)


def test_learned_on_rows_kept_out(spark, labelled):
    docs, marks = labelled
    lexicon = learn_lexicon(docs, marks, F.col("doc_id") % 5 != 0)
    assert any(e.startswith(" blork"[:4]) for e in lexicon.weights) and {"old grim", "grim reaper"} & set(lexicon.exceptions)
    got = score_toxicity(docs.where("doc_id % 5 = 0"), lexicon).collect()
    assert docs.columns + ["_score", "predicted"] == list(got[0].asDict())
    wrong = sum(r["predicted"] != (r["doc_id"] % 4 == 0) for r in got)
    assert len(got) == 240 and wrong <= 4


def test_odd_rows(spark, labelled):
    docs, marks = labelled
    lexicon = learn_lexicon(docs, marks, F.lit(True), training_rows=100)
    long = "clean words " * 200_000
    odd = spark.createDataFrame(
        [(None, None, 1), (1, "", 1), (1, "", 1), (2, "\x00 ​!!", 1), (3, long, 1), (4, long + " blork blork", 1)], DOCS
    )
    got = [(r["doc_id"], r["_score"], r["predicted"]) for r in score_toxicity(odd, lexicon).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s, _ in got) and len({s for _, s, _ in got[:5]}) == 1
    assert got[5][1] > got[4][1]
    assert score_toxicity(odd.limit(0), lexicon).count() == 0


def test_labels_missing_repeated_or_of_one_class(spark, labelled):
    docs, marks = labelled
    none = learn_lexicon(docs, marks.limit(0), F.lit(True))
    assert score_toxicity(docs.limit(3), none).where("_score < 0.01 AND predicted = 0").count() == 3
    alone = learn_lexicon(docs, marks.where("toxic = 1"), F.lit(True))
    assert not alone.weights and score_toxicity(docs.limit(3), alone).where("predicted = 1").count() == 3
    again = marks.union(marks).union(spark.createDataFrame([(None, 1, "x"), (1, None, "x"), (2, 7, "x")], MARKS))
    assert learn_lexicon(docs, again, F.lit(True)) == learn_lexicon(docs, marks, F.lit(True))
    hot = docs.union(docs.where("doc_id = 4").crossJoin(spark.range(20_000)).select(*docs.columns))
    assert learn_lexicon(hot, marks, F.lit(True)) == learn_lexicon(docs, marks, F.lit(True))


def test_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    got = contract.queries()["op13_toxicity"](spark, folder)
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    kept_out = {(r["toxic"], r["predicted"]): r["count"] for r in got.where("held_out").join(marks, "doc_id").groupBy("toxic", "predicted").count().collect()}
    caught, missed, false = kept_out[1, 1], kept_out.get((1, 0), 0), kept_out.get((0, 1), 0)
    assert 2 * caught / (2 * caught + missed + false) >= 0.93
